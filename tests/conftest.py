import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def dissect(spark):
    """Rows of dissected fields, named with dots, as a DataFrame."""
    from packetloom.schema import column_of, dissected_schema

    def make(rows, capture="cap"):
        schema = dissected_schema()
        full = [tuple(dict((column_of(k), v) for k, v in r.items()).get(f.name, "") for f in schema.fields) for r in rows]
        from pyspark.sql import functions as F

        return spark.createDataFrame(full, schema).withColumn("capture_id", F.lit(capture))

    return make
