"""The sample's bound and the class prior."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.llm import toxicity


@pytest.fixture(scope="module")
def tables(spark):
    """Toxic documents say one word; document 1 is a third of the rows, most of them another text."""
    docs = [(i, f"plain words number {i} here" + (" venom" if i % 4 == 0 else "")) for i in range(200)] + [(1, f"plain copy {i % 3}") for i in range(100)]
    labels = [(i, int(i % 4 == 0)) for i in range(200)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_a_repeated_id_is_one_example(tables, monkeypatch):
    seen = []
    real = toxicity._features
    monkeypatch.setattr(toxicity, "_features", lambda rows: seen.append(real(rows)) or seen[-1])
    monkeypatch.setattr(toxicity, "discard", lambda df: None)
    monkeypatch.setattr(toxicity, "LEAST", 5.0)
    docs, labels = tables
    model = toxicity.train(docs, labels)
    ids = docs.filter(~toxicity.held_out(F.col("doc_id"))).select("doc_id").distinct().count()
    pos = labels.filter("toxic = 1").filter(~toxicity.held_out(F.col("doc_id"))).count()
    assert seen[0].count() == ids + pos
    got = toxicity.score(docs, model).select("doc_id", "predicted").distinct().collect()
    assert {r.doc_id for r in got if r.predicted} == {i for i in range(200) if i % 4 == 0}


def test_priors(tables):
    docs, labels = tables
    for bad in (0.0, 1.0, -0.1):
        with pytest.raises(ValueError, match="prior"):
            toxicity.train(docs, labels, prior=bad)
    assert toxicity.train(docs, labels, prior=0.6).prior == 0.6
    none = toxicity.train(docs, labels.limit(0), prior=0.6)
    assert np.isclose(toxicity.score(docs, none).first().score, 0.6)
    assert toxicity.train(docs, labels.withColumn("toxic", F.lit(1))).prior == toxicity.PRIOR[1]


def test_many_sources_are_joined(spark, monkeypatch):
    """More sources than are broadcast: the same mix."""
    from packetloom.llm import mixing

    rows = [(i, None if i % 50 == 0 else f"s{i % 37}", "w " * (i % 9)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    want = sorted(map(tuple, mixing.mix(docs).collect()), key=repr)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, mixing.mix(docs).collect()), key=repr) == want
