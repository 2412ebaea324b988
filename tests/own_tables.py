"""Small tables of the catalogue's own, for where the given ones aren't there."""

import os

#: SQL of each table; `r(k)` is a whole number that depends on the row and k.
TABLES = {
    "region": "SELECT i AS r_regionkey, 'R' || i AS r_name FROM range(5) t(i)",
    "nation": "SELECT i AS n_nationkey, 'N' || i AS n_name, i % 5 AS n_regionkey FROM range(25) t(i)",
    "customer": "SELECT i AS c_custkey, i % 25 AS c_nationkey FROM range(150) t(i)",
    "supplier": "SELECT i AS s_suppkey, i % 25 AS s_nationkey FROM range(10) t(i)",
    "part": "SELECT i AS p_partkey, 'P' || i AS p_name FROM range(200) t(i)",
    "orders": "SELECT i * 3 + 1 AS o_orderkey, r(i) % 150 AS o_custkey FROM range(500) t(i)",
    "lineitem": "SELECT (i // 4) * 3 + CASE WHEN i % 97 = 0 THEN 2 ELSE 1 END AS l_orderkey, r(i) % 200 AS l_partkey, r(i + 1) % 10 AS l_suppkey, i % 4 + 1 AS l_linenumber, (1 + r(i + 2) % 50)::DOUBLE AS l_quantity, (r(i + 3) % 9) / 100::DOUBLE AS l_tax, "
    "['A', 'N', 'R'][1 + r(i + 4) % 3] AS l_returnflag, ['O', 'F'][1 + r(i + 5) % 2] AS l_linestatus, DATE '1995-01-01' + CAST(r(i + 6) % 900 AS INTEGER) AS l_shipdate FROM range(1600) t(i)",
    "events": "SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_seconds(i * 60 + r(i) % 50) AS ts, 1 + r(i + 1) % 15 AS user_id, ['click', 'view', 'purchase', 'signup', 'error'][1 + r(i + 2) % 5] AS event_type, (r(i + 3) % 9000) / 100::DOUBLE AS value, '{\"k\": ' || (r(i + 4) % 100) || '}' AS props FROM range(1000) t(i)",
    "documents": "SELECT i AS doc_id, (SELECT string_agg('w' || (r(i * 31 + j) % 40) || ['', ',', '.'][1 + r(i + j) % 3], ' ' ORDER BY j) FROM range(r(i) % 120) u(j)) AS text, ['en', 'de'][1 + i % 2] AS lang, CASE WHEN i % 9 > 0 THEN 'src' || (i % 6) END AS source, i * 7 AS n_chars FROM range(150) t(i)",
    "embeddings": "SELECT i AS vec_id, [(r(i) % 100) / 100::FLOAT, (r(i + 1) % 100) / 100::FLOAT] AS embedding, i % 3 AS label FROM range(60) t(i)",
    "pages": "SELECT i AS page_id, 'https://h' || (r(i) % 7) || '.test/' || (r(i + 1) % 5) || '/x' || i AS url, '<p>' AS html FROM range(80) t(i)",
    "benchmark": "SELECT i AS item_id, 'w' || (r(i) % 50) || ' lengthyword' || i || ' w3 thewordisnotlong' AS text FROM range(12) t(i)",
    "labels": "SELECT i AS doc_id, CASE WHEN r(i) % 4 > 0 THEN 1 ELSE 0 END::INTEGER AS quality, CASE WHEN r(i + 1) % 5 = 0 THEN 1 ELSE 0 END::INTEGER AS toxic FROM range(0, 150, 2) t(i)",
    "conversations": "SELECT i // 3 AS conv_id, i % 3 AS turn, ['system', 'user', 'assistant'][1 + i % 3] AS role, 'text ' || i AS text FROM range(90) t(i)",
}


def write(folder: str) -> str:
    import duckdb

    c = duckdb.connect()
    c.execute("CREATE MACRO r(k) AS CAST((CAST(k AS BIGINT) * 7919 + 104729) % 1000003 * 31 % 65521 AS BIGINT)")
    for name, sql in TABLES.items():
        c.execute(f"COPY ({sql}) TO '{os.path.join(folder, name)}.parquet' (FORMAT parquet)")
    return folder
