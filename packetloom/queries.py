"""Queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom import model_queries
from packetloom.operators import index, ordered, pairing, timeseries
from packetloom.plans import dsl, rawfilter, sqlgate
from packetloom.schema import DISSECTED, column_of
from packetloom.sources import tables as b

QUERIES: dict = {}
SQL: dict[str, str] = {}
E_, C_ = f"WITH {b.EVENTS_SQL} ", f"WITH {b.CONVERSATIONS_SQL} "


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def col(name: str):
    return F.col(name)


#: Views of delegated SQL: a table by its name, or the events in their role.
ROLES = {"b_events": b.events}


def delegated(name: str, sql: str, *tables: str, oracle: str | None = None, doc: str = "") -> None:
    """Register SQL that goes through the gate: checked, and over views of these tables alone."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        made = {t: ROLES[t](spark, d) if t in ROLES else b.table(spark, d, t) for t in tables}
        return sqlgate.plan(sqlgate.own_session(spark, made), sql, set(tables))

    run.__doc__ = doc
    text = oracle or sql
    QUERIES[name], SQL[name] = run, E_ + text if "b_events" in tables else text


# --- scans and counts ---


delegated("scan_counts", "SELECT 'events' AS name, count(*) AS n FROM events UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'pages', count(*) FROM pages", "events", "lineitem", "orders", "pages")


# --- predicates of the query language ---


def _filtered(kind: str, field: str, op: str, value):
    def run(spark, d):
        return b.events(spark, d).filter(dsl.condition(col(field), kind, op, value)).select("event_id", "type", "nvalue")

    return run


for _name, _kind, _field, _op, _value, _sql in (
    ("filter_eq", "string", "type", "eq", "error", "type = 'error'"),
    ("filter_eq_number", "number", "frame_number", "eq", 17, "frame_number = 17"),
    ("filter_ne_null", "number", "nvalue", "ne", 5.0, "nvalue IS DISTINCT FROM 5.0"),
    ("filter_gt", "number", "nvalue", "gt", 50, "coalesce(nvalue > 50, false)"),
    ("filter_lte", "number", "nvalue", "lte", 3, "coalesce(nvalue <= 3, false)"),
    ("filter_in_null", "number", "nvalue", "in", [5.0, 7.5], "nvalue IS NULL OR nvalue IN (5.0, 7.5)"),
    ("filter_in_with_null", "string", "type", "in", ["click", None], "coalesce(type IN ('click'), false)"),
    ("filter_contains_str", "string", "conversation_id", "contains", ":1", "contains(coalesce(conversation_id, ''), ':1')"),
):
    QUERIES[_name] = _filtered(_kind, _field, _op, _value)
    SQL[_name] = E_ + f"SELECT event_id, type, nvalue FROM b_events WHERE {_sql}"


@query("SELECT doc_id FROM documents WHERE list_contains(string_split(lower(text), ' '), 'the')")
def filter_contains_arr(spark, d):
    return b.table(spark, d, "documents").filter(dsl.condition(F.split(F.lower("text"), " "), "string[]", "contains", "the")).select("doc_id")


@query(E_ + "SELECT event_id FROM b_events WHERE type = 'purchase' AND coalesce(nvalue > 10, false) AND forward = false")
def filter_and(spark, d):
    e = b.events(spark, d)
    return e.filter(dsl.condition(col("type"), "string", "eq", "purchase") & dsl.condition(col("nvalue"), "number", "gt", 10) & ~col("forward")).select("event_id")


# --- projection, order, paging ---


def _page(q: dict):
    def run(spark, d):
        c = b.conversations(spark, d).withColumn("transport", F.lit("udp"))
        return dsl.compile_query(q, c).page

    return run


_SELECT = ["conversation_id", "retransmission_count", "rtt_median_ms", "bytes_total"]
for _name, _q, _sql in (
    ("retransmissions_first", {"where": [{"field": "retransmission_count", "op": "gt", "value": 0}], "order_by": [{"field": "retransmission_count", "direction": "desc"}], "limit": 200}, "WHERE retransmission_count > 0 ORDER BY retransmission_count DESC, length(conversation_id), conversation_id LIMIT 200"),
    ("page_offset", {"order_by": [{"field": "bytes_total", "direction": "desc"}], "limit": 20, "offset": 10}, "ORDER BY bytes_total DESC, length(conversation_id), conversation_id LIMIT 20 OFFSET 10"),
    ("sort_multi", {"order_by": [{"field": "retransmission_count", "direction": "asc"}, {"field": "bytes_total", "direction": "desc"}], "limit": 50}, "ORDER BY retransmission_count, bytes_total DESC, length(conversation_id), conversation_id LIMIT 50"),
    ("topk_bytes", {"order_by": [{"field": "bytes_total", "direction": "desc"}], "limit": 3}, "ORDER BY bytes_total DESC, length(conversation_id), conversation_id LIMIT 3"),
    ("top10_overview", {"order_by": [{"field": "bytes_total", "direction": "desc"}], "limit": 10}, "ORDER BY bytes_total DESC, length(conversation_id), conversation_id LIMIT 10"),
):
    QUERIES[_name] = _page({"scope": "conversation", "select": _SELECT} | _q)
    SQL[_name] = C_ + f"SELECT {', '.join(_SELECT)} FROM b_convs {_sql}"


def _ordered(spark, d, *order):
    """Every row with its place, given in ranges of the order."""
    return ordered.numbered(b.events(spark, d).select("event_id", "nvalue"), [], list(order), "place")


@query(E_ + "SELECT event_id, nvalue, row_number() OVER (ORDER BY nvalue ASC NULLS LAST, event_id) AS place FROM b_events")
def sort_nulls_asc_whole(spark, d):
    return _ordered(spark, d, col("nvalue").asc_nulls_last(), "event_id")


@query(E_ + "SELECT event_id, nvalue, row_number() OVER (ORDER BY nvalue DESC NULLS FIRST, event_id) AS place FROM b_events")
def sort_nulls_desc_whole(spark, d):
    return _ordered(spark, d, col("nvalue").desc_nulls_first(), "event_id")


# --- time series ---


@query(C_ + "SELECT conversation_id, (SELECT min(w) FROM (SELECT 100.0::DOUBLE * power(2, i) AS w FROM range(60) t(i)) WHERE duration_ms / w <= 500) AS width FROM b_convs")
def timeseries_autowiden(spark, d):
    return b.conversations(spark, d).select("conversation_id", timeseries.widened(col("duration_ms"), 100).alias("width"))


# --- pairing ---


@query(E_ + """, q AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY time_ms, frame_number) AS rn FROM b_events WHERE type = 'click'),
r AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY time_ms, frame_number) AS rn FROM b_events WHERE type = 'purchase')
SELECT q.conversation_id, q.frame_number AS request_frame, r.frame_number AS response_frame, round(r.time_ms - q.time_ms, 3) AS resp_time_ms FROM q LEFT JOIN r USING (conversation_id, rn)""")
def http_pairs_left(spark, d):
    e = b.events(spark, d)
    p = pairing.by_ordinal(e.filter("type = 'click'"), e.filter("type = 'purchase'"), ["conversation_id"], ["time_ms", "frame_number"])
    return p.select("conversation_id", col("request.frame_number").alias("request_frame"), col("response.frame_number").alias("response_frame"), F.round(col("response.time_ms") - col("request.time_ms"), 3).alias("resp_time_ms"))


@query(E_ + """, s AS (SELECT *, CASE type WHEN 'click' THEN 1 ELSE -1 END AS step FROM b_events WHERE type IN ('click', 'purchase')),
w AS (SELECT *, sum(step) OVER (PARTITION BY conversation_id ORDER BY time_ms, frame_number) AS bal FROM s),
l AS (SELECT *, least(0, coalesce(min(bal) OVER (PARTITION BY conversation_id ORDER BY time_ms, frame_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS low FROM w),
k AS (SELECT *, row_number() OVER (PARTITION BY conversation_id, step ORDER BY time_ms, frame_number) AS k FROM l WHERE step = 1 OR bal >= low)
SELECT q.conversation_id, q.frame_number AS request_frame, r.frame_number AS response_frame FROM k q LEFT JOIN k r ON q.conversation_id = r.conversation_id AND q.k = r.k AND r.step = -1 WHERE q.step = 1""")
def http_fifo_no_orphans(spark, d):
    p = pairing.fifo(b.events(spark, d), ["conversation_id"], ["time_ms", "frame_number"], "type = 'click'", "type = 'purchase'")
    return p.select("conversation_id", col("request.frame_number").alias("request_frame"), col("response.frame_number").alias("response_frame"))


# --- sets ---


for _name in ("UNION", "UNION ALL", "INTERSECT", "EXCEPT", "EXCEPT ALL", "INTERSECT ALL"):
    delegated(f"set_{_name.lower().replace(' ', '_')}", f"SELECT user_id FROM events WHERE event_type = 'signup' {_name} SELECT user_id FROM events WHERE event_type = 'error'", "events")
delegated("distinct_frames", "SELECT DISTINCT l_suppkey AS src, l_returnflag FROM lineitem", "lineitem")

# --- windows ---

_W = "OVER (PARTITION BY conversation_id ORDER BY time_ms, frame_number)"
for _name, _sql in (
    ("win_row_number", f"row_number() {_W} AS rn"),
    ("win_lag_lead", f"lag(type) {_W} AS before, lead(frame_number, 2) {_W} AS after"),
    ("win_range_frame", "count(*) OVER (PARTITION BY conversation_id ORDER BY frame_number RANGE BETWEEN 1000 PRECEDING AND CURRENT ROW) AS near"),
    ("win_ntile", f"ntile(4) {_W} AS part"),
):
    delegated(_name, f"SELECT event_id, {_sql} FROM b_events", "b_events")
delegated(
    "win_first_last", f"SELECT event_id, first_value(frame_number) {_W} AS first_frame, last_value(nvalue) IGNORE NULLS {_W} AS last_seen FROM b_events", "b_events",
    oracle=f"SELECT event_id, first_value(frame_number) {_W} AS first_frame, last_value(nvalue IGNORE NULLS) {_W} AS last_seen FROM b_events",
)
delegated("win_rank_topn", "SELECT conversation_id, event_id, rank() OVER (PARTITION BY conversation_id ORDER BY value DESC, event_id) AS r FROM b_events QUALIFY r <= 3".replace("QUALIFY r", "QUALIFY rank() OVER (PARTITION BY conversation_id ORDER BY value DESC, event_id)"), "b_events")

# --- aggregations ---

delegated("agg_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1", "lineitem")
delegated("agg_filter", "SELECT l_linestatus, count(*) FILTER (WHERE l_returnflag = 'R') AS back, CAST(sum(l_quantity) FILTER (WHERE l_returnflag <> 'R') AS BIGINT) AS ahead FROM lineitem GROUP BY 1", "lineitem")
for _name, _kind in (("agg_grouping_sets", "GROUPING SETS ((l_returnflag), (l_linestatus), ())"), ("agg_cube", "CUBE (l_returnflag, l_linestatus)"), ("agg_rollup", "ROLLUP (l_returnflag, l_linestatus)")):
    delegated(_name, f"SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS bytes FROM lineitem GROUP BY {_kind}", "lineitem")

# --- joins ---

_FL, _FR = "(SELECT o_orderkey, o_custkey FROM orders) o", "(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem) l"
for _how, _sql in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("full_outer", "FULL JOIN"), ("left_semi", "SEMI JOIN"), ("left_anti", "ANTI JOIN")):
    delegated(f"join_{_how}_whole", f"SELECT * FROM {_FL} {_sql} {_FR} ON o_orderkey = l_orderkey", "orders", "lineitem", doc="Whole tables, a flow with its frames; orders without lines are unmatched by nature.")


@query("SELECT r_name, count(*) AS n FROM region, nation WHERE r_regionkey <> n_regionkey GROUP BY r_name")
def join_theta(spark, d):
    """Two dimension tables of fixed size; each pair is counted, none is kept."""
    r, n = b.table(spark, d, "region"), b.table(spark, d, "nation")
    per = n.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"))
    total = per.select(F.sum("n")).scalar()
    return r.join(per, col("r_regionkey") == col("n_regionkey"), "left").select("r_name", (total - F.coalesce("n", F.lit(0))).alias("n"))


delegated("asof_join", "SELECT p.frame_number, v.frame_number AS view_frame FROM (SELECT * FROM b_events WHERE type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM b_events WHERE type = 'view') v ON p.conversation_id = v.conversation_id AND p.time_ms >= v.time_ms", "b_events")
delegated("lateral_explode", "SELECT page_id, part FROM pages, LATERAL (SELECT unnest(string_split(url, '/')) AS part) WHERE part <> ''", "pages")
delegated("recursive_cte", "WITH RECURSIVE t(n, total) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, total + n + 1 FROM t WHERE n < 50) SELECT n, total, count(l_orderkey) AS lines FROM t LEFT JOIN lineitem ON CAST(l_quantity AS INT) = n GROUP BY n, total", "lineitem")
delegated(
    "pivot_counts", "SELECT l_returnflag, coalesce(open, 0) AS o, coalesce(done, 0) AS f FROM (SELECT l_returnflag, l_linestatus FROM lineitem) PIVOT (count(*) FOR l_linestatus IN ('O' AS open, 'F' AS done))", "lineitem",
    oracle="SELECT l_returnflag, O AS o, F AS f FROM (PIVOT (SELECT l_returnflag, l_linestatus FROM lineitem) ON l_linestatus IN ('O', 'F') USING count(*) GROUP BY l_returnflag)",
)

# --- index ---


@query(r"""WITH p AS (SELECT string_split(regexp_replace(regexp_extract(url, '://([^?#]*)', 1), '/+$', ''), '/') AS parts, length(url) AS size FROM pages),
x AS (SELECT array_to_string(parts[1:i], '/') AS path, i - 1 AS depth, size FROM p, LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i))
SELECT path, CAST(depth AS INTEGER) AS depth, count(*) AS frames, CAST(sum(size) AS BIGINT) AS bytes FROM x GROUP BY path, depth""")
def protocol_hierarchy(spark, d):
    path = F.regexp_replace(F.regexp_extract("url", "://([^?#]*)", 1), "/+$", "")
    p = b.table(spark, d, "pages").select(path.alias("path_"), F.length("url").cast("bigint").alias("size"))
    return index.hierarchy(p, "path_", "size", "/").select("path", "depth", "frames", "bytes")


QUERIES.update(model_queries.QUERIES)
SQL.update(model_queries.SQL)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Conversations with retransmission-like events, most first."""
    return QUERIES["retransmissions_first"](spark, d)


X_ = f"WITH {b.DISSECTED_SQL} "


def _displayed(spark, d):
    """A display filter over dissected rows: the parsed filter reaches the scan as one predicate."""
    rows = b.dissected(spark, d)
    known = [f for f in DISSECTED if column_of(f) in rows.columns]
    keep = rawfilter.Parser("tcp && (tcp.flags.syn == 1 || frame.len > 100) and not (tcp.analysis.retransmission)", known).parse()
    rows = rows.filter(keep)
    return rows.select(F.col("frame_number").cast("bigint").alias("frame_number"), F.lit("tcp").alias("transport"), F.coalesce(F.col("ip_src"), F.col("ipv6_src")).rlike("^(10[.]|fd00)").alias("out"))


@query(X_ + "SELECT frame AS frame_number, 'tcp' AS transport, outward AS out FROM f WHERE tcp AND (syn OR len > 100) AND NOT plain")
def raw_display_filter_whole(spark, d):
    return _displayed(spark, d)
