"""From dissected rows to frames, events, conversations and streams.

facts() types each row once; all else is built on it. prepared() writes the facts with what their
flow and capture give each row (endpoints, direction, start, types of its events), so that the
tables below are one pass each over it; they take bare facts as well. A capture is one value of
capture_id, so many captures go through one plan. The order of a capture is its frame number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.columns import ms
from packetloom.operators import ordered
from packetloom.registry import EVENT_TYPES
from packetloom.schema import CONVERSATIONS, DISSECTED, EVENTS, FRAMES, STREAMS, column_of
from packetloom.stage import dropped, written

FLOW = ["capture_id", "transport", "stream_id"]
FLAGS = ["retransmission", "fast_retransmission", "spurious_retransmission", "out_of_order", "duplicate_ack", "zero_window", "lost_segment"]
STREAM_FRAMES = 50
#: Rows that belong to a flow with two endpoints.
FLOWING = "transport is not null and stream_id is not null and ip_src is not null and ip_dst is not null"


def _typed(have: set[str]) -> dict[str, str]:
    """SQL of each typed column. Written as text: a plan of some hundred expressions then costs
    one call and not thousands."""
    col = lambda f: f"nullif({column_of(f)}, '')" if column_of(f) in have else "CAST(NULL AS STRING)"
    first = lambda c: f"split_part({c}, ',', 1)"
    double = lambda v: f"CASE WHEN abs(try_cast({v} AS DOUBLE)) < 9e18 THEN try_cast({v} AS DOUBLE) END"  # noqa: E731  NaN is larger
    number = lambda c: double(first(c))
    whole = lambda c, kind="BIGINT": f"try_cast(coalesce(try_cast({first(c)} AS BIGINT), CAST({number(c)} AS BIGINT)) AS {kind})"
    truthy = lambda c: f"coalesce(concat(',', {c}, ',') RLIKE ',(1|true|True|TRUE),', false)"
    either = lambda *fs: f"coalesce({', '.join(map(col, fs))})"
    tcp = f"{col('tcp.stream')} IS NOT NULL"
    return {
        "capture_id": "capture_id" if "capture_id" in have else "'cap'",
        "frame_number": whole(col("frame.number")),
        "epoch": number(col("frame.time_epoch")),
        "len": f"coalesce({whole(col('frame.len'))}, 0L)",
        "transport": f"CASE WHEN {tcp} THEN 'tcp' WHEN {col('udp.stream')} IS NOT NULL THEN 'udp' END",
        "stream_id": whole(either("tcp.stream", "udp.stream")),
        "ip_src": f"coalesce({first(col('ip.src'))}, {first(col('ipv6.src'))})",
        "ip_dst": f"coalesce({first(col('ip.dst'))}, {first(col('ipv6.dst'))})",
        "src_port": whole(either("tcp.srcport", "udp.srcport"), "INT"),
        "dst_port": whole(either("tcp.dstport", "udp.dstport"), "INT"),
        "syn": f"{tcp} AND {truthy(col('tcp.flags.syn'))}",
        "ack": f"{tcp} AND {truthy(col('tcp.flags.ack'))}",
        "tcp_seq_raw": whole(col("tcp.seq_raw")),
        "tcp_ack_raw": whole(col("tcp.ack_raw")),
        "tcp_len": whole(col("tcp.len"), "INT"),
        "tcp_flags": first(col("tcp.flags.str")),
        "tcp_window": whole(col("tcp.window_size"), "INT"),
        "ack_rtt": number(col("tcp.analysis.ack_rtt")),
        "dup_ack_num": whole(col("tcp.analysis.duplicate_ack_num")),
        "tls_record_bytes": f"aggregate(split({col('tls.record.length')}, ','), 0L, (a, x) -> a + coalesce(CAST({double('x')} AS BIGINT), 0L))",
        "tls_types": f"split({col('tls.handshake.type')}, ',')",
        "tls_version": col("tls.handshake.version"),
        "tls_sni": col("tls.handshake.extensions_server_name"),
        "tls_ciphers": col("tls.handshake.ciphersuite"),
        "cert_lengths": col("tls.handshake.certificate_length"),
        "cert_name": first(either("x509sat.uTF8String", "x509sat.PrintableString")),
        "cert_dns": col("x509ce.dNSName"),
        "dns_id": f"try_cast(conv(regexp_replace({first(col('dns.id'))}, '^0[xX]', ''), 16, 10) AS BIGINT)",
        "dns_qname": first(col("dns.qry.name")),
        "dns_qtype": col("dns.qry.type"),
        "dns_response": f"CASE WHEN {col('dns.flags.response')} IS NOT NULL THEN {truthy(col('dns.flags.response'))} END",
        "dns_rcode": whole(col("dns.flags.rcode"), "INT"),
        "http_method": first(col("http.request.method")),
        "http_host": first(col("http.host")),
        "http_uri": first(col("http.request.uri")),
        "http_status": whole(col("http.response.code"), "INT"),
        "http_content_type": first(col("http.content_type")),
        "http_time": number(col("http.time")),
        "quic_streams": f"split({col('quic.stream.stream_id')}, ',')",
        "quic_direction": first(col("quic.stream.direction")),
        "quic_initiator": first(col("quic.stream.initiator")),
        "protocols": col("frame.protocols"),
    } | {flag: f"{tcp} AND {truthy(col(f'tcp.analysis.{flag}'))}" for flag in FLAGS}


def facts(rows: DataFrame) -> DataFrame:
    """Typed rows. Rows without a frame number or a finite time are dropped; absent columns
    are null; of comma lists in single-valued fields the first value counts."""
    assert all(column_of(x) for x in DISSECTED)
    return rows.selectExpr(*(f"{c} AS {n}" for n, c in _typed(set(rows.columns)).items())).filter("frame_number is not null and frame_number <> 0 and epoch is not null")


def _shaped(df: DataFrame, schema, made: dict[str, str]) -> DataFrame:
    """capture_id and the schema's columns, those in `made` by their SQL."""
    return df.selectExpr("capture_id", *(f"CAST({made.get(x.name, x.name)} AS {x.dataType.simpleString()}) AS {x.name}" for x in schema.fields))


def _ms(seconds: str) -> str:
    return f"round(({seconds}) * 1000, 3)"


def capture_times(f: DataFrame) -> DataFrame:
    """One row a capture: packet_count, first_epoch, last_epoch, data_size, duration_ms."""
    t = f.groupBy("capture_id").agg(F.count(F.lit(1)).alias("packet_count"), F.min("epoch").alias("first_epoch"), F.max("epoch").alias("last_epoch"), F.sum("len").alias("data_size"))
    return t.withColumn("duration_ms", ms(F.col("last_epoch") - F.col("first_epoch")))


def _from_start(f: DataFrame, times: DataFrame) -> DataFrame:
    """With t0, the first epoch of the capture. One row a capture: Spark broadcasts it while it
    is small, by its own size check."""
    return f.join(times.select("capture_id", F.col("first_epoch").alias("t0")), "capture_id")


def frames(f: DataFrame) -> DataFrame:
    """One row a frame."""
    made = {
        "time_ms": _ms("epoch - t0"), "ack_rtt_ms": _ms("ack_rtt"), "analysis": f"array_compact(array({', '.join(f"CASE WHEN {x} THEN '{x}' END" for x in FLAGS)}))",
        "tls_handshake_type": "try_cast(tls_types[0] AS INT)", "http_time_ms": _ms("http_time"),
    }
    return _shaped(f if "t0" in f.columns else _from_start(f, capture_times(f)), FRAMES, made)


def endpoints(f: DataFrame) -> DataFrame:
    """One row a flow: who began it, how that is known, its first pure SYN, and whether it lost
    a segment.

    Rows are aggregated by flow and pair of endpoints first (a hash aggregation over plain
    numbers with map-side combine), so even a flow that holds a third of all frames reaches
    the second aggregation as a few rows."""
    flows = f.filter(FLOWING)
    pure = F.when(F.col("syn") & ~F.col("ack"), F.col("frame_number"))
    ways = flows.groupBy(*FLOW, "ip_src", F.coalesce("src_port", F.lit(0)).alias("sport"), "ip_dst", F.coalesce("dst_port", F.lit(0)).alias("dport")).agg(
        F.min("frame_number").alias("frame"), F.min(pure).alias("syn_frame"), F.min_by(F.col("epoch"), pure).alias("syn_epoch"), F.max("syn").alias("any_syn"), F.max("lost_segment").alias("lost")
    )
    src, dst = F.struct(F.col("ip_src").alias("ip"), F.col("sport").alias("port")), F.struct(F.col("ip_dst").alias("ip"), F.col("dport").alias("port"))
    flow = ways.groupBy(*FLOW).agg(
        F.min(F.struct("frame", src.alias("src"), dst.alias("dst"))).alias("opening"), F.max("any_syn").alias("saw_syn"), F.max("lost").alias("lossy"),
        F.collect_list(F.struct(src.alias("src"), F.when(F.col("syn_frame").isNotNull(), F.struct("syn_frame", "syn_epoch")).alias("syn"))).alias("ways"),
    )
    begin, answer = F.col("opening.src"), F.col("opening.dst")
    ahead = F.filter("ways", lambda s: (s["src"] == begin) | (s["src"] != answer))
    syn = F.array_min(F.transform(ahead, lambda s: s["syn"]))
    swap = ~F.col("saw_syn") & (begin["port"] < 1024) & (answer["port"] >= 1024)
    return flow.select(
        *FLOW, begin.alias("begin"), answer.alias("answer"), swap.alias("swap"), syn["syn_frame"].alias("syn_frame"), syn["syn_epoch"].alias("syn_epoch"),
        F.when(F.col("saw_syn"), "handshake").when(swap, "port_heuristic").otherwise("first_packet").alias("direction_basis"), "lossy",
    )


def directed(f: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """Rows of flows with `ahead` (as the first packet went) and `forward` (from the initiator)."""
    if "forward" in f.columns:
        return f.filter(FLOWING)
    return _ways(f.filter(FLOWING).join(endpoints(f) if ends is None else ends, FLOW))


def _ways(rows: DataFrame) -> DataFrame:
    src = F.struct(F.col("ip_src").alias("ip"), F.coalesce("src_port", F.lit(0)).alias("port"))
    rows = rows.withColumn("ahead", (src == F.col("begin")) | (src != F.col("answer")))
    return rows.withColumn("forward", F.col("ahead") != F.col("swap"))


def prepared(rows: DataFrame) -> DataFrame:
    """The facts of dissected rows, written, with t0, kinds (the types of a row's events) and,
    for rows of flows, their endpoints and direction: the source is read once, and wide rows
    meet their endpoints once."""
    f = written(facts(rows), "facts")
    of = F.expr(FLOWING)
    ends = endpoints(f).withColumnRenamed("capture_id", "__c").withColumnsRenamed({k: f"__{k}" for k in FLOW[1:]})
    same = of & (F.col("capture_id") == F.col("__c")) & (F.col("transport") == F.col("__transport")) & (F.col("stream_id") == F.col("__stream_id"))
    out = _ways(f.join(ends, same, "left").drop("__c", "__transport", "__stream_id"))
    out = written(_from_start(out, capture_times(f)).selectExpr("*", f"{kinds_of_frame()} AS kinds"), "model")
    dropped(f)
    return out


#: What makes a row an event of a type, in the order of emission; TLS handshakes come where
#: their list has them.
_BEFORE = {
    "tcp_retransmission": "retransmission OR fast_retransmission OR spurious_retransmission", "tcp_out_of_order": "out_of_order", "tcp_dup_ack": "duplicate_ack",
    "tcp_zero_window": "zero_window", "tcp_missing_segment": "lost_segment",
}
_HANDSHAKES = {"1": "tls_client_hello", "2": "tls_server_hello", "11": "tls_certificate"}
_AFTER = {
    "http_request": "http_method IS NOT NULL", "http_response": "http_status IS NOT NULL", "dns_query": "dns_qname IS NOT NULL AND NOT coalesce(dns_response, false)",
    "dns_response": "dns_qname IS NOT NULL AND dns_response",
}
_LISTED = "size(split({0}, ','))"
#: The attributes of each type that a row itself has.
ATTRIBUTES = {
    "tcp_retransmission": {"variant": "CASE WHEN retransmission THEN 'plain' WHEN fast_retransmission THEN 'fast' ELSE 'spurious' END"},
    "tcp_dup_ack": {"dup_ack_count": "dup_ack_num"},
    "tls_client_hello": {"version": "tls_version", "sni": "tls_sni", "cipher_count": f"CASE WHEN tls_ciphers IS NOT NULL THEN {_LISTED.format('tls_ciphers')} END"},
    "tls_server_hello": {"version": "tls_version", "cipher": "tls_ciphers"},
    "tls_certificate": {"cn": "cert_name", "san_dns": "cert_dns", "cert_count": f"CASE WHEN cert_lengths IS NOT NULL THEN {_LISTED.format('cert_lengths')} END"},
    "http_request": {"method": "http_method", "host": "http_host", "uri": "http_uri"},
    "http_response": {"status_code": "http_status", "content_type": "http_content_type", "resp_time_ms": _ms("http_time")},
    "dns_query": {"dns_id": "dns_id", "qname": "dns_qname", "qtype": "dns_qtype"},
    "dns_response": {"dns_id": "dns_id", "qname": "dns_qname", "qtype": "dns_qtype", "rcode_num": "dns_rcode"},
}


def kinds_of_frame() -> str:
    """SQL of the types of a row's events in emission order: a narrow array, so attributes are
    made after it is exploded, for rows that have events."""
    some = lambda d: ", ".join(f"CASE WHEN {cond} THEN '{kind}' END" for kind, cond in d.items())
    tls = " ".join(f"WHEN '{t}' THEN '{kind}'" for t, kind in _HANDSHAKES.items())
    middle = f"CASE WHEN tls_types IS NULL THEN CAST(array() AS ARRAY<STRING>) ELSE transform(tls_types, t -> CASE t {tls} END) END"
    return f"array_compact(concat(array({some(_BEFORE)}), {middle}, array({some(_AFTER)})))"


def _attribute(name: str) -> str:
    cases = " ".join(f"WHEN '{kind}' THEN {attrs[name]}" for kind, attrs in ATTRIBUTES.items() if name in attrs)
    return f"CASE type {cases} END" if cases else "NULL"


def gaps(d: DataFrame) -> DataFrame:
    """For each lost-segment row the highest end of sequence seen before in its direction: a
    prefix scan over the flows that lost a segment, of only what the maximum needs."""
    lane = [*FLOW, "ahead"]
    base = F.when(F.col("syn"), F.col("tcp_seq_raw") + 1)
    end = F.when(F.col("tcp_len") > 0, F.col("tcp_seq_raw") + F.col("tcp_len"))
    mark = F.when(base.isNotNull() | end.isNotNull(), F.struct(base.alias("base")))
    slim = d.filter("lossy").select(*lane, "frame_number", "tcp_seq_raw", "lost_segment", base.alias("base"), end.alias("end"), mark.alias("mark"))
    seen = ordered.prefix(ordered.laid(slim, lane, ["frame_number"]), lane, prior=("max", F.col("end")), opened=("first", F.col("mark")))
    # a SYN sets the base only where nothing was seen before; its own row sees that base
    prior = F.greatest("prior", F.when(F.col("opened").isNotNull(), F.col("opened.base")).otherwise(F.col("base")))
    return seen.filter("lost_segment").select("capture_id", "frame_number", prior.alias("prior_end"), F.col("tcp_seq_raw").alias("lost_seq"))


def events(f: DataFrame, ends: DataFrame | None = None, compat_ids: bool = True, types: tuple[str, ...] | None = None) -> DataFrame:
    """One row an event, numbered by (time, frame, emission) within each capture, in ranges of
    that order: no task sorts a capture, whatever its times. With compat_ids False the id is
    evt:<frame>.<emission>, which needs no sort at all and orders alike wherever time does.
    With types only events of these are made, and their numbers count only them."""
    d = directed(f, ends)
    attrs = [x.name[5:] for x in EVENTS.fields if x.name.startswith("attr_") and x.name not in ("attr_origin", "attr_gap_bytes")]
    out = d.selectExpr("*", f"posexplode({'kinds' if 'kinds' in d.columns else kinds_of_frame()}) AS (emission, type)")
    if types is not None:
        out = out.filter(F.col("type").isin(*types))
    out = (out if "t0" in out.columns else _from_start(out, capture_times(f))).selectExpr("capture_id", "transport", "stream_id", "frame_number", "epoch", "t0", "forward", "emission", "type", *(f"{_attribute(a)} AS attr_{a}" for a in attrs))
    missing = "type = 'tcp_missing_segment'"
    if types is None or "tcp_missing_segment" in types:
        # few rows: only lost-segment events take the scan's result
        out = out.join(gaps(d), ["capture_id", "frame_number"], "left")
    else:
        out = out.selectExpr("*", "CAST(NULL AS BIGINT) AS prior_end", "CAST(NULL AS BIGINT) AS lost_seq")
    if compat_ids:
        out = ordered.numbered(out, ["capture_id"], ["epoch", "frame_number", "transport", "stream_id", "emission"])
    made = {
        "event_id": "format_string('evt:%06d', number)" if compat_ids else "format_string('evt:%d.%d', frame_number, emission)",
        "conversation_id": "concat('conv:', transport, ':', stream_id)", "time_ms": _ms("epoch - t0"),
        "detection": f"CASE type {' '.join(f"WHEN '{t.name}' THEN '{t.detection}'" for t in EVENT_TYPES.values())} END",
        "direction": "CASE WHEN forward THEN 'initiator_to_responder' ELSE 'responder_to_initiator' END",
        "attr_origin": f"CASE WHEN {missing} THEN CASE WHEN lost_seq IS NOT NULL AND prior_end IS NULL THEN 'capture_start' ELSE 'mid_stream' END END",
        "attr_gap_bytes": f"CASE WHEN {missing} AND lost_seq > prior_end THEN lost_seq - prior_end END",
    }
    return _shaped(out, EVENTS, made)


def conversation_id() -> Column:
    return F.concat(F.lit("conv:"), F.col("transport"), F.lit(":"), F.col("stream_id").cast("string"))


#: When a flow begins and ends: its first and last frame, or an event outside of them.
_E0 = "least(min_by(epoch, frame_number), min(CASE WHEN size(kinds) > 0 THEN epoch END))"
_E1 = "greatest(max_by(epoch, frame_number), max(CASE WHEN size(kinds) > 0 THEN epoch END))"


def conversations(f: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """One row a flow. What is fixed for a flow is in the grouping key, so the aggregation over
    all rows is a hash aggregation of plain numbers; medians (picked from samples laid in order)
    and distinct streams run over the few rows that have them and are joined by the same key."""
    d = directed(f, ends)
    d = d if "kinds" in d.columns else _from_start(d, capture_times(f)).selectExpr("*", f"{kinds_of_frame()} AS kinds")
    total = lambda cond, c: f"coalesce(sum(CASE WHEN {cond} THEN {c} END), 0L)"
    of = lambda kind: f"coalesce(sum(size(filter(kinds, k -> k = '{kind}'))), 0L)"
    first = lambda cond: f"min_by(epoch, CASE WHEN {cond} THEN frame_number END)"
    payload = "transport = 'tcp' AND tcp_len > 0"
    sums = {
        "e0": _E0, "e1": _E1,
        "packets_forward": "count_if(forward)", "packets_reverse": "count_if(NOT forward)", "bytes_forward": total("forward", "len"), "bytes_reverse": total("NOT forward", "len"),
        "payload_bytes_forward": total(f"forward AND {payload}", "tcp_len"), "payload_bytes_reverse": total(f"NOT forward AND {payload}", "tcp_len"), "tls_app_bytes": total("tls_record_bytes > 0", "tls_record_bytes"),
        "retransmission_count": of("tcp_retransmission"), "missing_segment_count": of("tcp_missing_segment"), "dup_ack_count": of("tcp_dup_ack"), "http_txn_count": of("http_request"),
        "dns_query_count": of("dns_query"), "tls_handshake_count": of("tls_client_hello"), "rtt_max": "max(CASE WHEN ack_rtt >= 0 THEN ack_rtt END)",
        "done_epoch": first("ahead AND ack AND NOT syn AND frame_number > syn_frame"), "hello": first("array_contains(kinds, 'tls_client_hello')"), "answered": first("array_contains(kinds, 'tls_server_hello')"),
        "tls": "bool_or(array_contains(kinds, 'tls_client_hello') OR array_contains(kinds, 'tls_server_hello'))", "dns": "bool_or(array_contains(kinds, 'dns_query') OR array_contains(kinds, 'dns_response'))",
        "http": "bool_or(array_contains(kinds, 'http_request') OR array_contains(kinds, 'http_response'))",
    }
    a = d.groupBy(*FLOW, "begin", "answer", "swap", "direction_basis", "t0", "syn_epoch").agg(*(F.expr(c).alias(n) for n, c in sums.items()))
    samples = ordered.median(f.filter("ack_rtt >= 0 and transport is not null and stream_id is not null"), FLOW, "ack_rtt", "rtt_median")
    ids = f.filter("quic_streams is not null").selectExpr(*FLOW, "explode(quic_streams) AS sid").groupBy(*FLOW).agg(F.expr(f"count(DISTINCT {_WHOLE})").alias("quic"))
    a = a.join(samples, FLOW, "left").join(ids, FLOW, "left").fillna(0, ["quic"])
    who, other = "(CASE WHEN swap THEN answer ELSE begin END)", "(CASE WHEN swap THEN begin ELSE answer END)"
    both = "(bytes_forward + bytes_reverse)"
    made = {
        "conversation_id": "concat('conv:', transport, ':', stream_id)", "initiator_ip": f"{who}.ip", "initiator_port": f"{who}.port", "responder_ip": f"{other}.ip", "responder_port": f"{other}.port",
        "start_ms": _ms("e0 - t0"), "duration_ms": _ms("e1 - e0"), "packets_total": "packets_forward + packets_reverse", "bytes_total": both,
        "rtt_median_ms": _ms("rtt_median"), "rtt_max_ms": _ms("rtt_max"), "throughput_bps": f"CASE WHEN e1 > e0 THEN floor({both} * 8 / (e1 - e0) + 0.5) END",
        "tcp_handshake_ms": _ms("done_epoch - syn_epoch"), "tls_handshake_ms": _ms("answered - hello"), "quic_stream_count": "quic",
        "protocol_tags": "array_compact(array(transport, CASE WHEN tls THEN 'tls' END, CASE WHEN dns THEN 'dns' END, CASE WHEN http THEN 'http' END, CASE WHEN quic > 0 THEN 'quic' END))",
    }
    return _shaped(a, CONVERSATIONS, made)


def spans(f: DataFrame) -> DataFrame:
    """(capture_id, conversation_id, start_ms, duration_ms) of each flow: a narrow aggregate where
    nothing else of conversations() is asked for."""
    d = directed(f)
    d = d if "kinds" in d.columns else _from_start(d, capture_times(f)).selectExpr("*", f"{kinds_of_frame()} AS kinds")
    a = d.groupBy(*FLOW, "t0").agg(F.expr(_E0).alias("e0"), F.expr(_E1).alias("e1"))
    return a.selectExpr("capture_id", "concat('conv:', transport, ':', stream_id) AS conversation_id", f"{_ms('e0 - t0')} AS start_ms", f"{_ms('e1 - e0')} AS duration_ms")


#: A stream's number, as text in `sid`.
_WHOLE = "CASE WHEN abs(try_cast(sid AS DOUBLE)) < 9e18 THEN CAST(try_cast(sid AS DOUBLE) AS BIGINT) END"


def streams(f: DataFrame) -> DataFrame:
    """One row a multiplexed stream of a flow; each mention in a row counts. The first
    STREAM_FRAMES frames are kept as evidence."""
    t = f.filter(f"quic_streams is not null and {FLOWING}")
    t = t if "t0" in f.columns else _from_start(t, capture_times(f))
    each = t.selectExpr("capture_id", "concat('conv:', transport, ':', stream_id) AS conversation_id", "frame_number", "epoch", "t0", "len", "quic_direction", "quic_initiator", "posexplode(quic_streams) AS (pos, sid)")
    each = each.withColumn("sid", F.expr(_WHOLE)).filter("sid is not null")
    begin = F.min(F.struct("frame_number", "pos", "epoch", "quic_direction", "quic_initiator"))
    key = ["capture_id", "conversation_id", "sid"]
    kept = ordered.first(each.select(*key, "frame_number", "pos"), key, ["frame_number", "pos"], STREAM_FRAMES)
    lists = kept.groupBy(*key).agg(F.sort_array(F.collect_list("frame_number")).alias("evidence_frames"))
    a = each.groupBy("capture_id", "conversation_id", "sid").agg(begin.alias("b"), F.max(F.struct("frame_number", "epoch"))["epoch"].alias("e1"), F.count(F.lit(1)).alias("packets"), F.sum("len").alias("bytes"), F.first("t0").alias("t0"))
    a = a.join(lists, ["capture_id", "conversation_id", "sid"])
    made = {"stream_id": "sid", "stream_direction": "b.quic_direction", "initiator": "b.quic_initiator", "start_ms": _ms("b.epoch - t0"), "duration_ms": _ms("e1 - b.epoch")}
    return _shaped(a, STREAMS, made)


def of_conversation(df: DataFrame, cid: str) -> DataFrame:
    """Rows (facts or frames) of one conversation, by columns that reach a Parquet scan."""
    _, transport, stream = cid.split(":")
    return df.filter((F.col("transport") == transport) & (F.col("stream_id") == int(stream)))


def frame_refs(ev: DataFrame, st: DataFrame) -> DataFrame:
    """Which frames back an event or a stream."""
    a = ev.select("capture_id", F.lit("event").alias("owner_type"), F.col("event_id").alias("owner_id"), "frame_number")
    owner = F.concat("conversation_id", F.lit("/stream/"), F.col("stream_id").cast("string"))
    b = st.select("capture_id", F.lit("stream").alias("owner_type"), owner.alias("owner_id"), F.explode("evidence_frames").alias("frame_number"))
    return a.unionByName(b)
