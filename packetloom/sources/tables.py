"""Test tables bound to the roles of events, conversations, frames and turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.operators.extract import conversation_id


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts):
    return F.unix_micros(ts.cast("timestamp"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flow a user; the first instant of the table is the start of the capture."""
    e = table(spark, sf_dir, "events")
    start = e.select(F.min(micros(F.col("ts")))).scalar()
    return e.select(
        "event_id", F.concat(F.lit("conv:udp:"), F.col("user_id").cast("string")).alias("conversation_id"), F.col("event_type").alias("type"),
        F.round((micros(F.col("ts")) - start) / 1000, 3).alias("time_ms"), (F.col("event_id") + 1).alias("frame_number"),
        F.col("event_type").isin("click", "view", "signup").alias("forward"), "value", F.when(F.col("value") >= 1, F.col("value")).alias("nvalue"),
        F.get_json_object("props", "$.k").cast("bigint").alias("attr_k"),
    )


#: The same in SQL, as a CTE.
EVENTS_SQL = """b_events AS (
  SELECT event_id, 'conv:udp:' || CAST(user_id AS VARCHAR) AS conversation_id, event_type AS type,
         round((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 1000::DOUBLE, 3) AS time_ms, event_id + 1 AS frame_number,
         event_type IN ('click', 'view', 'signup') AS forward, value, CASE WHEN value >= 1 THEN value END AS nvalue,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS attr_k
  FROM events)"""


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a user, with the metrics of a conversation; `error` stands for a retransmission."""
    e = events(spark, sf_dir)
    fwd = F.col("forward")
    n = lambda c: F.count_if(c).cast("bigint")
    return e.groupBy("conversation_id").agg(
        F.min("time_ms").alias("start_ms"), F.round(F.max("time_ms") - F.min("time_ms"), 3).alias("duration_ms"),
        n(fwd).alias("packets_forward"), n(~fwd).alias("packets_reverse"), F.count(F.lit(1)).alias("packets_total"),
        F.coalesce(F.sum(F.when(fwd, F.floor("value"))), F.lit(0)).cast("bigint").alias("bytes_forward"), F.coalesce(F.sum(F.when(~fwd, F.floor("value"))), F.lit(0)).cast("bigint").alias("bytes_reverse"),
        F.sum(F.floor("value")).cast("bigint").alias("bytes_total"), n(F.col("type") == "error").alias("retransmission_count"),
        F.round(F.median("nvalue"), 4).alias("rtt_median_ms"), F.round(F.max("nvalue"), 4).alias("rtt_max_ms"),
    )


CONVERSATIONS_SQL = (
    EVENTS_SQL
    + """, b_convs AS (
  SELECT conversation_id, min(time_ms) AS start_ms, round(max(time_ms) - min(time_ms), 3) AS duration_ms,
         count(*) FILTER (forward) AS packets_forward, count(*) FILTER (NOT forward) AS packets_reverse, count(*) AS packets_total,
         CAST(coalesce(sum(floor(value)) FILTER (forward), 0) AS BIGINT) AS bytes_forward, CAST(coalesce(sum(floor(value)) FILTER (NOT forward), 0) AS BIGINT) AS bytes_reverse,
         CAST(sum(floor(value)) AS BIGINT) AS bytes_total, count(*) FILTER (type = 'error') AS retransmission_count,
         round(median(nvalue), 4) AS rtt_median_ms, round(max(nvalue), 4) AS rtt_max_ms
  FROM b_events GROUP BY conversation_id)"""
)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flow an order, one frame a line; returned lines go back."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select(
        F.lit("cap").alias("capture_id"), F.lit("tcp").alias("transport"), F.col("l_orderkey").alias("stream_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("frame_number"),
        F.col("l_quantity").cast("bigint").alias("len"), (F.col("l_returnflag") == "R").alias("back"), F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), "l_linenumber", "l_shipdate",
    )


def flow_id():
    return conversation_id()


#: Dissected rows that stand for the events table: a user is a flow (TCP for even ids), event
#: types stand for what a frame holds, the number k of the properties for the rest. Column
#: names are those of dissected rows; base columns come from _BASE.
_CLIENT, _SERVER = "concat('10.0.0.', u)", "'192.168.0.1'"
_FIELDS = {
    "frame_number": "string(frame)", "frame_time_epoch": "concat(us div 1000000, '.', lpad(us % 1000000, 6, '0'))", "frame_len": "string(60 + k)",
    "ip_src": f"CASE WHEN NOT six THEN CASE WHEN outward THEN {_CLIENT} ELSE {_SERVER} END END", "ip_dst": f"CASE WHEN NOT six THEN CASE WHEN outward THEN {_SERVER} ELSE {_CLIENT} END END",
    "ipv6_src": "CASE WHEN six THEN CASE WHEN outward THEN concat('fd00::', u, ',fd00::9') ELSE 'fd01::1' END END", "ipv6_dst": "CASE WHEN six THEN CASE WHEN outward THEN 'fd01::1' ELSE concat('fd00::', u) END END",
    "tcp_stream": "CASE WHEN tcp THEN string(u) END", "udp_stream": "CASE WHEN udp THEN string(u) END",
    "tcp_srcport": "CASE WHEN tcp THEN string(if(outward, cport, sport)) END", "tcp_dstport": "CASE WHEN tcp THEN string(if(outward, sport, cport)) END",
    "udp_srcport": "CASE WHEN udp THEN string(if(outward, cport, sport)) END", "udp_dstport": "CASE WHEN udp THEN string(if(outward, sport, cport)) END",
    "tcp_flags_syn": "CASE WHEN tcp THEN if(kind = 'signup' AND u % 3 <> 0, 'True', 'False') END", "tcp_flags_ack": "CASE WHEN tcp THEN if(kind <> 'signup' OR k % 2 = 0, '1', '0') END",
    "tcp_flags_str": "CASE WHEN tcp THEN concat('flags', k % 3) END", "tcp_seq_raw": "CASE WHEN tcp THEN string(k * 100) END", "tcp_ack_raw": "CASE WHEN tcp THEN string(k * 10) END",
    "tcp_len": "CASE WHEN tcp THEN string(floor(value)) END", "tcp_window_size": "CASE WHEN tcp THEN string(1000 + k) END", "tcp_analysis_ack_rtt": "CASE WHEN tcp AND kind = 'click' THEN string(k / 1000) END",
    "tcp_analysis_retransmission": "CASE WHEN tcp AND kind = 'error' AND k % 3 = 0 THEN 'True' END", "tcp_analysis_fast_retransmission": "CASE WHEN tcp AND kind = 'error' AND k % 3 = 1 THEN '1' END",
    "tcp_analysis_spurious_retransmission": "CASE WHEN tcp AND kind = 'error' AND k % 3 = 2 THEN 'true' END", "tcp_analysis_out_of_order": "CASE WHEN tcp AND k % 7 = 0 THEN '1' END",
    "tcp_analysis_duplicate_ack": "CASE WHEN tcp AND k % 11 = 3 THEN '1,1' END", "tcp_analysis_duplicate_ack_num": "CASE WHEN tcp AND k % 11 = 3 THEN string(k % 5) END",
    "tcp_analysis_zero_window": "CASE WHEN tcp AND value < 1 THEN '1,1' END", "tcp_analysis_lost_segment": "CASE WHEN tcp AND k > 90 THEN 'True' END",
    "tls_record_length": "CASE WHEN tcp AND kind IN ('view', 'purchase') THEN concat(k, ',5,x') END", "tls_handshake_type": "CASE WHEN tcp AND kind = 'signup' THEN if(k % 4 = 0, '1,2,11', '1,2') END",
    "tls_handshake_version": "CASE WHEN tcp AND kind = 'signup' THEN '0x0303' END", "tls_handshake_extensions_server_name": "CASE WHEN tcp AND kind = 'signup' THEN concat('h', k, '.test') END",
    "tls_handshake_ciphersuite": "CASE WHEN tcp AND kind = 'signup' THEN '0x1301,0x1302,0x1303' END", "tls_handshake_certificate_length": "CASE WHEN tcp AND kind = 'signup' AND k % 4 = 0 THEN '900,800' END",
    "x509sat_uTF8String": "CASE WHEN tcp AND kind = 'signup' AND k % 8 = 0 THEN 'CN one,CN two' END", "x509sat_PrintableString": "CASE WHEN tcp AND kind = 'signup' THEN 'printable' END",
    "x509ce_dNSName": "CASE WHEN tcp AND kind = 'signup' AND k % 4 = 0 THEN 'a.test,b.test' END",
    "dns_id": "CASE WHEN udp AND kind IN ('click', 'purchase') THEN concat('0x', lower(hex(k))) END", "dns_qry_name": "CASE WHEN udp AND kind IN ('click', 'purchase') THEN concat('n', k, '.test') END",
    "dns_qry_type": "CASE WHEN udp AND kind IN ('click', 'purchase') THEN '1' END", "dns_flags_response": "CASE WHEN udp AND kind = 'purchase' THEN 'True' WHEN udp AND kind = 'click' THEN '0' END",
    "dns_flags_rcode": "CASE WHEN udp AND kind = 'purchase' THEN string(k % 4) END", "http_request_method": "CASE WHEN tcp AND kind = 'view' THEN 'GET' END", "http_host": "CASE WHEN tcp AND kind = 'view' THEN 'h.test' END",
    "http_request_uri": "CASE WHEN tcp AND kind = 'view' THEN concat('/', k) END", "http_response_code": "CASE WHEN tcp AND kind = 'purchase' THEN '200' END", "http_content_type": "CASE WHEN tcp AND kind = 'purchase' THEN 'text/html' END",
    "http_time": "CASE WHEN tcp AND kind = 'purchase' AND k % 2 = 0 THEN string(k / 1000) END", "quic_stream_stream_id": "CASE WHEN udp AND k % 3 = 0 THEN concat(k % 4, ',', k % 8) END",
    "quic_stream_direction": "CASE WHEN udp AND k % 3 = 0 THEN if(k % 2 = 0, 'bidi', 'uni') END", "quic_stream_initiator": "CASE WHEN udp AND k % 3 = 0 THEN 'client' END",
    "frame_protocols": "CASE WHEN tcp THEN 'eth:ip:tcp' WHEN udp THEN 'eth:ip:udp' ELSE 'eth:arp' END",
}


def dissected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as dissected rows of one capture; rows with k = 50 belong to no flow."""
    e = table(spark, sf_dir, "events").selectExpr(
        "event_id + 1 AS frame", "unix_micros(CAST(ts AS TIMESTAMP)) AS us", "CAST(get_json_object(props, '$.k') AS BIGINT) AS k", "user_id AS u", "event_type AS kind", "value",
        "event_type IN ('click', 'view', 'signup') AS outward", "user_id % 7 = 0 AS six",
    )
    e = e.selectExpr(
        "*", "u % 2 = 0 AND k <> 50 AS tcp", "u % 2 = 1 AND k <> 50 AS udp", "CASE WHEN u % 5 = 0 THEN 500 ELSE 40000 + u END AS cport",
        "CASE WHEN u % 5 = 0 THEN 2000 WHEN u % 2 = 1 THEN 53 WHEN u % 4 = 0 THEN 443 ELSE 80 END AS sport",
    )
    return e.selectExpr("'cap' AS capture_id", *(f"{c} AS {n}" for n, c in _FIELDS.items()))


#: The typed rows of the same in SQL: f has all frames, d those of flows with their direction,
#: ev their events.
DISSECTED_SQL = """raw AS (
  SELECT event_id + 1 AS frame, epoch_us(ts) / 1000000::DOUBLE AS epoch, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, user_id AS u, event_type AS kind, value,
         event_type IN ('click', 'view', 'signup') AS outward, user_id % 7 = 0 AS six FROM events),
f AS (
  SELECT *, u % 2 = 0 AND k <> 50 AS tcp, u % 2 = 1 AND k <> 50 AS udp, 60 + k AS len, CASE WHEN k = 50 THEN NULL WHEN u % 2 = 0 THEN 'tcp' ELSE 'udp' END AS transport, CASE WHEN k <> 50 THEN u END AS stream,
         (kind = 'signup' AND u % 3 <> 0 AND tcp) AS syn, (tcp AND (kind <> 'signup' OR k % 2 = 0)) AS ack,
         CASE WHEN u % 5 = 0 THEN 500 ELSE 40000 + u END AS cport, CASE WHEN u % 5 = 0 THEN 2000 WHEN u % 2 = 1 THEN 53 WHEN u % 4 = 0 THEN 443 ELSE 80 END AS sport,
         CASE WHEN six THEN 'fd00::' || u ELSE '10.0.0.' || u END AS cip, CASE WHEN six THEN 'fd01::1' ELSE '192.168.0.1' END AS sip,
         round((epoch - (SELECT min(epoch_us(ts)) / 1000000::DOUBLE FROM events)) * 1000, 3) AS time_ms,
         tcp AND kind = 'error' AS retrans, tcp AND kind = 'error' AND k % 3 = 0 AS plain, tcp AND k % 7 = 0 AS ooo, tcp AND k % 11 = 3 AS dup, tcp AND value < 1 AS zero, tcp AND k > 90 AS lost,
         tcp AND kind = 'signup' AS hello, tcp AND kind = 'view' AS ask, tcp AND kind = 'purchase' AS reply, udp AND kind = 'click' AS query, udp AND kind = 'purchase' AS answer FROM raw),
flow AS (
  SELECT u, transport, arg_min(outward, frame) AS first_out, bool_or(syn) AS saw, any_value(cport) AS cport, any_value(sport) AS sport, any_value(cip) AS cip, any_value(sip) AS sip FROM f WHERE transport IS NOT NULL GROUP BY u, transport),
ends AS (
  SELECT *, NOT saw AND (CASE WHEN first_out THEN cport ELSE sport END) < 1024 AND (CASE WHEN first_out THEN sport ELSE cport END) >= 1024 AS swap FROM flow),
d AS (
  SELECT f.*, (outward = first_out) AS ahead, (outward = first_out) <> swap AS forward, swap, saw, first_out FROM f JOIN ends USING (u, transport)),
ev AS (
  SELECT d.*, t.pos, t.type FROM d, LATERAL (SELECT unnest(range(1, 13)) AS pos, unnest([
    CASE WHEN retrans THEN 'tcp_retransmission' END, CASE WHEN ooo THEN 'tcp_out_of_order' END, CASE WHEN dup THEN 'tcp_dup_ack' END, CASE WHEN zero THEN 'tcp_zero_window' END, CASE WHEN lost THEN 'tcp_missing_segment' END,
    CASE WHEN hello THEN 'tls_client_hello' END, CASE WHEN hello THEN 'tls_server_hello' END, CASE WHEN hello AND k % 4 = 0 THEN 'tls_certificate' END,
    CASE WHEN ask THEN 'http_request' END, CASE WHEN reply THEN 'http_response' END, CASE WHEN query THEN 'dns_query' END, CASE WHEN answer THEN 'dns_response' END]) AS type) t WHERE t.type IS NOT NULL)"""

#: The model's tables in SQL, with every column; they stand on DISSECTED_SQL.
FRAMES_SQL = """m_frames AS (
  SELECT frame AS frame_number, time_ms, epoch, len, transport, CASE WHEN outward THEN cip ELSE sip END AS ip_src, CASE WHEN outward THEN sip ELSE cip END AS ip_dst, stream AS stream_id,
    CAST(CASE WHEN transport IS NULL THEN NULL WHEN outward THEN cport ELSE sport END AS INTEGER) AS src_port, CAST(CASE WHEN transport IS NULL THEN NULL WHEN outward THEN sport ELSE cport END AS INTEGER) AS dst_port,
    CASE WHEN tcp THEN k * 100 END AS tcp_seq_raw, CASE WHEN tcp THEN k * 10 END AS tcp_ack_raw, CASE WHEN tcp THEN CAST(floor(value) AS INTEGER) END AS tcp_len, CASE WHEN tcp THEN 'flags' || (k % 3) END AS tcp_flags,
    CASE WHEN tcp THEN CAST(1000 + k AS INTEGER) END AS tcp_window, CASE WHEN tcp AND kind = 'click' THEN round(k / 1000::DOUBLE * 1000, 3) END AS ack_rtt_ms,
    list_filter([CASE WHEN plain THEN 'retransmission' END, CASE WHEN retrans AND k % 3 = 1 THEN 'fast_retransmission' END, CASE WHEN retrans AND k % 3 = 2 THEN 'spurious_retransmission' END, CASE WHEN ooo THEN 'out_of_order' END,
      CASE WHEN dup THEN 'duplicate_ack' END, CASE WHEN zero THEN 'zero_window' END, CASE WHEN lost THEN 'lost_segment' END], lambda x: x IS NOT NULL) AS analysis,
    CASE WHEN query OR answer THEN CAST(k AS INTEGER) END AS dns_id, CASE WHEN query OR answer THEN 'n' || k || '.test' END AS dns_qname, CASE WHEN answer THEN true WHEN query THEN false END AS dns_response,
    CASE WHEN answer THEN CAST(k % 4 AS INTEGER) END AS dns_rcode, CASE WHEN hello THEN 1 END AS tls_handshake_type, CASE WHEN ask OR reply THEN k + 5 END AS tls_record_bytes,
    CASE WHEN ask THEN 'GET' END AS http_method, CASE WHEN ask THEN 'h.test' END AS http_host, CASE WHEN ask THEN '/' || k END AS http_uri, CASE WHEN reply THEN 200 END AS http_status,
    CASE WHEN reply THEN 'text/html' END AS http_content_type, CASE WHEN reply AND k % 2 = 0 THEN round(k / 1000::DOUBLE * 1000, 3) END AS http_time_ms FROM f)"""
EVENTS_OF_SQL = """before AS (SELECT frame, max(CASE WHEN floor(value) > 0 THEN k * 100 + CAST(floor(value) AS BIGINT) END) OVER w AS data_end,
  first_value(CASE WHEN syn THEN k * 100 + 1 WHEN floor(value) > 0 THEN -1 END IGNORE NULLS) OVER w AS opened FROM d WHERE tcp
  WINDOW w AS (PARTITION BY u, outward ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT ev.*, CASE WHEN type = 'tcp_missing_segment' THEN greatest(data_end, CASE WHEN opened IS NULL THEN CASE WHEN syn THEN k * 100 + 1 END WHEN opened >= 0 THEN opened END) END AS prior FROM ev LEFT JOIN before USING (frame)),
m_events AS (
  SELECT printf('evt:%06d', row_number() OVER (ORDER BY epoch, frame, transport, u, pos)) AS event_id, 'conv:' || transport || ':' || u AS conversation_id, type, time_ms,
    CASE WHEN forward THEN 'initiator_to_responder' ELSE 'responder_to_initiator' END AS direction, 'tshark_' || CASE WHEN type LIKE 'tcp%' THEN 'tcp_analysis' ELSE split_part(type, '_', 1) || '_dissector' END AS detection, frame AS frame_number,
    CASE WHEN type = 'tcp_retransmission' THEN ['plain', 'fast', 'spurious'][k % 3 + 1] END AS attr_variant, CASE WHEN type = 'tcp_dup_ack' THEN k % 5 END AS attr_dup_ack_count,
    CASE WHEN type = 'tcp_missing_segment' AND k * 100 > prior THEN k * 100 - prior END AS attr_gap_bytes, CASE WHEN type = 'tcp_missing_segment' THEN CASE WHEN prior IS NULL THEN 'capture_start' ELSE 'mid_stream' END END AS attr_origin,
    CASE WHEN type LIKE 'dns%' THEN k END AS attr_dns_id, CASE WHEN type LIKE 'dns%' THEN 'n' || k || '.test' END AS attr_qname, CASE WHEN type LIKE 'dns%' THEN '1' END AS attr_qtype,
    CASE WHEN type = 'dns_response' THEN CAST(k % 4 AS INTEGER) END AS attr_rcode_num, CASE WHEN type LIKE 'tls%hello' THEN '0x0303' END AS attr_version, CASE WHEN type = 'tls_client_hello' THEN 'h' || k || '.test' END AS attr_sni,
    CASE WHEN type = 'tls_client_hello' THEN 3 END AS attr_cipher_count, CASE WHEN type = 'tls_server_hello' THEN '0x1301,0x1302,0x1303' END AS attr_cipher,
    CASE WHEN type = 'tls_certificate' THEN CASE WHEN k % 8 = 0 THEN 'CN one' ELSE 'printable' END END AS attr_cn, CASE WHEN type = 'tls_certificate' THEN 'a.test,b.test' END AS attr_san_dns, CASE WHEN type = 'tls_certificate' THEN 2 END AS attr_cert_count,
    CASE WHEN type = 'http_request' THEN 'GET' END AS attr_method, CASE WHEN type = 'http_request' THEN 'h.test' END AS attr_host, CASE WHEN type = 'http_request' THEN '/' || k END AS attr_uri,
    CASE WHEN type = 'http_response' THEN 200 END AS attr_status_code, CASE WHEN type = 'http_response' THEN 'text/html' END AS attr_content_type, CASE WHEN type = 'http_response' AND k % 2 = 0 THEN round(k / 1000::DOUBLE * 1000, 3) END AS attr_resp_time_ms
  FROM g)"""
CONVERSATIONS_OF_SQL = """shake AS (SELECT u, transport, min(frame) AS sf, arg_min(epoch, frame) AS se FROM d WHERE syn AND NOT ack AND ahead GROUP BY u, transport),
shook AS (SELECT d.u, d.transport, arg_min(d.epoch, d.frame) - any_value(se) AS took FROM d JOIN shake USING (u, transport) WHERE ahead AND ack AND NOT syn AND frame > sf GROUP BY 1, 2),
seen AS (SELECT u, transport, count(*) FILTER (type = 'tcp_retransmission') AS re, count(*) FILTER (type = 'tcp_missing_segment') AS lo, count(*) FILTER (type = 'tcp_dup_ack') AS du, count(*) FILTER (type = 'http_request') AS ht,
  count(*) FILTER (type = 'dns_query') AS dn, count(*) FILTER (type = 'tls_client_hello') AS tl, min(epoch) AS v0, max(epoch) AS v1, bool_or(type LIKE 'tls%hello') AS has_tls, bool_or(type LIKE 'dns%') AS has_dns, bool_or(type LIKE 'http%') AS has_http,
  arg_min(epoch, frame) FILTER (type = 'tls_client_hello') AS h1, arg_min(epoch, frame) FILTER (type = 'tls_server_hello') AS h2 FROM ev GROUP BY 1, 2),
quic AS (SELECT u, transport, count(DISTINCT q) AS quic FROM (SELECT u, transport, unnest([k % 4, k % 8]) AS q FROM f WHERE udp AND k % 3 = 0) GROUP BY 1, 2),
agg AS (SELECT u, transport, arg_min(epoch, frame) AS f0, arg_max(epoch, frame) AS f1, count(*) FILTER (forward) AS packets_forward, count(*) FILTER (NOT forward) AS packets_reverse, count(*) AS packets_total,
  CAST(coalesce(sum(len) FILTER (forward), 0) AS BIGINT) AS bytes_forward, CAST(coalesce(sum(len) FILTER (NOT forward), 0) AS BIGINT) AS bytes_reverse, CAST(sum(len) AS BIGINT) AS bytes_total,
  CAST(coalesce(sum(floor(value)) FILTER (forward AND tcp), 0) AS BIGINT) AS payload_bytes_forward, CAST(coalesce(sum(floor(value)) FILTER (NOT forward AND tcp), 0) AS BIGINT) AS payload_bytes_reverse,
  CAST(coalesce(sum(k + 5) FILTER (ask OR reply), 0) AS BIGINT) AS tls_app_bytes, round(median(k / 1000::DOUBLE) FILTER (tcp AND kind = 'click') * 1000, 3) AS rtt_median_ms, round(max(k / 1000::DOUBLE) FILTER (tcp AND kind = 'click') * 1000, 3) AS rtt_max_ms
  FROM d GROUP BY u, transport),
spans AS (SELECT *, least(f0, coalesce(v0, f0)) AS e0, greatest(f1, coalesce(v1, f1)) AS e1, first_out <> swap AS client_first FROM agg JOIN ends USING (u, transport) LEFT JOIN seen USING (u, transport) LEFT JOIN quic USING (u, transport) LEFT JOIN shook USING (u, transport)),
m_convs AS (
  SELECT 'conv:' || transport || ':' || u AS conversation_id, transport, CASE WHEN client_first THEN cip ELSE sip END AS initiator_ip, CAST(CASE WHEN client_first THEN cport ELSE sport END AS INTEGER) AS initiator_port,
    CASE WHEN client_first THEN sip ELSE cip END AS responder_ip, CAST(CASE WHEN client_first THEN sport ELSE cport END AS INTEGER) AS responder_port, CASE WHEN saw THEN 'handshake' WHEN swap THEN 'port_heuristic' ELSE 'first_packet' END AS direction_basis,
    round((e0 - (SELECT min(epoch) FROM f)) * 1000, 3) AS start_ms, round((e1 - e0) * 1000, 3) AS duration_ms, packets_forward, packets_reverse, packets_total, bytes_forward, bytes_reverse, bytes_total, payload_bytes_forward, payload_bytes_reverse, tls_app_bytes,
    coalesce(re, 0) AS retransmission_count, coalesce(lo, 0) AS missing_segment_count, coalesce(du, 0) AS dup_ack_count, coalesce(ht, 0) AS http_txn_count, coalesce(dn, 0) AS dns_query_count, coalesce(tl, 0) AS tls_handshake_count,
    rtt_median_ms, rtt_max_ms, CASE WHEN e1 > e0 THEN floor(bytes_total * 8 / (e1 - e0) + 0.5) END AS throughput_bps, round(took * 1000, 3) AS tcp_handshake_ms, round((h2 - h1) * 1000, 3) AS tls_handshake_ms, coalesce(quic, 0) AS quic_stream_count,
    list_filter([transport, CASE WHEN has_tls THEN 'tls' END, CASE WHEN has_dns THEN 'dns' END, CASE WHEN has_http THEN 'http' END, CASE WHEN quic > 0 THEN 'quic' END], lambda x: x IS NOT NULL) AS protocol_tags FROM spans)"""
STREAMS_SQL = """mention AS (SELECT 'conv:udp:' || u AS conversation_id, frame, epoch, len, k, unnest([k % 4, k % 8]) AS stream_id, unnest([0, 1]) AS pos FROM f WHERE udp AND k % 3 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY conversation_id, stream_id ORDER BY frame, pos) AS i FROM mention),
m_streams AS (
  SELECT conversation_id, stream_id, CASE WHEN arg_min(k, frame) % 2 = 0 THEN 'bidi' ELSE 'uni' END AS stream_direction, 'client' AS initiator, round((arg_min(epoch, frame) - (SELECT min(epoch) FROM f)) * 1000, 3) AS start_ms,
    round((arg_max(epoch, frame) - arg_min(epoch, frame)) * 1000, 3) AS duration_ms, count(*) AS packets, CAST(sum(len) AS BIGINT) AS bytes, list_sort(list(frame) FILTER (i <= 50)) AS evidence_frames FROM ranked GROUP BY 1, 2)"""
