"""Tables of the model as Spark types, and the catalog that callers of SQL see."""

from __future__ import annotations

from pyspark.sql import types as T

#: Fields of a dissected row, as text; dots become underscores in column names.
DISSECTED = (
    "frame.number frame.time_epoch frame.len ip.src ip.dst ipv6.src ipv6.dst tcp.stream udp.stream "
    "tcp.srcport tcp.dstport udp.srcport udp.dstport tcp.flags.syn tcp.flags.ack tcp.flags.str tcp.seq_raw "
    "tcp.ack_raw tcp.len tcp.window_size tcp.analysis.ack_rtt tcp.analysis.retransmission "
    "tcp.analysis.fast_retransmission tcp.analysis.spurious_retransmission tcp.analysis.out_of_order "
    "tcp.analysis.duplicate_ack tcp.analysis.duplicate_ack_num tcp.analysis.zero_window "
    "tcp.analysis.lost_segment tls.record.length tls.handshake.type tls.handshake.version "
    "tls.handshake.extensions_server_name tls.handshake.ciphersuite tls.handshake.certificate_length "
    "x509sat.uTF8String x509sat.PrintableString x509ce.dNSName dns.id dns.qry.name dns.qry.type "
    "dns.flags.response dns.flags.rcode http.request.method http.host http.request.uri http.response.code "
    "http.content_type http.time quic.stream.stream_id quic.stream.direction quic.stream.initiator frame.protocols"
).split()


def column_of(field: str) -> str:
    return field.replace(".", "_")


def dissected_schema(fields: list[str] | tuple[str, ...] = tuple(DISSECTED)) -> T.StructType:
    return T.StructType([T.StructField(column_of(f), T.StringType()) for f in fields])


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}
_TYPES |= {f"array<{k}>": T.ArrayType(v) for k, v in list(_TYPES.items())}


def _struct(text: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (x.split() for x in text.split(","))])


CONVERSATIONS = _struct(
    "conversation_id string, transport string, initiator_ip string, initiator_port int, responder_ip string, responder_port int, "
    "direction_basis string, start_ms double, duration_ms double, packets_forward bigint, packets_reverse bigint, packets_total bigint, "
    "bytes_forward bigint, bytes_reverse bigint, bytes_total bigint, payload_bytes_forward bigint, payload_bytes_reverse bigint, "
    "tls_app_bytes bigint, retransmission_count bigint, missing_segment_count bigint, dup_ack_count bigint, http_txn_count bigint, "
    "dns_query_count bigint, tls_handshake_count bigint, rtt_median_ms double, rtt_max_ms double, throughput_bps double, "
    "tcp_handshake_ms double, tls_handshake_ms double, quic_stream_count bigint, protocol_tags array<string>"
)
EVENTS = _struct(
    "event_id string, conversation_id string, type string, time_ms double, direction string, detection string, frame_number bigint, "
    "attr_variant string, attr_dup_ack_count bigint, attr_gap_bytes bigint, attr_origin string, attr_dns_id bigint, attr_qname string, "
    "attr_qtype string, attr_rcode_num int, attr_version string, attr_sni string, attr_cipher_count bigint, attr_cipher string, "
    "attr_cn string, attr_san_dns string, attr_cert_count bigint, attr_method string, attr_host string, attr_uri string, "
    "attr_status_code int, attr_content_type string, attr_resp_time_ms double"
)
FRAMES = _struct(
    "frame_number bigint, time_ms double, epoch double, len bigint, transport string, ip_src string, ip_dst string, stream_id bigint, "
    "src_port int, dst_port int, tcp_seq_raw bigint, tcp_ack_raw bigint, tcp_len int, tcp_flags string, tcp_window int, ack_rtt_ms double, "
    "analysis array<string>, dns_id int, dns_qname string, dns_response boolean, dns_rcode int, tls_handshake_type int, "
    "tls_record_bytes bigint, http_method string, http_host string, http_uri string, http_status int, http_content_type string, http_time_ms double"
)
STREAMS = _struct(
    "conversation_id string, stream_id bigint, stream_direction string, initiator string, start_ms double, duration_ms double, "
    "packets bigint, bytes bigint, evidence_frames array<bigint>"
)
FRAME_REFS = _struct("owner_type string, owner_id string, frame_number bigint")
TRANSACTIONS = _struct(
    "conversation_id string, method string, host string, uri string, status_code int, request_time_ms double, response_time_ms double, "
    "resp_time_ms double, request_frame bigint, response_frame bigint"
)

#: name -> (kind, how to get evidence, description, columns)
CATALOG = {
    "conversations": ("table", "none", "One row for each bidirectional transport conversation, all metrics flat. Use list_contains(protocol_tags, 'tls').", CONVERSATIONS),
    "events": ("table", "inline frame_number column", "One row for each observed event; attributes are attr_* columns, null where the type lacks them.", EVENTS),
    "frames": ("table", "inline frame_number column", "One row for each captured frame. Use list_contains(analysis, 'retransmission').", FRAMES),
    "frame_refs": ("table", "inline frame_number column", "Which frames back an event (event id) or a stream (<conversation_id>/stream/<stream_id>).", FRAME_REFS),
    "v_streams": ("view", "join frame_refs by owner_id", "One row for each multiplexed stream.", T.StructType(STREAMS.fields[:-1])),
    "v_http_transactions": ("view", "inline frame_number column", "Requests with the response that answers them, in order within a conversation; response columns are null where there is none.", TRANSACTIONS),
}


#: What columns mean: (description, what null means), by name; attributes by their own name.
_NOTES = """
conversation_id|conv:<transport>:<stream number>|
transport|tcp or udp|neither
initiator_ip|address that began the conversation|
initiator_port|its port (0 if unknown)|
responder_ip|address that answered|
responder_port|its port (0 if unknown)|
direction_basis|how the initiator is known: handshake, first_packet or port_heuristic|
start_ms|first frame, in ms from the capture's start|
duration_ms|from first to last frame|
packets_forward|frames from the initiator|
packets_reverse|frames from the responder|
packets_total|frames both ways|
bytes_forward|frame bytes from the initiator|
bytes_reverse|frame bytes from the responder|
bytes_total|frame bytes both ways|
payload_bytes_forward|TCP payload from the initiator|
payload_bytes_reverse|TCP payload from the responder|
tls_app_bytes|bytes of TLS records|
retransmission_count|retransmission events|
missing_segment_count|missing-segment events|
dup_ack_count|duplicate acknowledgements|
http_txn_count|HTTP requests|
dns_query_count|DNS queries|
tls_handshake_count|TLS client hellos|
rtt_median_ms|median of round trip samples|no sample
rtt_max_ms|largest round trip sample|no sample
throughput_bps|bits a second over the duration|no duration
tcp_handshake_ms|first SYN to the acknowledgement after it|handshake not seen
tls_handshake_ms|first client hello to first server hello|not both seen
quic_stream_count|different multiplexed streams|
protocol_tags|transport and the protocols seen in it|
event_id|evt:<number> in order of time|
type|type of the event|
time_ms|ms from the capture's start|
direction|initiator_to_responder or back|
detection|what observed it|
frame_number|number of the frame in the capture|
variant|plain, fast or spurious|
dup_ack_count|number of the duplicate|unknown
gap_bytes|bytes missing before the frame|nothing known before
origin|capture_start or mid_stream|
dns_id|transaction id|not DNS
qname|name asked for|
qtype|type asked for|unknown
rcode_num|response code|
version|TLS version offered or chosen|unknown
sni|server name asked for|not sent
cipher_count|ciphers offered|unknown
cipher|cipher chosen|unknown
cn|name in the certificate|unknown
san_dns|further names in the certificate|none
cert_count|certificates sent|unknown
method|HTTP method|
host|HTTP host|not sent
uri|HTTP target|
status_code|HTTP status|no response
content_type|HTTP content type|not sent
resp_time_ms|time to the response: as measured, else by difference|no response
epoch|seconds since 1970|
len|bytes of the frame|
ip_src|sender|not IP
ip_dst|receiver|not IP
stream_id|number of the stream|no stream
src_port|sender's port|no port
dst_port|receiver's port|no port
tcp_seq_raw|sequence number|not TCP
tcp_ack_raw|acknowledgement number|not TCP
tcp_len|TCP payload bytes|not TCP
tcp_flags|TCP flags as text|not TCP
tcp_window|receive window|not TCP
ack_rtt_ms|round trip of the acknowledged segment|no sample
analysis|flags of the TCP analysis|
dns_qname|DNS name|not DNS
dns_response|whether it is a DNS response|not DNS
dns_rcode|DNS response code|not a response
tls_handshake_type|first TLS handshake type|no handshake
tls_record_bytes|bytes of TLS records|not TLS
http_method|HTTP method|not a request
http_host|HTTP host|not a request
http_uri|HTTP target|not a request
http_status|HTTP status|not a response
http_content_type|HTTP content type|not sent
http_time_ms|measured response time|not measured
stream_direction|one way or both|unknown
initiator|who opened the stream|unknown
packets|mentions in frames|
bytes|bytes of those frames|
evidence_frames|its first frames|
owner_type|event or stream|
owner_id|event id, or <conversation_id>/stream/<stream_id>|
request_time_ms|when the request was sent|
response_time_ms|when the response came|no response
request_frame|frame of the request|
response_frame|frame of the response|no response
"""
COLUMN_NOTES = {n: (d, v) for n, d, v in (x.split("|") for x in _NOTES.strip().split("\n"))}


def column_notes(table: str, column: str) -> dict[str, str | None]:
    about, null = COLUMN_NOTES[column.removeprefix("attr_")]
    return {"description": about, "null": "the type lacks it" if column.startswith("attr_") else null or None}
