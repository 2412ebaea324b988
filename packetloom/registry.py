"""Event types: what they observe, which attributes they carry, which can be queried."""

from __future__ import annotations

from dataclasses import dataclass

TCP, DNS, TLS, HTTP = "tshark_tcp_analysis", "tshark_dns_dissector", "tshark_tls_dissector", "tshark_http_dissector"


@dataclass(frozen=True)
class EventType:
    name: str
    detection: str
    #: attribute -> "string" or "number", in output order
    attributes: dict[str, str]
    queryable: tuple[str, ...] = ()


EVENT_TYPES = {
    t.name: t
    for t in (
        EventType("tcp_retransmission", TCP, {"variant": "string"}, ("variant",)),
        EventType("tcp_out_of_order", TCP, {}),
        EventType("tcp_dup_ack", TCP, {"dup_ack_count": "number"}, ("dup_ack_count",)),
        EventType("tcp_zero_window", TCP, {}),
        EventType("tcp_missing_segment", TCP, {"gap_bytes": "number", "origin": "string"}, ("gap_bytes", "origin")),
        EventType("dns_query", DNS, {"dns_id": "number", "qname": "string", "qtype": "string"}, ("qname",)),
        EventType("dns_response", DNS, {"dns_id": "number", "qname": "string", "qtype": "string", "rcode_num": "number"}, ("qname", "rcode_num")),
        EventType("tls_client_hello", TLS, {"version": "string", "sni": "string", "cipher_count": "number"}, ("version", "sni")),
        EventType("tls_server_hello", TLS, {"version": "string", "cipher": "string"}, ("version", "cipher")),
        EventType("tls_certificate", TLS, {"cn": "string", "san_dns": "string", "cert_count": "number"}, ("cn", "san_dns")),
        EventType("http_request", HTTP, {"method": "string", "host": "string", "uri": "string"}, ("method", "host", "uri")),
        EventType("http_response", HTTP, {"status_code": "number", "content_type": "string", "resp_time_ms": "number"}, ("status_code", "content_type")),
    )
}


def queryable_attributes() -> dict[str, tuple[str, tuple[str, ...]]]:
    """attribute -> (type, event types that carry it)."""
    out: dict[str, tuple[str, tuple[str, ...]]] = {}
    for t in EVENT_TYPES.values():
        for a in t.queryable:
            kind, types = out.get(a, (t.attributes[a], ()))
            out[a] = (kind, (*types, t.name))
    return out
