"""Conversations, events and frames from dissected rows."""

from packetloom.operators import extract

T0 = 1700000000.0


def row(n, dt, length, src, dst, sport, dport, stream="0", proto="tcp", **more):
    r = {"frame.number": str(n), "frame.time_epoch": f"{T0 + dt:.6f}", "frame.len": str(length), "ip.src": src, "ip.dst": dst, f"{proto}.stream": stream, f"{proto}.srcport": str(sport), f"{proto}.dstport": str(dport)}
    return r | {k.replace("__", "."): v for k, v in more.items()}


A, B = "10.0.0.1", "10.0.0.2"
SYN, ACK = {"tcp__flags__syn": "True"}, {"tcp__flags__ack": "True"}


def session():
    return [
        row(1, 0, 60, A, B, 1000, 443, **SYN, tcp__flags__ack="False"),
        row(2, 0.035, 60, B, A, 443, 1000, **SYN, **ACK),
        row(3, 0.070, 52, A, B, 1000, 443, **ACK),
        row(4, 0.075, 80, A, B, 1000, 443, **ACK, tls__handshake__type="1"),
        row(5, 0.220, 90, B, A, 443, 1000, **ACK, tls__handshake__type="2"),
        row(6, 0.340, 80, A, B, 1000, 443, **ACK, tcp__analysis__retransmission="True"),
        row(7, 0.050, 75, A, "8.8.8.8", 5300, 53, proto="udp", dns__id="0x1234", dns__qry__name="youtube.com", dns__qry__type="1"),
        row(8, 0.095, 100, "8.8.8.8", A, 53, 5300, proto="udp", dns__id="0x1234", dns__flags__response="True", dns__qry__name="youtube.com", dns__flags__rcode="3"),
    ]


def conv(dissect, rows):
    f = extract.facts(dissect(rows))
    return {r.conversation_id: r for r in extract.conversations(f).collect()}


def events(dissect, rows):
    f = extract.facts(dissect(rows))
    return sorted(extract.events(f).collect(), key=lambda r: r.event_id)


def test_session_metrics(dissect):
    c = conv(dissect, session())
    t = c["conv:tcp:0"]
    assert (t.initiator_ip, t.initiator_port, t.responder_port, t.direction_basis) == (A, 1000, 443, "handshake")
    assert (t.packets_forward, t.packets_reverse, t.bytes_forward, t.bytes_reverse, t.bytes_total) == (4, 2, 272, 150, 422)
    assert (t.retransmission_count, t.tls_handshake_count, t.dns_query_count) == (1, 1, 0)
    assert t.tcp_handshake_ms == 70 and t.tls_handshake_ms == 145 and t.duration_ms == 340
    assert t.protocol_tags == ["tcp", "tls"] and t.rtt_median_ms is None and t.throughput_bps == round(422 * 8 / 0.34)
    u = c["conv:udp:0"]
    assert u.protocol_tags == ["udp", "dns"] and u.dns_query_count == 1 and u.start_ms == 50


def test_session_events(dissect):
    e = events(dissect, session())
    assert [x.event_id for x in e] == [f"evt:{k:06d}" for k in range(1, len(e) + 1)]
    assert [x.type for x in e] == ["dns_query", "tls_client_hello", "dns_response", "tls_server_hello", "tcp_retransmission"]
    answer = e[2]
    assert (answer.attr_dns_id, answer.attr_qname, answer.attr_rcode_num, answer.detection, answer.frame_number) == (0x1234, "youtube.com", 3, "tshark_dns_dissector", 8)
    assert e[4].attr_variant == "plain" and e[4].direction == "initiator_to_responder"


def test_frame_without_stream(dissect):
    f = extract.facts(dissect([{"frame.number": "1", "frame.time_epoch": "1700000000.0", "frame.len": "60", "ip.src": A, "ip.dst": B}]))
    assert extract.conversations(f).count() == 0
    assert extract.capture_times(f).first().packet_count == 1
    assert extract.frames(f).first().transport is None


def test_port_heuristic_swaps(dissect):
    c = conv(dissect, [row(1, 0, 122, B, A, 443, 52300, **ACK), row(2, 0.002, 52, A, B, 52300, 443, **ACK), row(3, 0.004, 122, B, A, 443, 52300, **ACK)])["conv:tcp:0"]
    assert (c.initiator_ip, c.initiator_port, c.direction_basis) == (A, 52300, "port_heuristic")
    assert (c.packets_forward, c.packets_reverse, c.bytes_forward, c.bytes_reverse) == (1, 2, 52, 244)


def test_first_packet(dissect):
    c = conv(dissect, [row(1, 0, 60, A, B, 40000, 40001, **ACK)])["conv:tcp:0"]
    assert c.direction_basis == "first_packet" and c.initiator_port == 40000 and c.throughput_bps is None


def test_gap_at_capture_start(dissect):
    (e,) = events(dissect, [row(1, 0, 120, B, A, 443, 52300, **ACK, tcp__seq_raw="9000", tcp__len="100", tcp__analysis__lost_segment="1")])
    assert e.attr_origin == "capture_start" and e.attr_gap_bytes is None


def test_gap_in_stream(dissect):
    e = events(dissect, [
        row(1, 0, 60, B, A, 443, 52300, **SYN, **ACK, tcp__seq_raw="2000"),
        row(2, 0.01, 160, B, A, 443, 52300, **ACK, tcp__seq_raw="2001", tcp__len="100"),
        row(3, 0.02, 160, B, A, 443, 52300, **ACK, tcp__seq_raw="2200", tcp__len="100", tcp__analysis__lost_segment="1"),
    ])
    assert e[0].attr_origin == "mid_stream" and e[0].attr_gap_bytes == 99


def test_http_and_transactions(dissect):
    from packetloom.operators.pairing import transactions

    rows = [
        row(1, 0, 100, A, B, 5000, 80, **ACK, http__request__method="GET", http__host="edge.test", http__request__uri="/data"),
        row(2, 0.03, 200, B, A, 80, 5000, **ACK, http__response__code="200", http__content_type="text/html", http__time="0.030000000"),
        row(3, 0.04, 200, B, A, 80, 5000, **ACK, http__response__code="404"),
        row(4, 0.05, 100, A, B, 5000, 80, **ACK, http__request__method="PUT"),
    ]
    ev = extract.events(extract.facts(dissect(rows)))
    t = sorted(transactions(ev).collect(), key=lambda r: r.request_frame)
    assert [(x.method, x.status_code, x.request_frame, x.response_frame) for x in t] == [("GET", 200, 1, 2), ("PUT", None, 4, None)]
    assert t[0].resp_time_ms == 30 and t[0].measured_resp_time_ms == 30


def test_certificate_flags_and_streams(dissect):
    rows = [
        row(1, 0, 100, A, B, 5000, 443, **ACK, tls__handshake__type="2,11", tls__handshake__certificate_length="10,20", x509sat__PrintableString="cn.test,other", x509ce__dNSName="a.test,b.test", tls__record__length="5,7"),
        row(2, 0.5, 50, A, B, 5001, 443, stream="3", proto="udp", quic__stream__stream_id="0,4,0", quic__stream__direction="0,0"),
        row(3, 0.7, 60, B, A, 443, 5001, stream="3", proto="udp", quic__stream__stream_id="4"),
    ]
    f = extract.facts(dissect(rows))
    e = extract.events(f).filter("type = 'tls_certificate'").first()
    assert (e.attr_cn, e.attr_san_dns, e.attr_cert_count) == ("cn.test", "a.test,b.test", 2)
    c = {r.conversation_id: r for r in extract.conversations(f).collect()}
    assert c["conv:tcp:0"].tls_app_bytes == 12 and c["conv:udp:3"].quic_stream_count == 2 and c["conv:udp:3"].protocol_tags == ["udp", "quic"]
    s = {r.stream_id: r for r in extract.streams(f).collect()}
    assert (s[0].packets, s[0].bytes, s[0].evidence_frames) == (2, 100, [2, 2])
    assert (s[4].packets, s[4].bytes, s[4].evidence_frames, s[4].duration_ms) == (2, 110, [2, 3], 200)
    refs = extract.frame_refs(extract.events(f), extract.streams(f)).filter("owner_type = 'stream'")
    assert {r.owner_id for r in refs.collect()} == {"conv:udp:3/stream/0", "conv:udp:3/stream/4"}


def test_frames_table(dissect):
    r = row(5, 0.25, 99, A, B, 1, 2, tcp__flags__str="··AP,x", tcp__analysis__duplicate_ack="1,1", tcp__analysis__zero_window="True", tcp__analysis__ack_rtt="0.0123456", dns__flags__response="0")
    first = row(1, 0, 10, A, B, 1, 2)
    f = {x.frame_number: x for x in extract.frames(extract.facts(dissect([first, r]))).collect()}[5]
    assert f.analysis == ["duplicate_ack", "zero_window"] and f.tcp_flags == "··AP" and f.ack_rtt_ms == 12.346 and f.time_ms == 250 and f.dns_response is False
