"""Packet files: decoding, the data source, derived flags."""

import struct

import pytest

from packetloom.operators import extract
from packetloom.sources import pcap


def ether(payload, kind=0x0800):
    return b"\0" * 12 + struct.pack(">H", kind) + payload


def ipv4(src, dst, proto, body):
    return struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 0, 0, 64, proto, 0, bytes(src), bytes(dst)) + body


def tcp(sport, dport, seq, ack, flags, payload=b"", window=1000):
    return struct.pack(">HHIIBBHHH", sport, dport, seq, ack, 5 << 4, flags, window, 0, 0) + payload


def udp(sport, dport, payload):
    return struct.pack(">HHHH", sport, dport, 8 + len(payload), 0) + payload


A, B = (10, 0, 0, 1), (10, 0, 0, 2)
SYN, ACK = 2, 16


def hello():
    name = b"a.test"
    ext = struct.pack(">HHHBH", 0, 5 + len(name), 3 + len(name), 0, len(name)) + name
    body = b"\x03\x03" + b"\0" * 32 + b"\0" + struct.pack(">H", 4) + b"\x13\x01\x13\x02" + b"\x01\0" + struct.pack(">H", len(ext)) + ext
    msg = b"\x01" + len(body).to_bytes(3) + body
    return b"\x16\x03\x01" + struct.pack(">H", len(msg)) + msg


def dns(flags=0):
    return struct.pack(">HHHHHH", 0x1234, flags, 1, 0, 0, 0) + b"\x03www\x04test\0" + struct.pack(">HH", 1, 1)


PACKETS = [
    (0.0, ether(ipv4(A, B, 6, tcp(1000, 80, 100, 0, SYN)))),
    (0.01, ether(ipv4(B, A, 6, tcp(80, 1000, 500, 101, SYN | ACK)))),
    (0.02, ether(ipv4(A, B, 6, tcp(1000, 80, 101, 501, ACK)))),
    (0.03, ether(ipv4(A, B, 6, tcp(1000, 80, 101, 501, ACK, b"GET /x HTTP/1.1\r\nHost: h.test\r\n\r\n")))),
    (0.05, ether(ipv4(A, B, 6, tcp(1000, 80, 101, 501, ACK, b"GET /x HTTP/1.1\r\nHost: h.test\r\n\r\n")))),
    (0.06, ether(ipv4(B, A, 6, tcp(80, 1000, 501, 134, ACK, b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\nhi")))),
    (0.07, ether(ipv4(B, A, 6, tcp(80, 1000, 700, 134, ACK, b"late")))),
    (0.08, ether(ipv4(A, B, 6, tcp(1000, 80, 134, 600, ACK, window=0)))),
    (0.081, ether(ipv4(A, B, 6, tcp(1000, 80, 134, 600, ACK, window=0)))),
    (0.1, ether(ipv4(A, B, 17, udp(5000, 53, dns())))),
    (0.11, ether(ipv4(B, A, 17, udp(53, 5000, dns(0x8183))))),
    (0.2, ether(ipv4(A, B, 6, tcp(1001, 443, 1, 1, ACK, hello())))),
]


def classic(order="<"):
    out = struct.pack(order + "IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for t, p in PACKETS:
        out += struct.pack(order + "IIII", 1700000000, round(t * 1e6), len(p), len(p)) + p
    return out


def blocks():
    def block(kind, body):
        body += b"\0" * (-len(body) % 4)
        return struct.pack("<II", kind, 12 + len(body)) + body + struct.pack("<I", 12 + len(body))

    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 65535))
    for t, p in PACKETS:
        us = 1700000000 * 10**6 + round(t * 1e6)
        out += block(6, struct.pack("<IIIII", 0, us >> 32, us & 0xFFFFFFFF, len(p), len(p)) + p)
    return out


@pytest.mark.parametrize("data", [classic("<"), classic(">"), blocks()], ids=["little", "big", "blocks"])
def test_rows(data):
    r = list(pcap.rows(data))
    assert len(r) == len(PACKETS) and r[0]["tcp.flags.syn"] == "True" and r[0]["tcp.stream"] == r[1]["tcp.stream"] == "0"
    assert (r[3]["http.request.method"], r[3]["http.host"], r[3]["http.request.uri"], r[3]["frame.protocols"]) == ("GET", "h.test", "/x", "eth:ip:tcp:http")
    assert r[5]["http.response.code"] == "200" and r[9]["dns.qry.name"] == "www.test" and r[10]["dns.flags.rcode"] == "3"
    assert (r[11]["tls.handshake.type"], r[11]["tls.handshake.extensions_server_name"], r[11]["tls.handshake.ciphersuite"]) == ("1", "a.test", "0x1301,0x1302")
    assert r[11]["tcp.stream"] == "1" and r[9]["udp.stream"] == "0" and float(r[1]["frame.time_epoch"]) == pytest.approx(1700000000.01)


def test_torn_and_foreign_files():
    assert len(list(pcap.rows(classic()[:-10]))) == len(PACKETS) - 1
    with pytest.raises(ValueError):
        list(pcap.rows(b"nonsense"))
    assert pcap.dissect(1, b"short") == {"frame.protocols": "eth"}


def test_source_to_conversations(spark, tmp_path):
    (tmp_path / "one.pcap").write_bytes(classic())
    (tmp_path / "two.pcapng").write_bytes(blocks())
    pcap.register(spark)
    rows = spark.read.format("packets").load(str(tmp_path))
    other = pcap.read_packets(spark, str(tmp_path))
    assert rows.count() == other.count() == 2 * len(PACKETS) and rows.columns == other.columns
    flagged = pcap.analysis(rows)
    f = extract.facts(flagged).filter("capture_id = 'one'")
    c = {r.conversation_id: r for r in extract.conversations(f).collect()}
    t = c["conv:tcp:0"]
    assert (t.tcp_handshake_ms, t.retransmission_count, t.missing_segment_count, t.dup_ack_count, t.http_txn_count) == (20, 1, 1, 1, 2)
    kinds = {r.type: r for r in extract.events(f).collect()}
    assert kinds["tcp_zero_window"].frame_number in (8, 9) and kinds["tcp_missing_segment"].attr_gap_bytes == 700 - (501 + 46)
    assert kinds["tls_client_hello"].attr_sni == "a.test" and kinds["dns_response"].attr_rcode_num == 3


def test_reports(spark, tmp_path):
    from packetloom.sources import tsv

    p = tmp_path / "meta.tsv"
    p.write_text("File name\tFile type\tNumber of packets\tData size (bytes)\tCapture duration (seconds)\tStart time\tEnd time\nx\tpcap\t32\t7574\t1.600000\t2023-11-14 22:13:20.000000\t2023-11-14 22:13:21.600000\n")
    m = tsv.read_metadata(spark, str(p)).first()
    assert (m.format, m.packet_count, m.data_size, m.duration_s, m.start_epoch) == ("pcap", 32, 7574, 1.6, 1700000000.0)
    lines = spark.createDataFrame([("eth      frames:32 bytes:7574",), ("  ip    frames:30 bytes:7000",), ("10.0.0.1:1 <-> 10.0.0.2:443    7 4,745 bytes    10 137 kB    17 142 kB    0.5    1.25",)], "value string")
    assert [(r.protocol, r.depth, r.frames) for r in tsv.protocol_report(lines).collect()] == [("eth", 0, 32), ("ip", 1, 30)]
    c = tsv.conversation_report(lines, "tcp").first()
    assert (c.bytes_b_to_a, c.frames_a_to_b, c.bytes_a_to_b, c.duration_s) == (4745, 10, 137000, 1.25)
    p.write_text("File name\tFile type\nx\tpcap\n")
    with pytest.raises(ValueError, match="lacks"):
        tsv.read_metadata(spark, str(p))
    rows = tmp_path / "cap.tsv"
    rows.write_text("1\t1700000000.0\t60\n2\t1700000001.0\t70\n")
    d = tsv.read_dissected(spark, str(rows), ["frame.number", "frame.time_epoch", "frame.len"])
    assert extract.capture_times(extract.facts(d)).first().asDict() == {"capture_id": "cap", "packet_count": 2, "first_epoch": 1700000000.0, "last_epoch": 1700000001.0, "data_size": 130, "duration_ms": 1000.0}
