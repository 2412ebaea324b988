"""Packet files as a Spark data source: `spark.read.format("packets").load(path)`.

One input partition a file; each yields the dissected text fields that the rest of the package
reads. Decodes pcap (both byte orders, micro- and nanoseconds) and pcapng; Ethernet (with VLAN
tags), raw IP and Linux cooked links; IPv4 and IPv6; TCP, UDP; DNS names, TLS hello and
certificate handshakes, HTTP/1 heads. Analysis flags of TCP are derived (analysis())."""

from __future__ import annotations

import glob
import os
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from packetloom.functions.columns import truthy, whole
from packetloom.schema import DISSECTED, column_of, dissected_schema


def packets(data: bytes) -> Iterator[tuple[float, int, int, bytes]]:
    """(epoch seconds, length on the wire, link type, bytes) of each packet; a torn last
    packet ends the file."""
    magic = data[:4]
    if magic in (b"\xd4\xc3\xb2\xa1", b"\x4d\x3c\xb2\xa1", b"\xa1\xb2\xc3\xd4", b"\xa1\xb2\x3c\x4d"):
        order = "<" if magic[0] in (0xD4, 0x4D) else ">"
        scale = 1e9 if magic in (b"\x4d\x3c\xb2\xa1", b"\xa1\xb2\x3c\x4d") else 1e6
        link = struct.unpack_from(order + "I", data, 20)[0] & 0xFFFF
        at = 24
        while at + 16 <= len(data):
            sec, frac, kept, size = struct.unpack_from(order + "IIII", data, at)
            if at + 16 + kept > len(data):
                return
            yield sec + frac / scale, size, link, data[at + 16 : at + 16 + kept]
            at += 16 + kept
    elif magic == b"\x0a\x0d\x0d\x0a":
        yield from _blocks(data)
    else:
        raise ValueError("not a pcap or pcapng file")


def _blocks(data: bytes) -> Iterator[tuple[float, int, int, bytes]]:
    at, order, faces = 0, "<", []
    while at + 12 <= len(data):
        if data[at : at + 4] == b"\x0a\x0d\x0d\x0a":
            order = "<" if data[at + 8 : at + 12] == b"\x4d\x3c\x2b\x1a" else ">"
            faces = []
        kind, size = struct.unpack_from(order + "II", data, at)
        if size < 12 or at + size > len(data):
            return
        body = data[at + 8 : at + size - 4]
        if kind == 1:
            faces.append((struct.unpack_from(order + "H", body)[0], _resolution(body[8:], order)))
        elif kind == 6 and len(body) >= 20:
            face, high, low, kept, wire = struct.unpack_from(order + "IIIII", body)
            link, unit = faces[face] if face < len(faces) else (1, 1e6)
            yield ((high << 32) | low) / unit, wire, link, body[20 : 20 + kept]
        at += size


def _resolution(options: bytes, order: str) -> float:
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack_from(order + "HH", options, at)
        if code == 9 and size:
            v = options[at + 4]
            return float(2 ** (v & 0x7F)) if v & 0x80 else 10.0**v
        if not code:
            break
        at += 4 + (size + 3) // 4 * 4
    return 1e6


def _ip(raw: bytes) -> str:
    import ipaddress

    return str(ipaddress.ip_address(raw))


def _dns_name(data: bytes, at: int) -> tuple[str, int]:
    parts, end, hops = [], None, 0
    while at < len(data) and hops < 32:
        n = data[at]
        if n >= 0xC0 and at + 1 < len(data):
            end = end or at + 2
            at = (n & 0x3F) << 8 | data[at + 1]
            hops += 1
        elif n == 0:
            return ".".join(parts), end or at + 1
        else:
            parts.append(data[at + 1 : at + 1 + n].decode("ascii", "replace"))
            at += 1 + n
    return ".".join(parts), end or at


def _dns(data: bytes, out: dict[str, str]) -> None:
    if len(data) < 12:
        return
    ident, flags, questions = struct.unpack_from(">HHH", data)
    out["dns.id"] = f"0x{ident:04x}"
    out["dns.flags.response"] = str(bool(flags & 0x8000))
    if flags & 0x8000:
        out["dns.flags.rcode"] = str(flags & 15)
    if questions:
        name, at = _dns_name(data, 12)
        out["dns.qry.name"] = name
        if at + 2 <= len(data):
            out["dns.qry.type"] = str(struct.unpack_from(">H", data, at)[0])


def _server_name(ext: bytes) -> str:
    at = 0
    while at + 4 <= len(ext):
        kind, size = struct.unpack_from(">HH", ext, at)
        if kind == 0 and size >= 5:
            n = struct.unpack_from(">H", ext, at + 7)[0]
            return ext[at + 9 : at + 9 + n].decode("ascii", "replace")
        at += 4 + size
    return ""


def _tls(data: bytes, out: dict[str, str]) -> None:
    sizes, types, at = [], [], 0
    while at + 5 <= len(data) and data[at] in (20, 21, 22, 23) and data[at + 1] == 3:
        size = struct.unpack_from(">H", data, at + 3)[0]
        sizes.append(str(size))
        body, k = data[at + 5 : at + 5 + size], 0
        while data[at] == 22 and k + 4 <= len(body):
            kind, n = body[k], int.from_bytes(body[k + 1 : k + 4])
            if kind not in (1, 2, 4, 8, 11, 12, 13, 14, 15, 16, 20):
                break  # encrypted
            types.append(str(kind))
            msg = body[k + 4 : k + 4 + n]
            if kind in (1, 2) and len(msg) >= 35:
                out.setdefault("tls.handshake.version", f"0x{int.from_bytes(msg[:2]):04x}")
                p = 35 + msg[34]
                if kind == 1 and p + 2 <= len(msg):
                    m = struct.unpack_from(">H", msg, p)[0]
                    out["tls.handshake.ciphersuite"] = ",".join(f"0x{int.from_bytes(msg[p + 2 + i : p + 4 + i]):04x}" for i in range(0, m, 2))
                    p += 2 + m
                    p += 1 + msg[p] if p < len(msg) else 0
                    if name := _server_name(msg[p + 2 :]):
                        out["tls.handshake.extensions_server_name"] = name
                elif kind == 2 and p + 2 <= len(msg):
                    out["tls.handshake.ciphersuite"] = f"0x{int.from_bytes(msg[p : p + 2]):04x}"
            elif kind == 11 and len(msg) >= 3:
                certs, p = [], 3
                while p + 3 <= len(msg):
                    m = int.from_bytes(msg[p : p + 3])
                    certs.append(msg[p + 3 : p + 3 + m])
                    p += 3 + m
                out["tls.handshake.certificate_length"] = ",".join(str(len(c)) for c in certs)
                if certs:
                    _certificate(certs[0], out)
            k += 4 + n
        at += 5 + size
    if sizes:
        out["tls.record.length"] = ",".join(sizes)
    if types:
        out["tls.handshake.type"] = ",".join(types)


def _certificate(der: bytes, out: dict[str, str]) -> None:
    """Common names (last: the subject's) and alternative DNS names, by their DER tags."""
    names, at = [], 0
    while (at := der.find(b"\x06\x03\x55\x04\x03", at)) >= 0:
        kind, n = der[at + 5], der[at + 6]
        names.append((kind, der[at + 7 : at + 7 + n].decode("utf-8", "replace")))
        at += 5
    if names:
        out["x509sat.uTF8String" if names[-1][0] == 12 else "x509sat.PrintableString"] = names[-1][1]
    at = der.find(b"\x06\x03\x55\x1d\x11")
    if at >= 0:
        p, dns = der.find(b"\x82", at), []
        while 0 <= p < len(der) - 1 and der[p] == 0x82:
            dns.append(der[p + 2 : p + 2 + der[p + 1]].decode("ascii", "replace"))
            p += 2 + der[p + 1]
        if dns:
            out["x509ce.dNSName"] = ",".join(dns)


def _http(data: bytes, out: dict[str, str]) -> None:
    head = data.split(b"\r\n\r\n", 1)[0].decode("latin-1").split("\r\n")
    first = head[0].split(" ")
    names = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head[1:])}
    if head[0].startswith("HTTP/1") and len(first) > 1:
        out["http.response.code"] = first[1]
        out["http.content_type"] = names.get("content-type", "")
    elif len(first) == 3 and first[2].startswith("HTTP/1") and first[0].isupper():
        out["http.request.method"], out["http.request.uri"] = first[0], first[1]
        out["http.host"] = names.get("host", "")


FLAG_NAMES = (("FIN", 1), ("SYN", 2), ("RST", 4), ("PSH", 8), ("ACK", 16), ("URG", 32))


def dissect(link: int, data: bytes) -> dict[str, str]:
    """Text fields of one packet; what can't be decoded is left out."""
    out: dict[str, str] = {}
    path = []
    if link == 1:
        path.append("eth")
        kind, at = int.from_bytes(data[12:14]), 14
        while kind in (0x8100, 0x88A8):
            path.append("vlan")
            kind, at = int.from_bytes(data[at + 2 : at + 4]), at + 4
    elif link == 113:
        kind, at = int.from_bytes(data[14:16]), 16
    else:
        kind, at = (0x0800 if data[:1] and data[0] >> 4 == 4 else 0x86DD), 0
    ip = data[at:]
    if kind == 0x0800 and len(ip) >= 20:
        path.append("ip")
        size, proto = (ip[0] & 15) * 4, ip[9]
        out["ip.src"], out["ip.dst"] = _ip(ip[12:16]), _ip(ip[16:20])
        fragment = int.from_bytes(ip[6:8]) & 0x1FFF
        ip = ip[: int.from_bytes(ip[2:4]) or len(ip)]
        body = ip[size:] if not fragment else b""
    elif kind == 0x86DD and len(ip) >= 40:
        path.append("ipv6")
        proto, size = ip[6], 40
        out["ipv6.src"], out["ipv6.dst"] = _ip(ip[8:24]), _ip(ip[24:40])
        ip = ip[: 40 + int.from_bytes(ip[4:6])]
        while proto in (0, 43, 60) and size + 2 <= len(ip):
            proto, size = ip[size], size + 8 + ip[size + 1] * 8
        body = ip[size:]
    else:
        out["frame.protocols"] = ":".join(path)
        return out
    if proto == 6 and len(body) >= 20:
        path.append("tcp")
        sport, dport, seq, ack, off, flags, window = struct.unpack_from(">HHIIBBH", body)
        payload = body[(off >> 4) * 4 :]
        out |= {
            "tcp.srcport": str(sport), "tcp.dstport": str(dport), "tcp.seq_raw": str(seq), "tcp.ack_raw": str(ack), "tcp.len": str(len(payload)), "tcp.window_size": str(window),
            "tcp.flags.syn": str(bool(flags & 2)), "tcp.flags.ack": str(bool(flags & 16)), "tcp.flags.str": "|".join(n for n, b in FLAG_NAMES if flags & b),
        }
        if payload[:1] in (b"\x14", b"\x15", b"\x16", b"\x17") and payload[1:2] == b"\x03":
            path.append("tls")
            _tls(payload, out)
        elif payload:
            _http(payload, out)
            if "http.request.method" in out or "http.response.code" in out:
                path.append("http")
    elif proto == 17 and len(body) >= 8:
        path.append("udp")
        sport, dport = struct.unpack_from(">HH", body)
        out |= {"udp.srcport": str(sport), "udp.dstport": str(dport)}
        if 53 in (sport, dport):
            path.append("dns")
            _dns(body[8:], out)
    out["frame.protocols"] = ":".join(path)
    return out


def rows(data: bytes) -> Iterator[dict[str, str]]:
    """Dissected rows of a file; flows are numbered by their first packet, either direction."""
    flows: dict[str, dict] = {"tcp": {}, "udp": {}}
    for n, (epoch, size, link, raw) in enumerate(packets(data), 1):
        out = {"frame.number": str(n), "frame.time_epoch": f"{epoch:.9f}", "frame.len": str(size)} | dissect(link, raw)
        for proto in ("tcp", "udp"):
            if f"{proto}.srcport" in out:
                a = (out.get("ip.src") or out.get("ipv6.src"), out[f"{proto}.srcport"])
                b = (out.get("ip.dst") or out.get("ipv6.dst"), out[f"{proto}.dstport"])
                out[f"{proto}.stream"] = str(flows[proto].setdefault((min(a, b), max(a, b)), len(flows[proto])))
        yield out


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        p = self.path.removeprefix("file://")
        files = sorted(glob.glob(os.path.join(p, "*.pcap*"))) if os.path.isdir(p) else sorted(glob.glob(p))
        return [_File(f) for f in files]

    def read(self, partition):
        name = os.path.basename(partition.path).split(".")[0]
        with open(partition.path, "rb") as f:
            data = f.read()
        for r in rows(data):
            yield (*(r.get(x) for x in DISSECTED), name)


class PacketSource(DataSource):
    """Files on a path that every executor can open; others go through read_binary()."""

    @classmethod
    def name(cls):
        return "packets"

    def schema(self):
        from pyspark.sql import types as T

        return dissected_schema().add("capture_id", T.StringType())

    def reader(self, schema):
        return _Reader(self.options["path"])


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    """Packet files of any file system that Spark reads, one task a file or more files."""
    import pyarrow as pa

    schema = PacketSource.schema(None)

    def run(batches):
        for b in batches:
            for path_, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                name = path_.rsplit("/", 1)[-1].split(".")[0]
                held = []
                for r in rows(content):
                    held.append([r.get(x) for x in DISSECTED] + [name])
                    if len(held) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], names=schema.names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], names=schema.names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def analysis(rows_: DataFrame) -> DataFrame:
    """rows with the analysis flags of TCP derived by windows over each direction of a flow.

    retransmission: payload that ends at or before the highest end seen; lost segment: payload
    (or SYN/FIN) that begins beyond it; out of order: payload that begins before it while a gap
    was open, within 3 ms; duplicate ack: a bare ack that repeats the last ack and window;
    zero window: window 0 without SYN, RST or FIN. An approximation of a dissector's flags."""
    c = lambda f: F.col(column_of(f))
    seq, ack, size, window = (whole(c(f)) for f in ("tcp.seq_raw", "tcp.ack_raw", "tcp.len", "tcp.window_size"))
    src = F.concat_ws("|", F.coalesce(c("ip.src"), c("ipv6.src")), c("tcp.srcport"))
    d = rows_.withColumns({"__src": src, "__n": whole(c("frame.number")), "__t": c("frame.time_epoch").try_cast("double"), "__seq": seq, "__ack": ack, "__len": F.coalesce(size, F.lit(0)), "__win": window})
    lane = Window.partitionBy("capture_id", "tcp_stream", "__src").orderBy("__n")
    before = lane.rowsBetween(Window.unboundedPreceding, -1)
    syn, other = truthy(c("tcp.flags.syn")), F.coalesce(c("tcp.flags.str"), F.lit("")).rlike("FIN|RST")
    d = d.withColumn("__end", F.col("__seq") + F.col("__len") + F.when(syn, 1).otherwise(0))
    d = d.withColumns({"__prior": F.max("__end").over(before), "__last_ack": F.lag("__ack").over(lane), "__last_win": F.lag("__win").over(lane), "__last_t": F.max(F.when(F.col("__len") > 0, F.col("__t"))).over(before)})
    tcp = c("tcp.stream").isNotNull() & (c("tcp.stream") != "")
    data = tcp & (F.col("__len") > 0) & F.col("__prior").isNotNull()
    behind = data & (F.col("__seq") < F.col("__prior"))
    quick = behind & (F.col("__t") - F.col("__last_t") <= 0.003)
    dup = tcp & (F.col("__len") == 0) & ~syn & ~other & (F.col("__ack") == F.col("__last_ack")) & (F.col("__win") == F.col("__last_win"))
    flag = lambda cond: F.when(F.coalesce(cond, F.lit(False)), "True")
    d = d.withColumns({
        column_of("tcp.analysis.retransmission"): flag(behind & ~quick), column_of("tcp.analysis.out_of_order"): flag(quick),
        column_of("tcp.analysis.lost_segment"): flag(data & (F.col("__seq") > F.col("__prior"))), column_of("tcp.analysis.duplicate_ack"): flag(dup),
        column_of("tcp.analysis.zero_window"): flag(tcp & (F.col("__win") == 0) & ~syn & ~other),
    })
    series = F.sum(F.when(F.coalesce(dup, F.lit(False)), 0).otherwise(1)).over(lane)
    d = d.withColumn("__series", series)
    count = F.row_number().over(Window.partitionBy("capture_id", "tcp_stream", "__src", "__series").orderBy("__n")) - 1
    d = d.withColumn(column_of("tcp.analysis.duplicate_ack_num"), F.when(c("tcp.analysis.duplicate_ack").isNotNull(), count.cast("string")))
    return d.select(*[F.col(x) for x in rows_.columns])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PacketSource)

