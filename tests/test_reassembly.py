"""Streams from segments, against plain Python."""

import random

import pytest

from packetloom.operators import reassembly


def cut(rnd, data, base):
    """Overlapping segments of a stream in any order, some twice, wrapping round 32 bits."""
    out, at = [], 0
    while at < len(data):
        n = rnd.randint(1, 9)
        out.append(((base + at) % reassembly.WRAP, data[at : at + n + rnd.randint(0, 4)]))
        at += n
    out += rnd.sample(out, len(out) // 4)
    rnd.shuffle(out)
    return out


@pytest.fixture(scope="module")
def streams():
    rnd = random.Random(8)
    made = {"a": b"GET /\r\nHost: x\r\n\r\nbody\r\n", "b": bytes(rnd.randrange(256) for _ in range(400)), "c": ("\r\n" * 5 + "zürich\r\n").encode(), "d": b"\r"}
    return made, [(k, i, seq, d) for k, v in made.items() for i, (seq, d) in enumerate(cut(rnd, v, reassembly.WRAP - 7))] + [("e", 1, 5, b""), ("f", 1, None, b"x"), ("g", 1, 3, None)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, frame_number long, seq long, data binary").repartition(5)


def test_streams_come_back(spark, streams):
    made, rows = streams
    got = {}
    for r in sorted(reassembly.merged(frame(spark, rows), ["k"]).collect(), key=lambda r: (r.k, r.at)):
        assert r.gap == 0 and len(got.get(r.k, b"")) == r.at
        got[r.k] = got.get(r.k, b"") + r.text.encode("latin1")
    assert got == made


@pytest.mark.parametrize("delimiter", [b"\r\n", b"\n", b"H"])
def test_messages_across_segments(spark, streams, delimiter):
    made, rows = streams
    found = reassembly.messages(reassembly.merged(frame(spark, rows), ["k"]), ["k"], delimiter).collect()
    assert {(r.k, r.message, r.text.encode("latin1")) for r in found} == {(k, i, t) for k, v in made.items() for i, t in enumerate(v.split(delimiter))}


def test_gaps_and_first_copies(spark):
    rows = [("a", 1, 100, b"abc"), ("a", 2, 102, b"XY"), ("a", 3, 110, b"\nz"), ("a", 4, 100, b"ZZZ")]
    pieces = reassembly.merged(frame(spark, rows), ["k"])
    assert sorted((r.at, r.text, r.gap) for r in pieces.collect()) == [(0, "abc", 0), (3, "Y", 0), (10, "\nz", 6)]
    found = reassembly.messages(pieces, ["k"], b"\n").collect()
    assert sorted((r.message, r.text, r.gap) for r in found) == [(0, "abcY", 6), (1, "z", 0)]


def test_delimiters(spark):
    for bad in (b"", b"aa", b"\r\n\r\n"):
        with pytest.raises(ValueError):
            reassembly.messages(None, ["k"], bad)
    assert reassembly.merged(frame(spark, []), ["k"]).count() == 0
