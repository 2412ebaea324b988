"""Operators over streams that keep state of their own, by the current state API.

State lies in RocksDB, one entry a key and element, so it needn't fit into memory; what isn't
needed any more goes by event-time timers or by time to live."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from packetloom.streaming.windows import FLOW, PAIR

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _rocks(spark: SparkSession) -> None:
    if spark.conf.get(_PROVIDER, "") != _ROCKS:
        spark.conf.set(_PROVIDER, _ROCKS)


def _sorted(batches: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(batches)).sort_values(by)


class _Pairs(StatefulProcessor):
    """Open requests as a list; the timer that gives them up as a value."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "frame bigint, at double")
        self.until = handle.getValueState("until", "ms bigint")

    @staticmethod
    def _out(rows: list) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["conversation_id", "request_frame", "response_frame", "resp_time_ms"])
        return out.astype({"request_frame": "Int64", "response_frame": "Int64", "resp_time_ms": "float64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = [(f, t) for f, t in self.open.get()] if self.open.exists() else []
        queue, out = list(before), []
        d = _sorted(rows, ["time_ms", "frame_number"])
        for kind, frame, at in zip(d["type"], d["frame_number"], d["time_ms"], strict=True):
            if kind == "http_request":
                queue.append((int(frame), float(at)))
            elif queue:
                f, begun = queue.pop(0)
                out.append((key[0], f, int(frame), round(float(at) - begun, 3)))
        if queue[: len(before)] == before:  # only new ones: they are appended
            if len(queue) > len(before):
                self.open.appendList(queue[len(before) :])
        elif queue:
            self.open.put(queue)
        else:
            self.open.clear()
        if self.until.exists():
            self.handle.deleteTimer(self.until.get()[0])
        if queue:
            until = max(int(d["ts"].max().timestamp() * 1000), timerValues.getCurrentWatermarkInMs()) + self.idle_ms
            self.handle.registerTimer(until)
            self.until.update((until,))
        else:
            self.until.clear()
        if out:
            yield self._out(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        left = [(key[0], f, None, None) for f, _ in self.open.get()] if self.open.exists() else []
        self.open.clear()
        self.until.clear()
        if left:
            yield self._out(left)

    def close(self) -> None:
        pass


def pairs(events: DataFrame, late: str = "10 seconds", idle_ms: int = 60_000) -> DataFrame:
    """Requests with the responses that answer them, first in first out within a conversation,
    across micro-batches (columns ts, conversation_id, type, frame_number, time_ms); responses
    without an open request are skipped. A conversation that is silent for idle_ms of event
    time gives up its open requests, with a null response, and its state goes."""
    _rocks(events.sparkSession)
    keyed = events.withWatermark("ts", late).filter(F.col("type").isin("http_request", "http_response")).groupBy("conversation_id")
    return keyed.transformWithStateInPandas(_Pairs(idle_ms), PAIR, "Append", "EventTime")


LOST = "capture_id string, transport string, stream_id bigint, ahead boolean, frame_number bigint, origin string, gap_bytes bigint"


class _Gaps(StatefulProcessor):
    """Of each direction of a flow the highest end of sequence, and what opened it, as a value."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "end bigint, base bigint, opened boolean", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        end, base, opened = self.seen.get() if self.seen.exists() else (None, None, False)
        out = []
        d = _sorted(rows, ["frame_number"])
        whole = lambda v: None if pd.isna(v) else int(v)
        for n, syn, seq, length, lost in zip(d["frame_number"], d["syn"], d["tcp_seq_raw"], d["tcp_len"], d["lost_segment"], strict=True):
            seq, length = whole(seq), whole(length) or 0
            # a SYN sets the base only where nothing was seen before; its own row sees that base
            if syn and seq is not None and not opened:
                base, opened = seq + 1, True
            if lost:
                prior = max((x for x in (end, base) if x is not None), default=None)
                gap = seq - prior if None not in (seq, prior) and seq > prior else None
                out.append((*key, int(n), "capture_start" if seq is not None and prior is None else "mid_stream", gap))
            if seq is not None and length > 0:
                end, opened = max(seq + length, end or 0), True
        self.seen.update((end, base, opened))
        if out:
            yield pd.DataFrame(out, columns=[*FLOW, "ahead", "frame_number", "origin", "gap_bytes"]).astype({"gap_bytes": "Int64"})

    def close(self) -> None:
        pass


def gaps(frames: DataFrame, keep_ms: int = 3_600_000) -> DataFrame:
    """Lost-segment rows with the bytes missing before them, across micro-batches (columns of
    FLOW, ahead, frame_number, syn, tcp_seq_raw, tcp_len, lost_segment): the running maximum of
    operators.extract.gaps, as far as frames arrive in order of batches. A direction that no
    frame renews for keep_ms of processing time is forgotten."""
    _rocks(frames.sparkSession)
    return frames.groupBy(*FLOW, "ahead").transformWithStateInPandas(_Gaps(keep_ms), LOST, "Append", "ProcessingTime")


ANSWER = "conversation_id string, query_frame bigint, response_frame bigint, qname string"


class _Answers(StatefulProcessor):
    """The latest query of each name, as a map."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.asked = handle.getMapState("asked", "qname string", "frame bigint", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        d = _sorted(rows, ["frame_number"])
        for kind, frame, name in zip(d["type"], d["frame_number"], d["attr_qname"], strict=True):
            if kind == "dns_query":
                self.asked.updateValue((name,), (int(frame),))
            elif self.asked.containsKey((name,)):
                out.append((key[0], self.asked.getValue((name,))[0], int(frame), name))
        if out:
            yield pd.DataFrame(out, columns=["conversation_id", "query_frame", "response_frame", "qname"])

    def close(self) -> None:
        pass


def answers(events: DataFrame, keep_ms: int = 600_000) -> DataFrame:
    """DNS responses with the latest earlier query of their conversation and name, across
    micro-batches (columns conversation_id, type, frame_number, attr_qname). A name that isn't
    asked for again for keep_ms of processing time is forgotten."""
    _rocks(events.sparkSession)
    keyed = events.filter(F.col("type").isin("dns_query", "dns_response") & F.col("attr_qname").isNotNull()).groupBy("conversation_id")
    return keyed.transformWithStateInPandas(_Answers(keep_ms), ANSWER, "Append", "ProcessingTime")


def dns_pairs(events: DataFrame, late: str = "10 seconds", within: str = "30 seconds") -> DataFrame:
    """Queries with their responses of the same conversation, id and name that come within a
    time; a query without one is given out with nulls once the watermark has passed. A join of
    two streams: each side is kept only as long as a partner may still come."""
    rows = events.withWatermark("ts", late)
    side = lambda kind, p: rows.filter(F.col("type") == kind).select(F.col("conversation_id").alias(f"{p}_conv"), F.col("attr_dns_id").alias(f"{p}_id"), F.col("attr_qname").alias(f"{p}_name"), F.col("frame_number").alias(f"{p}_frame"), F.col("ts").alias(f"{p}_ts"))
    q, r = side("dns_query", "q"), side("dns_response", "r")
    same = F.expr(f"q_conv = r_conv AND q_id = r_id AND q_name = r_name AND r_ts >= q_ts AND r_ts <= q_ts + INTERVAL {within}")
    return q.join(r, same, "left").select(F.col("q_conv").alias("conversation_id"), F.col("q_name").alias("qname"), F.col("q_frame").alias("query_frame"), F.col("r_frame").alias("response_frame"))
