"""Frames that arrive as a stream (additive: the batch operators don't depend on it).

Columns: ts timestamp, capture_id, transport, stream_id, len, forward. Frames later than the
watermark are left out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FLOW = ["capture_id", "transport", "stream_id"]


def _sums() -> list:
    fwd = F.col("forward")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("len"))), F.lit(0)).cast("bigint")
    return [F.count_if(fwd).alias("packets_forward"), F.count_if(~fwd).alias("packets_reverse"), total(fwd).alias("bytes_forward"), total(~fwd).alias("bytes_reverse")]


def tumbling(frames: DataFrame, width: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Packets and bytes each way by flow and bin of fixed width."""
    w = frames.withWatermark("ts", late).groupBy(F.window("ts", width), *FLOW).agg(*_sums())
    return w.select(F.col("window.start").alias("bin_start"), *FLOW, "packets_forward", "packets_reverse", "bytes_forward", "bytes_reverse")


def sliding(frames: DataFrame, width: str = "10 seconds", step: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """The same over overlapping windows."""
    w = frames.withWatermark("ts", late).groupBy(F.window("ts", width, step), *FLOW).agg(*_sums())
    return w.select(F.col("window.start").alias("window_start"), *FLOW, "packets_forward", "packets_reverse", "bytes_forward", "bytes_reverse")


def sessions(frames: DataFrame, idle: str = "60 seconds", late: str = "10 seconds") -> DataFrame:
    """One row for each stretch of a flow without a pause of `idle`."""
    w = frames.withWatermark("ts", late).groupBy(F.session_window("ts", idle), *FLOW).agg(*_sums())
    return w.select(F.col("session_window.start").alias("begin"), F.col("session_window.end").alias("end"), *FLOW, "packets_forward", "packets_reverse", "bytes_forward", "bytes_reverse")


PAIR = "conversation_id string, request_frame bigint, response_frame bigint, resp_time_ms double"


def pairs(events: DataFrame, late: str = "10 seconds", idle_ms: int = 60_000) -> DataFrame:
    """Requests with the responses that answer them, first in first out within a conversation,
    across micro-batches (columns ts, conversation_id, type, frame_number, time_ms). The state
    is the open requests; responses without one are skipped. A conversation without events for
    idle_ms of event time gives up its open requests, with a null response."""

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        open_ = list(zip(*state.get, strict=True)) if state.exists else []
        out = []
        if state.hasTimedOut:
            out = [(key[0], f, None, None) for f, _ in open_]
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values(["time_ms", "frame_number"])
            for kind, frame, at in zip(rows["type"], rows["frame_number"], rows["time_ms"], strict=True):
                if kind == "http_request":
                    open_.append((int(frame), float(at)))
                elif kind == "http_response" and open_:
                    f, begun = open_.pop(0)
                    out.append((key[0], f, int(frame), round(float(at) - begun, 3)))
            state.update(([f for f, _ in open_], [t for _, t in open_]))
            state.setTimeoutTimestamp(max(int(rows["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + idle_ms)
        if out:
            frame_ = pd.DataFrame(out, columns=["conversation_id", "request_frame", "response_frame", "resp_time_ms"])
            yield frame_.astype({"request_frame": "Int64", "response_frame": "Int64", "resp_time_ms": "float64"})

    keyed = events.withWatermark("ts", late).filter(F.col("type").isin("http_request", "http_response")).groupBy("conversation_id")
    return keyed.applyInPandasWithState(step, PAIR, "frames array<bigint>, times array<double>", "append", "EventTimeTimeout")
