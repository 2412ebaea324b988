"""One object for a set of captures: tables on demand, macros, audit, and tools that report
errors as values."""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections import OrderedDict
from functools import cached_property

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom import __version__
from packetloom.config import Config
from packetloom.functions import render
from packetloom.operators import extract, index, pairing, timeseries
from packetloom.plans import dsl, rawfilter, sqlgate
from packetloom.schema import CATALOG, CONVERSATIONS, EVENTS, FRAMES, STREAMS, column_notes
from packetloom.stage import dropped, written
from packetloom.store import Store

EVIDENCE_FRAMES, LISTED_FRAMES, TIMELINE, TIMELINE_MOST = 200, 100, 200, 500
TRANSACTIONS = 500


def query_hash(capture_id: str, query) -> str:
    return hashlib.sha256(f"{capture_id}\n{json.dumps(query, sort_keys=True, separators=(',', ':'), ensure_ascii=False)}".encode()).hexdigest()[:16]


def frames_of(frames: DataFrame, asked: DataFrame) -> DataFrame:
    """The records of the asked frame numbers that there are."""
    return frames.join(asked, "frame_number", "left_semi")


def missing_of(frames: DataFrame, asked: DataFrame) -> DataFrame:
    """The asked frame numbers that no record has."""
    return asked.join(frames, "frame_number", "left_anti")


def frame_info():
    """One word on what a frame says: its request, status, name or handshake."""
    return F.coalesce("http_method", F.col("http_status").cast("string"), "dns_qname", F.col("tls_handshake_type").cast("string"))


def listed(frames: DataFrame, col: str = "frame_number", most: int = LISTED_FRAMES) -> dict:
    """The first frames of a set with the size of the whole; a top-k in the plan."""
    total = frames.count()
    first = [r[0] for r in frames.select(col).orderBy(col).limit(most).collect()]
    return {"kind": "aggregate", "frames": first, "frame_count": total, "truncated": total > most}


class Session:
    """rows: dissected rows of one capture. Tables are planned when first asked for. With a
    folder (Config.tables) they are kept there, once for each version; without one they are
    written to the shared folder until the session is closed."""

    def __init__(self, rows: DataFrame, capture_id: str = "cap", path: str | None = None, backend: str = "native", config: Config | None = None, backend_version: str = __version__):
        self.rows, self.capture_id, self.path, self.backend = rows, capture_id, path, {"name": backend, "version": backend_version}
        self.config = config or Config()
        self.spark: SparkSession = rows.sparkSession
        self._sql: SparkSession | None = None
        if self.config.tables:
            self.materialize(self.config.tables)

    @cached_property
    def facts(self) -> DataFrame:
        return extract.prepared(self.rows)

    @cached_property
    def frames(self) -> DataFrame:
        return extract.frames(self.facts)

    @cached_property
    def events(self) -> DataFrame:
        return written(extract.events(self.facts), "events")

    @cached_property
    def conversations(self) -> DataFrame:
        return written(extract.conversations(self.facts), "conversations")

    @cached_property
    def streams(self) -> DataFrame:
        return extract.streams(self.facts)

    def table(self, name: str) -> DataFrame:
        if name == "frame_refs":
            return extract.frame_refs(self.events, self.streams)
        if name == "v_http_transactions":
            return pairing.transactions(self.events).drop("measured_resp_time_ms")
        if name == "v_streams":
            return self.streams.drop("evidence_frames")
        return {"conversations": self.conversations, "events": self.events, "frames": self.frames}[name]

    def materialize(self, folder: str) -> None:
        """Keep the tables in a Store, partitioned by capture; a store whose current generation
        is of this version and capture is read and not written again."""
        marker = f"{__version__} {self.backend['name']} {self.backend['version']} {self.capture_id}"
        store = Store(self.spark, f"{folder.rstrip('/')}/{self.capture_id}")
        names = ("frames", "events", "conversations", "streams")
        found = store.read(marker, dict(zip(names, (FRAMES, EVENTS, CONVERSATIONS, STREAMS), strict=True)))
        if found is None:
            found = store.write(marker, {n: getattr(self, n) for n in names}, ["capture_id"])
        self.__dict__ |= found

    def close(self) -> None:
        for name in ("facts", "events", "conversations"):
            if name in self.__dict__:
                dropped(self.__dict__[name])

    # --- macros ---

    def audit(self, query=None) -> dict:
        out = {"capture_id": self.capture_id, "path": self.path, "version": __version__, "backend": self.backend}
        return out | ({"query_hash": query_hash(self.capture_id, query)} if query is not None else {})

    def open(self) -> dict:
        t = extract.capture_times(self.facts).first()
        meta = t.asDict() if t else {"packet_count": 0}
        there = self.path is not None and os.path.isfile(self.path)
        kind = os.path.splitext(self.path)[1].lstrip(".").lower() or None if self.path else None
        return {"capture": meta | {"capture_id": self.capture_id, "path": self.path, "format": kind, "size_bytes": os.path.getsize(self.path) if there else None, "backend": self.backend}, "audit": self.audit()}

    def overview(self) -> dict:
        pairs = index.pairs(self.facts)
        counts = {r["transport"]: r["count"] for r in pairs.groupBy("transport").count().collect()}
        start = pairs.select(F.min("start_epoch")).scalar()
        top = pairs.withColumn("relative_start_s", F.round(F.col("start_epoch") - start, 6)).orderBy((F.col("bytes_a_to_b") + F.col("bytes_b_to_a")).desc(), "transport", "a", "b").limit(10)
        tree = index.hierarchy(self.facts)
        n = tree.count()
        # a hierarchy has a row for each protocol path that occurs; the commonest are shown
        shown = sorted((r.asDict() for r in tree.orderBy(F.col("frames").desc(), "path").limit(self.config.protocols).collect()), key=lambda r: r["path"])
        return self.open() | {"protocol_distribution": shown, "protocol_paths": n, "conversation_counts": {"tcp": counts.get("tcp", 0), "udp": counts.get("udp", 0)}, "top_conversations_by_bytes": [r.asDict() for r in top.collect()]}

    def query(self, q: dict) -> dict:
        dsl.validate(q)
        scope = {"conversation": "conversations", "event": "events", "frame": "frames", "stream": "streams"}[q["scope"]]
        return {"result": dsl.compile_query(q, getattr(self, scope)).envelope(), "audit": self.audit(q)}

    def _conversation(self, cid: str) -> dict:
        row = self.conversations.filter(F.col("conversation_id") == cid).first()
        if row is None:
            known = [r[0] for r in self.conversations.select("conversation_id").orderBy("transport", F.length("conversation_id"), "conversation_id").limit(20).collect()]
            raise ValueError(f"no conversation {cid!r}; the first are {', '.join(known)}")
        return row.asDict()

    def inspect(self, cid: str, timeline_limit: int | None = None) -> dict:
        conv = self._conversation(cid)
        mine = self.events.filter(F.col("conversation_id") == cid)
        n = min(TIMELINE if timeline_limit is None else timeline_limit, TIMELINE_MOST)
        total = mine.count()
        items = [r.asDict() for r in mine.drop("capture_id").orderBy(F.length("event_id"), "event_id").limit(n).collect()]
        again = listed(mine.filter("type = 'tcp_retransmission'").select("frame_number"))
        return {"conversation": conv, "timeline": {"returned": len(items), "total": total, "offset": 0, "truncated": total > n, "items": items}, "aggregates": {"retransmissions": {"count": again["frame_count"], "evidence": again}}, "audit": self.audit()}

    def evidence(self, frames: list[int] | None = None, event_ids: list[str] | None = None) -> dict:
        """Frame records of the given frames, or of the given events (unknown ids are left out)."""
        if event_ids:
            ids = self.spark.createDataFrame([(i,) for i in set(event_ids)], "event_id string")
            wanted = self.events.join(ids, "event_id").select("frame_number").distinct()
        else:
            wanted = self.spark.createDataFrame([(int(f),) for f in set(frames or [])], "frame_number bigint")
        numbers = sorted(r[0] for r in wanted.collect())
        asked = self.spark.createDataFrame([(n,) for n in numbers], "frame_number bigint")  # what the caller listed
        found = [r.asDict(recursive=True) for r in frames_of(self.frames, asked).withColumn("info", frame_info()).drop("capture_id").orderBy("frame_number").limit(EVIDENCE_FRAMES).collect()]
        missing = [r[0] for r in missing_of(self.frames, asked).orderBy("frame_number").collect()]
        there = len(numbers) - len(missing)
        return {"requested": len(numbers), "returned": len(found), "truncated": there > EVIDENCE_FRAMES, "missing_frames": missing, "frames": found, "audit": self.audit()}

    def timeseries(self, cid: str, metric: str, bin_ms: float = 100) -> dict:
        conv = self._conversation(cid)
        if not 10 <= bin_ms <= 5000:
            raise ValueError("a bin has 10 to 5000 ms")
        d = extract.directed(extract.of_conversation(self.facts, cid))
        bins, width = timeseries.series(d.withColumn("time_ms", F.round((F.col("epoch") - F.col("t0")) * 1000, 3)), metric, conv["start_ms"], conv["duration_ms"], bin_ms)
        rows = [r.asDict() for r in bins.collect()]
        return {"conversation_id": cid, "metric": metric, "requested_bin_ms": bin_ms, "bin_ms": width, "bins_count": len(rows), "sampled": width > bin_ms, "bins": rows, "audit": self.audit()}

    def http_timeline(self, cid: str | None = None, limit: int | None = None, offset: int = 0) -> dict:
        """Transactions in order of their requests: a page of at most `limit`, how many there
        are, and how many requests have no response."""
        t = pairing.transactions(self.events).drop("capture_id", "measured_resp_time_ms")
        t = t.filter(F.col("conversation_id") == cid) if cid else t
        n = TRANSACTIONS if limit is None else limit
        if not 1 <= n <= TRANSACTIONS or offset < 0:
            raise ValueError(f"limit must be an integer in [1, {TRANSACTIONS}], offset one of at least 0")
        total, open_ = t.agg(F.count(F.lit(1)), F.count_if(F.col("response_frame").isNull())).first()
        page = t.orderBy("request_time_ms", "request_frame")
        rows = [r.asDict() for r in (page.offset(offset) if offset else page).limit(n).collect()]
        return {"conversation_id": cid, "transactions": rows, "returned": len(rows), "total": total, "offset": offset, "truncated": offset + len(rows) < total, "unmatched_requests": open_, "audit": self.audit()}

    def sql(self, text: str, limit: int | None = None) -> dict:
        """In a session of its own, so view names can't clash with the caller's tables."""
        if self._sql is None:
            self._sql = sqlgate.own_session(self.spark, {name: self.table(name).drop("capture_id") for name in CATALOG})
        began = time.perf_counter()
        out = sqlgate.run(self._sql, text, set(CATALOG), self.config.sql_rows if limit is None else limit, self.config.sql_timeout_s)
        return out | {"elapsed_ms": round((time.perf_counter() - began) * 1000, 1), "audit": self.audit({"sql": text, "limit": limit})}

    def schema(self) -> dict:
        counts = {n: self.table(n).count() for n in ("conversations", "events", "frames", "frame_refs")}
        return {"tables": [{"name": n, "kind": k, "evidence": e, "description": d, "columns": [{"name": f.name, "type": f.dataType.simpleString()} | column_notes(n, f.name) for f in s.fields], "row_count": counts.get(n)} for n, (k, e, d, s) in CATALOG.items()], "audit": self.audit()}

    def raw_query(self, fields: list[str], display_filter: str | None = None, limit: int | None = None) -> dict:
        plan, n = rawfilter.raw_query(self.rows, fields, display_filter, limit)
        rows = [r.asDict() for r in plan.collect()]
        return {"fields": plan.columns, "returned": min(len(rows), n), "truncated": len(rows) > n, "rows": rows[:n], "audit": self.audit({"fields": fields, "display_filter": display_filter})}


class Sessions:
    """At most `most` open sessions. The one used longest ago goes first (and not the one opened
    first), so a capture in use stays."""

    def __init__(self, most: int | None = None, config: Config | None = None):
        self.most, self.held = most or (config or Config()).sessions, OrderedDict()

    def put(self, s: Session) -> Session:
        self.held[s.capture_id] = s
        self.held.move_to_end(s.capture_id)
        while len(self.held) > self.most:
            self.held.popitem(last=False)[1].close()
        return s

    def get(self, capture_id: str) -> Session:
        if capture_id not in self.held:
            raise KeyError(f"unknown capture '{capture_id}'. Open: {', '.join(self.held) or 'none'}")
        self.held.move_to_end(capture_id)
        return self.held[capture_id]


class Tools:
    """The ten tools by name. A failure is an {error, hint} value, never an exception."""

    NAMES = {
        "traffic_open": "open", "traffic_overview": "overview", "traffic_query": "query", "traffic_inspect": "inspect", "traffic_evidence": "evidence",
        "traffic_timeseries": "timeseries", "traffic_sql": "sql", "traffic_schema": "schema", "traffic_http_timeline": "http_timeline", "traffic_raw_query": "raw_query",
    }

    def __init__(self, sessions: Sessions, opener=None):
        self.sessions, self.opener = sessions, opener

    def call(self, tool: str, **args) -> dict:
        try:
            if tool not in self.NAMES:
                raise KeyError(f"unknown tool '{tool}'. Tools: {', '.join(self.NAMES)}")
            if tool == "traffic_open" and self.opener:
                s = self.sessions.put(self.opener(args.pop("path")))
            else:
                s = self.sessions.get(args.pop("capture_id"))
            if tool == "traffic_query":
                args = {"q": args}
            out = getattr(s, self.NAMES[tool])(**args)
            out["text"] = self.text(tool, out, s.config.render_chars)
            out["audit"]["render_chars"] = len(out["text"])
            return out
        except (ValueError, KeyError, TypeError, OSError) as e:  # what the caller asked for can't be done
            return {"error": str(e).strip("'\""), "hint": f"check the arguments of {tool}"}
        except PySparkException as e:
            return {"error": str(e).splitlines()[0][:500], "hint": f"the job of {tool} failed; its arguments may be right"}

    @staticmethod
    def text(tool: str, out: dict, most: int = render.MAX_CHARS) -> str:
        kind = Tools.NAMES[tool]
        header, rows, footer = getattr(render, f"show_{kind}")(out)
        return render.within_budget(header, rows, footer, most)[0]
