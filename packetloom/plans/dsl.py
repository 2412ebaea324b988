"""The query language: filter (AND only), projection, ordering and paging over four scopes.

A query is validated on the driver, then compiled into one DataFrame plan."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.operators.extract import conversation_id
from packetloom.registry import EVENT_TYPES, queryable_attributes

OPS = ("eq", "ne", "gt", "gte", "lt", "lte", "in", "contains")
DEFAULT_LIMIT, MAX_LIMIT = 50, 200
N, S, L = "number", "string", "string[]"


class QueryError(ValueError):
    """What is wrong with a query: all its faults."""

    def __init__(self, faults: list[Fault]):
        super().__init__("; ".join(map(str, faults)))
        self.faults = faults


@dataclass(frozen=True)
class Field:
    type: str
    column: Column | str


def _same(kind: str, names: str) -> dict[str, Field]:
    return {n: Field(kind, n) for n in names.split()}


def fields(scope: str) -> dict[str, Field]:
    """Field name -> type and column of the scope's table."""
    if scope == "conversation":
        return (
            _same(S, "conversation_id transport initiator_ip") | _same(N, "initiator_port") | _same(S, "responder_ip")
            | _same(N, "responder_port start_ms duration_ms packets_forward packets_reverse packets_total bytes_forward bytes_reverse bytes_total "
                       "retransmission_count dns_query_count tls_handshake_count tcp_handshake_ms tls_handshake_ms rtt_median_ms rtt_max_ms "
                       "throughput_bps missing_segment_count quic_stream_count http_txn_count")
            | _same(S, "direction_basis") | _same(L, "protocol_tags") | _same(N, "payload_bytes_forward payload_bytes_reverse tls_app_bytes dup_ack_count")
        )
    if scope == "event":
        attrs = {f"attr.{a}": Field(kind, f"attr_{a}") for a, (kind, _) in queryable_attributes().items()}
        return _same(S, "event_id conversation_id type") | _same(N, "time_ms") | _same(S, "direction") | _same(N, "frame_number") | attrs
    if scope == "frame":
        return (
            _same(N, "frame_number time_ms") | _same(S, "transport ip_src ip_dst") | _same(N, "src_port dst_port")
            | {"conversation_id": Field(S, conversation_id())} | _same(N, "tcp_seq_raw tcp_ack_raw tcp_len") | _same(S, "tcp_flags")
            | _same(N, "tcp_window ack_rtt_ms tls_record_bytes") | {"analysis": Field(S, F.when(F.size("analysis") > 0, F.array_join("analysis", "|")))}
        )
    if scope == "stream":
        return _same(N, "stream_id") | _same(S, "conversation_id stream_direction initiator") | _same(N, "start_ms duration_ms packets bytes")
    raise KeyError(scope)


DEFAULT_SELECT = {
    "conversation": "conversation_id transport initiator_ip initiator_port responder_ip responder_port duration_ms bytes_total retransmission_count direction_basis".split(),
    "event": "event_id conversation_id type time_ms frame_number".split(),
    "frame": "frame_number time_ms ip_src ip_dst tcp_len tcp_flags analysis".split(),
    "stream": "stream_id conversation_id stream_direction initiator start_ms duration_ms bytes".split(),
}
#: The order in which rows of a scope come when a query leaves ties.
SOURCE_ORDER = {"conversation": ["transport", "conversation_id"], "event": ["event_id"], "frame": ["frame_number"], "stream": ["conversation_id", "stream_id"]}


def _values(c: dict) -> list:
    v = c.get("value")
    return v if isinstance(v, list) else [v]


@dataclass(frozen=True)
class Fault:
    """A rule that a query breaks, the part that breaks it and why."""

    rule: str
    part: str
    why: str

    def __str__(self) -> str:
        return f"{self.part}: {self.why}"


class Look:
    """A query as the rules see it: its scope's fields and the event types that it asks for."""

    def __init__(self, q: dict):
        self.q, self.scope = q, q["scope"]
        self.fields, self.attributes = fields(self.scope), queryable_attributes()
        self.where = [c for c in q.get("where") or []]
        self.types = list(dict.fromkeys(str(v) for c in self.where if c.get("field") == "type" and c.get("op") in ("eq", "in") for v in _values(c)))

    def kind(self, c: dict) -> str | None:
        return self.fields[c["field"]].type if c.get("field") in self.fields else None

    def parts(self, of: str) -> list[tuple[str, dict]]:
        """What the rules of one part look at, each with a name: conditions, orders, chosen or used fields, the page."""
        q = self.q
        if of == "condition":
            return [(f"condition {i + 1}", c) for i, c in enumerate(self.where)]
        if of == "order":
            return [(f"order {i + 1}", o) for i, o in enumerate(q.get("order_by") or [])]
        if of == "choice":
            return [(f"select {i + 1}", {"field": f}) for i, f in enumerate(q.get("select") or [])]
        if of == "use":
            return [(n, x) for part in ("condition", "choice", "order") for n, x in self.parts(part) if str(x.get("field")).startswith("attr.")]
        return [("page", {"limit": q.get("limit"), "offset": q.get("offset")})]


def _whole(v) -> bool:
    return isinstance(v, int) and not isinstance(v, bool)


def _names(look: Look) -> str:
    return f"scope {look.scope} has {', '.join(look.fields)}"


_RANGE = ("gt", "gte", "lt", "lte")
#: (rule, part, broken by this item?, why). A rule looks only at items that make sense to it, so one
#: mistake is told once.
RULES = (
    ("field", "condition", lambda c, look: c.get("field") not in look.fields, lambda c, look: f"no field {c.get('field')!r}; {_names(look)}"),
    ("field", "choice", lambda c, look: c["field"] not in look.fields, lambda c, look: f"no field {c['field']!r}; {_names(look)}"),
    ("field", "order", lambda c, look: c.get("field") not in look.fields, lambda c, look: f"no field {c.get('field')!r}; {_names(look)}"),
    ("operator", "condition", lambda c, look: c.get("op") not in OPS, lambda c, look: f"no operator {c.get('op')!r}; there are {', '.join(OPS)}, and no patterns"),
    ("repeat", "condition", lambda c, look: [(x.get("field"), x.get("op")) for x in look.where].count((c.get("field"), c.get("op"))) > 1, lambda c, look: f"{c.get('field')} {c.get('op')} stands more than once"),
    ("range", "condition", lambda c, look: c.get("op") in _RANGE and look.kind(c) in (S, L), lambda c, look: f"{c['op']} compares numbers; {c['field']} is {look.kind(c)}"),
    ("text", "condition", lambda c, look: c.get("op") == "contains" and look.kind(c) == N, lambda c, look: f"contains looks into text and lists; {c['field']} is a number"),
    ("list field", "condition", lambda c, look: look.kind(c) == L and c.get("op") in ("eq", "ne", "in"), lambda c, look: f"{c['field']} is a list, which only contains looks into"),
    ("list value", "condition", lambda c, look: c.get("op") in OPS and (c["op"] == "in") != isinstance(c.get("value"), list), lambda c, look: "in takes a list of values" if c["op"] == "in" else f"{c['op']} takes one value, not a list"),
    ("number value", "condition", lambda c, look: look.kind(c) == N and any(isinstance(v, str) for v in _values(c)), lambda c, look: f"{c['field']} is compared with a number, not with text"),
    ("transport", "condition", lambda c, look: c.get("field") == "transport" and c.get("op") == "eq" and str(c.get("value")) not in ("tcp", "udp"), lambda c, look: f"a transport is tcp or udp, not {c.get('value')!r}"),
    ("event type", "condition", lambda c, look: look.scope == "event" and c.get("field") == "type" and c.get("op") in ("eq", "in") and not {str(v) for v in _values(c)} <= EVENT_TYPES.keys(), lambda c, look: f"event types are {', '.join(EVENT_TYPES)}"),
    ("attribute", "use", lambda c, look: c["field"] in look.fields and not look.types, lambda c, look: f"{c['field']} belongs to some types of events: add a condition on type (eq or in), one of {', '.join(look.attributes[c['field'][5:]][1])}"),
    ("attribute", "use", lambda c, look: c["field"] in look.fields and set(look.types) - set(look.attributes[c["field"][5:]][1]), lambda c, look: f"{c['field']} belongs to {', '.join(look.attributes[c['field'][5:]][1])} alone"),
    ("direction", "order", lambda c, look: c.get("direction") not in ("asc", "desc"), lambda c, look: f"a direction is asc or desc, not {c.get('direction')!r}"),
    ("limit", "page", lambda c, look: c["limit"] is not None and not (_whole(c["limit"]) and 1 <= c["limit"] <= MAX_LIMIT), lambda c, look: f"limit is a whole number from 1 to {MAX_LIMIT}"),
    ("offset", "page", lambda c, look: c["offset"] is not None and not (_whole(c["offset"]) and c["offset"] >= 0), lambda c, look: "offset is a whole number from 0 on"),
)


def faults(q: dict) -> list[Fault]:
    """Everything that is wrong with a query, by rule."""
    if q.get("scope") not in DEFAULT_SELECT:
        return [Fault("scope", "scope", f"one of {', '.join(DEFAULT_SELECT)}")]
    look = Look(q)
    return [Fault(rule, name, why(item, look)) for rule, part, broken, why in RULES for name, item in look.parts(part) if broken(item, look)]


def validate(q: dict) -> None:
    """Raises QueryError, with all faults, if q isn't a valid query."""
    if found := faults(q):
        raise QueryError(found)


def condition(col: Column, kind: str, op: str, value) -> Column:
    """One condition. Null is never equal, larger or smaller; `ne` holds for it, and so does
    `in` unless the list has null; contains takes null text as empty."""
    if op == "contains":
        return F.coalesce(F.array_contains(col, str(value)), F.lit(False)) if kind == L else F.coalesce(col, F.lit("")).contains(str(value))
    if kind == S:
        text = lambda v: ("true" if v else "false") if isinstance(v, bool) else str(v)
        value = [v if v is None else text(v) for v in value] if op == "in" else (value if value is None else text(value))
    if op == "in":
        known = [v for v in value if v is not None]
        hit = col.isin(known) if known else F.lit(False)
        return F.coalesce(hit, F.lit(False)) if None in value else col.isNull() | hit
    if op == "eq":
        return F.coalesce(col == F.lit(value), F.lit(False))
    if op == "ne":
        return ~col.eqNullSafe(F.lit(value))
    compare = {"gt": col > value, "gte": col >= value, "lt": col < value, "lte": col <= value}[op]
    finite = ~F.isnan(col.cast("double")) & (F.abs(col.cast("double")) != float("inf"))
    return F.coalesce(compare & finite, F.lit(False))


@dataclass
class Page:
    """A compiled query: all matching rows, the page of them, and all of them projected."""

    matching: DataFrame
    page: DataFrame
    rows: DataFrame
    limit: int
    offset: int

    def envelope(self) -> dict:
        """Runs the plan: rows of the page and how many rows match."""
        items = [r.asDict(recursive=True) for r in self.page.collect()]
        # a first page that isn't full shows the total itself
        total = len(items) if not self.offset and len(items) < self.limit else self.matching.count()
        return {"returned": len(items), "total": total, "offset": self.offset, "truncated": self.offset + len(items) < total, "items": items}


def _col(f: Field) -> Column:
    return F.col(f.column) if isinstance(f.column, str) else f.column


def compile_query(q: dict, table: DataFrame) -> Page:
    """Filter, order, page and project as one plan; a sort under a limit becomes a top-k.
    Ascending order puts nulls last, descending first; ties keep the scope's own order."""
    validate(q)
    spec = fields(q["scope"])
    conds = [condition(_col(spec[c["field"]]), spec[c["field"]].type, c["op"], c["value"]) for c in q.get("where") or []]
    matching = table.filter(reduce(and_, conds)) if conds else table
    keys = []
    for o in q.get("order_by") or []:
        c = _col(spec[o["field"]])
        keys.append(c.asc_nulls_last() if o["direction"] == "asc" else c.desc_nulls_first())
    # numbered ids: shorter ones come first
    order = [c for k in SOURCE_ORDER[q["scope"]] for c in ((F.length(k), F.col(k)) if k.endswith("_id") and k != "stream_id" else (F.col(k),))]
    limit, offset = q.get("limit") or DEFAULT_LIMIT, q.get("offset") or 0
    page = matching.orderBy(*keys, *order)
    page = (page.offset(offset) if offset else page).limit(limit)
    names = q.get("select") or DEFAULT_SELECT[q["scope"]]
    shown = [_col(spec[n]).alias(n) for n in names]
    return Page(matching, page.select(*shown), matching.select(*shown), limit, offset)
