"""Raw queries: fields by name with a display filter, compiled into a Column."""

from __future__ import annotations

import re
from difflib import get_close_matches
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.columns import whole
from packetloom.schema import DISSECTED, column_of

MAX_FIELDS, MAX_ROWS, DEFAULT_ROWS, MAX_CELL, MAX_FILTER = 16, 500, 100, 4000, 500
TOKEN = re.compile(r"""\s*(?:(?P<op>==|!=|<=|>=|&&|\|\||[<>!()])|(?P<str>"[^"]*"|'[^']*')|(?P<word>[A-Za-z0-9_.:\[\]]+))""")
WORDS = {"and": "&&", "or": "||", "not": "!", "eq": "==", "ne": "!=", "gt": ">", "ge": ">=", "lt": "<", "le": "<="}


class RawError(ValueError):
    pass


class Parser:
    """filter := and ('||' and)*; and := unary ('&&' unary)*; unary := '!' unary | '(' filter
    ')' | field [comparison value]. A field alone asks whether it is present. A comparison of
    a multi-valued field holds if it holds for any value."""

    def __init__(self, text: str, vocabulary: list[str]):
        if len(text) > MAX_FILTER:
            raise RawError(f"display_filter too long (max {MAX_FILTER} chars)")
        self.vocabulary, self.tokens, at = vocabulary, [], 0
        while at < len(text.rstrip()):
            m = TOKEN.match(text, at)
            if not m:
                raise RawError(f"display_filter contains unsupported characters at {at}: {text[at : at + 10]!r}")
            kind = m.lastgroup
            value = m[kind]
            if kind == "word" and value.lower() in WORDS:
                kind, value = "op", WORDS[value.lower()]
            self.tokens.append((kind, value))
            at = m.end()
        self.at = 0

    def _peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def _take(self, value: str | None = None) -> tuple[str, str]:
        t = self._peek()
        if value is not None and t[1] != value:
            raise RawError(f"display_filter: expected '{value}', found '{t[1] or 'end'}'")
        self.at += 1
        return t

    def parse(self) -> Column:
        out = self._or()
        if self._peek()[0] != "end":
            raise RawError(f"display_filter: unexpected '{self._peek()[1]}'")
        return out

    def _or(self) -> Column:
        out = self._and()
        while self._peek() == ("op", "||"):
            self._take()
            out = out | self._and()
        return out

    def _and(self) -> Column:
        out = self._unary()
        while self._peek() == ("op", "&&"):
            self._take()
            out = out & self._unary()
        return out

    def _unary(self) -> Column:
        kind, value = self._take()
        if (kind, value) == ("op", "!"):
            return ~self._unary()
        if (kind, value) == ("op", "("):
            out = self._or()
            self._take(")")
            return out
        if kind != "word":
            raise RawError(f"display_filter: expected a field, found '{value or 'end'}'")
        return self._compare(value)

    def _names(self, field: str) -> list[Column]:
        """A field, the two directions of port or addr, or a protocol's fields."""
        both = {"tcp.port": ("tcp.srcport", "tcp.dstport"), "udp.port": ("udp.srcport", "udp.dstport"), "ip.addr": ("ip.src", "ip.dst"), "ipv6.addr": ("ipv6.src", "ipv6.dst")}
        names = both.get(field) or ((field,) if field in self.vocabulary else tuple(v for v in self.vocabulary if v.startswith(field + ".")))
        if not names:
            raise RawError(unknown([field], self.vocabulary))
        return [F.when(F.col(column_of(n)) != "", F.col(column_of(n))) for n in names]

    def _compare(self, field: str) -> Column:
        cols = self._names(field)
        kind, op = self._peek()
        if kind != "op" or op not in ("==", "!=", "<", "<=", ">", ">="):
            return reduce(lambda a, b: a | b, (c.isNotNull() for c in cols))
        self._take()
        kind, value = self._take()
        if kind not in ("word", "str"):
            raise RawError(f"display_filter: expected a value after '{op}'")
        text = value[1:-1] if kind == "str" else value
        try:
            wanted = float(int(text, 16)) if re.fullmatch(r"0[xX][0-9a-fA-F]+", text) else float(text)
        except ValueError:
            wanted = None

        def holds(v: Column) -> Column:
            if kind == "word" and wanted is not None:
                n = F.when(v.rlike("^0[xX][0-9a-fA-F]+$"), F.conv(F.substring(v, 3, 18), 16, 10).try_cast("double")).when(v.isin("True", "true"), 1.0).when(v.isin("False", "false"), 0.0).otherwise(v.try_cast("double"))
                a, b = n, F.lit(wanted)
            else:
                a, b = v, F.lit(text)
            return {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]

        return reduce(lambda a, b: a | b, (F.coalesce(F.exists(F.split(c, ","), holds), F.lit(False)) for c in cols))


def unknown(names: list[str], vocabulary: list[str]) -> str:
    """Names that aren't known, each with those most like it."""
    like = {n: get_close_matches(n, vocabulary, 3, 0.7) for n in names}
    return "no such field: " + "; ".join(f"{n} (like {', '.join(x)})" if x else n for n, x in like.items())


NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.]*")


def faults(fields: list[str], limit: int, vocabulary: list[str]) -> list[str]:
    """Everything that is wrong with a raw query's fields and limit."""
    odd = [f for f in fields if not NAME.fullmatch(f)]
    strange = [f for f in fields if f not in vocabulary and f not in odd]
    checks = (
        (1 <= len(fields) <= MAX_FIELDS, f"name 1 to {MAX_FIELDS} fields"),
        (isinstance(limit, int) and not isinstance(limit, bool) and 1 <= limit <= MAX_ROWS, f"limit is a whole number from 1 to {MAX_ROWS}"),
        (not odd, f"not a field name: {', '.join(map(repr, odd))}"),
        (not strange, unknown(strange, vocabulary)),
    )
    return [why for fine, why in checks if not fine]


def raw_query(rows: DataFrame, fields: list[str], display_filter: str | None = None, limit: int | None = None, vocabulary: list[str] | None = None) -> tuple[DataFrame, int]:
    """The plan (limit + 1 rows, frame number first) and the limit. rows are dissected rows;
    filter and columns reach the scan."""
    known, n = vocabulary or DISSECTED, DEFAULT_ROWS if limit is None else limit
    if wrong := faults(fields, n, known):
        raise RawError("; ".join(wrong))
    cond = Parser(display_filter, known).parse() if display_filter else F.lit(True)
    cut = lambda c: F.when(F.length(c) > MAX_CELL, F.concat(F.left(c, F.lit(MAX_CELL)), F.lit("…[truncated]"))).otherwise(F.coalesce(c, F.lit("")))
    names = list(dict.fromkeys(["frame.number", *fields]))
    page = rows.filter(cond).orderBy(whole(F.col("frame_number"))).limit(n + 1)
    return page.select(*(cut(F.col(column_of(f))).alias(column_of(f)) for f in names)), n
