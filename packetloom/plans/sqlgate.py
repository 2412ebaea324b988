"""Read-only SQL over the registered views, judged by its parsed plan and not by its text."""

from __future__ import annotations

import re
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.operators.ordered import nearest

DEFAULT_ROWS, MAX_ROWS, TIMEOUT_S = 100, 500, 30.0
#: Functions that reach outside the views or run code.
FORBIDDEN = {
    "java_method", "reflect", "try_reflect", "read_files", "input_file_name", "input_file_block_start", "input_file_block_length", "from_avro", "assert_true", "raise_error",
}
#: Spellings of another dialect, defined as SQL functions where an expression suffices.
ALIASES = {
    "regexp_matches": ("s STRING, p STRING", "BOOLEAN", "s RLIKE p"),
    "time_bucket": ("width DOUBLE, at DOUBLE", "DOUBLE", "floor(at / width) * width"),
    "epoch_ms": ("t TIMESTAMP", "BIGINT", "unix_millis(t)"),
}
#: Aggregates and generators of another dialect, renamed in the text outside quotes.
RENAMED = {
    "arg_max": "max_by", "arg_min": "min_by", "quantile_cont": "percentile", "unnest": "explode", "exclude": "except", "list_contains": "array_contains", "array_length": "size", "list_value": "array",
    "list_distinct": "array_distinct", "list_sort": "array_sort", "strlen": "octet_length", "string_split": "split",
}
TABLE_FUNCTIONS = {"explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple", "range", "values"}


class SqlError(ValueError):
    """A statement that isn't allowed, or that ran too long."""


def _outside_quotes(sql: str) -> list[str]:
    """Pieces of the text; those at odd places are quoted or comments."""
    return re.split(r"('(?:[^'\\]|''|\\.)*'|\"(?:[^\"\\]|\"\"|\\.)*\"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/)", sql, flags=re.S)


def _hidden(sql: str) -> tuple[str, list[str]]:
    """The text with quoted pieces as numbered marks and without comments."""
    kept: list[str] = []
    parts = _outside_quotes(sql)
    for i in range(1, len(parts), 2):
        if parts[i][:2] in ("--", "/*"):
            parts[i] = " "
        else:
            kept.append(parts[i])
            parts[i] = f"\x00{len(kept) - 1}\x00"
    return "".join(parts), kept


def _shown(sql: str, kept: list[str]) -> str:
    return re.sub(r"\x00(\d+)\x00", lambda m: kept[int(m[1])], sql)


def _level(sql: str, start: int) -> int:
    """Where the clause list that `start` lies in ends: at its closing bracket or the end."""
    depth = 0
    for m in re.finditer(r"[()]", sql[start:]):
        depth += 1 if m[0] == "(" else -1
        if depth < 0:
            return start + m.start()
    return len(sql)


def _at_level(sql: str, pattern: str, start: int, stop: int) -> int:
    """The first match of pattern between start and stop that isn't inside brackets, or stop."""
    depth = 0
    for m in re.finditer(rf"[()]|{pattern}", sql[start:stop], re.I):
        if m[0] == "(":
            depth += 1
        elif m[0] == ")":
            depth -= 1
        elif not depth:
            return start + m.start()
    return stop


def _select_of(sql: str, at: int) -> int:
    """The SELECT whose clause list holds the place `at`."""
    depth = 0
    for m in reversed(list(re.finditer(r"[()]|\bselect\b", sql[:at], re.I))):
        if m[0] == ")":
            depth += 1
        elif m[0] == "(":
            depth -= 1
        elif depth <= 0:
            return m.start()
    raise SqlError("QUALIFY needs a SELECT")


def _qualify(sql: str) -> str:
    """SELECT ... QUALIFY c becomes a selection over the same SELECT with c as a column; names
    that c uses of that SELECT's own columns are windows, so c is computed with them."""
    while m := re.search(r"\bqualify\b", sql, re.I):
        begin = _select_of(sql, m.start())
        end = _level(sql, m.end())
        stop = _at_level(sql, r"\border\s+by\b|\blimit\b|\bunion\b|\bexcept\b|\bintersect\b", m.end(), end)
        source = _at_level(sql, r"\bfrom\b", begin, m.start())
        head, rest, cond = sql[begin:source], sql[source : m.start()], sql[m.end() : stop]
        inner = f"{head.rstrip()}, ({cond.strip()}) AS __keep {rest.strip()}"
        sql = f"{sql[:begin]}SELECT * EXCEPT (__keep) FROM ({inner}) WHERE __keep {sql[stop:]}"
    return sql


def _floor_division(sql: str) -> str:
    return re.sub(r"//", " div ", sql)


def prepare(sql: str) -> str:
    """Without comments and the last semicolon, with known spellings of another dialect in
    Spark's: renamed functions, a // b, QUALIFY, * EXCLUDE c, USING SAMPLE n."""
    text, kept = _hidden(sql)
    text = text.strip().removesuffix(";").strip()
    if not text:
        raise SqlError("empty SQL statement")
    if ";" in text:
        raise SqlError("multiple statements are not allowed")
    names = re.compile(r"\b(" + "|".join(RENAMED) + r")(?=\s*\()", re.I)
    text = names.sub(lambda m: RENAMED[m[1].lower()], text)
    text = re.sub(r"(\*\s*)exclude\s+(\w+)", r"\1EXCEPT (\2)", text, flags=re.I)
    text = re.sub(r"\busing\s+sample\s+(\d+(?:\.\d+)?)\s*(%|rows)?", lambda m: f"TABLESAMPLE ({m[1]} {'PERCENT' if m[2] == '%' else 'ROWS'})", text, flags=re.I)
    return _shown(_qualify(_floor_division(text)), kept)


def _nodes(plan):
    """Every logical node, in subqueries and CTEs too."""
    todo = [plan]
    while todo:
        node = todo.pop()
        yield node
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
        inner = node.innerChildren()
        for i in range(inner.size()):
            x = inner.apply(i)
            if hasattr(x, "children") and x.getClass().getName().startswith("org.apache.spark.sql.catalyst.plans"):
                todo.append(x)
        exprs = node.expressions()
        walk = [exprs.apply(i) for i in range(exprs.size())]
        while walk:
            e = walk.pop()
            yield e
            if "plan" in dir(e) and e.getClass().getSimpleName() in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "InSubquery", "UnresolvedTableArgPlanId", "FunctionTableSubqueryArgumentExpression", "ArraySubquery"):
                todo.append(e.plan())
            kids = e.children()
            walk += [kids.apply(i) for i in range(kids.size())]


def check(spark: SparkSession, sql: str, tables: set[str]) -> str:
    """The prepared statement; raises SqlError where it isn't one bounded read of `tables`."""
    text = prepare(sql)
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:  # the parser's own message is the best one
        raise SqlError(f"SQL does not parse: {str(e).splitlines()[0][:300]}") from None
    allowed, found = {t.lower() for t in tables}, []
    for node in _nodes(plan):
        kind = node.getClass().getSimpleName()
        if re.search(r"Command|^Create|^Drop|^Insert|^Alter|^Set|^Cache|^Uncache|^Refresh|^Describe|^Show|^Truncate|^Delete|^Update|^Merge|^Load|^Analyze|^Use|^Add|^Repair|^Call|^Exec|^Comment|^Declare|^Overwrite|^Append|ScriptTransformation|ScriptInput|CompoundBody", kind) and not kind.startswith("SetOperation") and ".catalyst.expressions." not in node.getClass().getName():
            raise SqlError("only SELECT statements are allowed")
        if kind == "UnresolvedRelation":
            parts = node.multipartIdentifier()
            found.append([parts.apply(i) for i in range(parts.size())])
        elif kind == "UnresolvedTableValuedFunction":
            name = node.name().last().lower()
            if name not in TABLE_FUNCTIONS:
                raise SqlError(f"table function '{name}' is not allowed")
        elif kind in ("UnresolvedFunction", "UnresolvedGenerator"):
            name = (node.nameParts().last() if kind == "UnresolvedFunction" else node.name().funcName()).lower()
            if name in FORBIDDEN:
                raise SqlError(f"function '{name}' is not allowed")
        elif kind == "UnresolvedWith":
            ctes = node.cteRelations()
            for i in range(ctes.size()):
                allowed.add(ctes.apply(i).productElement(0).lower())
                # its plan is an inner child
    for parts in found:
        if len(parts) != 1 or parts[0].lower() not in allowed:
            raise SqlError(f"unknown or forbidden table '{'.'.join(parts)}'. Allowed: {', '.join(sorted(tables))}")
    return text


def register_aliases(spark: SparkSession) -> None:
    for name, (args, kind, body) in ALIASES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")


def own_session(spark: SparkSession, tables: dict[str, DataFrame]) -> SparkSession:
    """A session that has these tables as views (and the aliases), so no name of the caller's
    session is touched."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and own.conf.get(key, None) != value and own.conf.isModifiable(key):
            own.conf.set(key, value)
    for name, df in tables.items():
        _view(own, df, name)
    register_aliases(own)
    return own


def _view(spark: SparkSession, df: DataFrame, name: str) -> None:
    """df as a temporary view of this session, wherever it was made."""
    if df.sparkSession is spark:
        df.createOrReplaceTempView(name)
        return
    shared = f"packetloom_{uuid.uuid4().hex}"
    df.createOrReplaceGlobalTempView(shared)
    spark.table(f"global_temp.{shared}").createOrReplaceTempView(name)


# --- what needs the columns of its operands: they are planned first, by the analyser ---

_ASOF = r"\basof\s+(?:(left|inner)\s+)?(?:outer\s+)?join\b"
_CLAUSE = r"\b(?:where|group\s+by|having|order\s+by|limit|offset|qualify|window|union|except(?!\s*\()|intersect)\b"
_RELATION = _CLAUSE + r"|\b(?:asof|left|right|full|inner|cross|natural|join|lateral)\b"


def _ctes(sql: str, at: int) -> str:
    """The WITH clause that the place `at` sees: all of the statement's if it lies behind them,
    those before its own if it lies inside one."""
    m = re.match(r"\s*with\b", sql, re.I)
    if not m:
        return ""
    body = _at_level(sql, r"\bselect\b", m.end(), len(sql))
    if at >= body:
        return sql[:body]
    start = stop = m.end()
    while stop < at:
        start, stop = stop, _at_level(sql, ",", stop + 1, body)
    return sql[:start] if start > m.end() else ""


def _opening(sql: str, at: int) -> int:
    """Where the query expression that holds `at` begins: behind its bracket, or behind WITH."""
    depth = 0
    for m in reversed(list(re.finditer(r"[()]", sql[:at]))):
        depth += 1 if m[0] == ")" else -1
        if depth < 0:
            return m.end()
    return len(_ctes(sql, at))


def _by_name(spark: SparkSession, sql: str, columns) -> str:
    """a UNION [ALL] BY NAME b: both sides list the columns of both, in the first one's order
    and then the second's, with nulls for those they lack."""
    while m := re.search(r"\bunion\s+(all\s+)?by\s+name\b", sql, re.I):
        begin, end = _opening(sql, m.start()), _level(sql, m.end())
        stop = _at_level(sql, r"\bunion\b|\bexcept\b(?!\s*\()|\bintersect\b|\border\s+by\b|\blimit\b", m.end(), end)
        sides, seen = [sql[begin : m.start()], sql[m.end() : stop]], _ctes(sql, m.start())
        have = [columns(seen + side) for side in sides]
        names = {c.lower(): c for c in [*have[1], *have[0]]}
        order = list(dict.fromkeys(c.lower() for h in have for c in h))
        for i, h in enumerate(have):
            if len({c.lower() for c in h}) < len(h):
                raise SqlError("UNION BY NAME needs different column names on each side")
            own = {c.lower(): c for c in h}
            sides[i] = f"SELECT {', '.join(f'`{own[c]}` AS `{names[c]}`' if c in own else f'NULL AS `{names[c]}`' for c in order)} FROM ({sides[i].strip()})"
        sql = f"{sql[:begin]} {sides[0]} UNION {m[1] or ''}{sides[1]} {sql[stop:]}"
    return sql


def _relations(spark: SparkSession, chain: str) -> list[str]:
    """The names by which a chain of joined relations is known, from its parsed plan."""
    todo, out = [spark._jsparkSession.sessionState().sqlParser().parsePlan(f"SELECT * FROM {chain}").children().apply(0)], []
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "SubqueryAlias":
            out.append(node.identifier().name())
        elif kind == "UnresolvedRelation":
            out.append(node.multipartIdentifier().last())
        elif kind in ("Join", "LateralJoin", "UnresolvedSubqueryColumnAliases"):
            todo += [node.children().apply(i) for i in range(node.children().size())]
            todo += [node.right().plan()] if kind == "LateralJoin" else []
        else:
            raise SqlError("ASOF JOIN takes tables, subqueries with a name, and joins of them")
    return out[::-1]


def _asof(spark: SparkSession, sql: str, planned, kept: list[str], allowed: set[str]) -> str:
    """a ASOF [LEFT] JOIN b ON a.k = b.k AND a.t >= b.t (or USING (k, t)): both sides are planned,
    their rows meet in one sort, in ranges, and each left row takes the nearest right one
    (operators.ordered.nearest). The statement reads the result under the same names."""
    while m := re.search(_ASOF, sql, re.I):
        begin = _select_of(sql, m.start())
        source = _at_level(sql, r"\bfrom\b", begin, m.start()) + 4
        end = _level(sql, m.end())
        on = _at_level(sql, r"\bon\b|\busing\b", m.end(), end)
        using = sql[on : on + 5].lower() == "using"
        stop = _at_level(sql, _RELATION, on + (5 if using else 2), end)
        chain, right, seen = sql[source : m.start()].strip(), sql[m.end() : on].strip(), _ctes(sql, m.start())
        show = lambda x: _shown(x, kept)
        lefts, (name,) = _relations(spark, show(chain)), _relations(spark, show(right))
        if using:
            cols = [c.strip() for c in sql[on + 5 : stop].strip().strip("()").split(",")]
            pairs, rank = [(f"{lefts[0]}.{c}", f"{name}.{c}") for c in cols], ">="
        else:
            pairs, order = [], []
            for cond in re.split(r"\band\b", sql[on + 2 : stop], flags=re.I):
                x = re.match(r"^\s*([\w.]+)\s*(=|>=|>|<=|<)\s*([\w.]+)\s*$", cond)
                mine = x and x[3].lower().startswith(name.lower() + ".")
                if not x or mine == x[1].lower().startswith(name.lower() + "."):
                    raise SqlError("ASOF JOIN compares columns of both sides by name")
                sign = x[2] if mine else x[2].translate(str.maketrans("<>", "><"))
                (pairs if sign == "=" else order).append((x[1], x[3]) if mine else (x[3], x[1]))
                rank = sign if sign != "=" else locals().get("rank")
            if len(order) != 1:
                raise SqlError("ASOF JOIN needs exactly one inequality between columns of both tables")
            pairs += order
        *keys, (left_at, right_at) = pairs
        keyed = lambda k: "".join(f", {p[k]} AS __k{i}" for i, p in enumerate(keys))
        whole = lambda names: ", ".join(f"struct({n}.*) AS `{n}`" for n in names)
        a = planned(show(f"{seen}SELECT {whole(lefts)}{keyed(0)}, {left_at} AS __t FROM {chain}"))
        b = planned(show(f"{seen}SELECT {whole([name])}{keyed(1)}, {right_at} AS __t FROM {right}"))
        ks = [f"__k{i}" for i in range(len(keys))]
        got = nearest(a, b, ks, "__t", rank[0] == ">", len(rank) == 1)
        got = got.select(*(F.col(f"`{n}`") for n in lefts), F.col(f"match.`{name}`").alias(name))
        if (m[1] or "").lower() != "left":
            got = got.filter(F.col(f"`{name}`").isNotNull())
        view = f"__asof_{uuid.uuid4().hex[:12]}"
        allowed.add(view)
        parts = [*lefts, name]
        _view(spark, got.toDF(*(f"{view}_{i}" for i in range(len(parts)))), view)
        back = " ".join(
            f"JOIN LATERAL (SELECT {', '.join(f'{view}.{view}_{i}.`{f.name}` AS `{f.name}`' for f in got.schema[n].dataType.fields)}) AS {n}" for i, n in enumerate(parts)
        )
        hidden = ", ".join(f"{view}_{i}" for i in range(len(parts)))
        # a bare star doesn't show what the view's rows are made of
        star = r"((?:\bselect\s+(?:distinct\s+|all\s+)?|,\s*)\*)(\s*except\s*\()?"
        head = re.sub(star, lambda x: f"{x[1]} EXCEPT ({hidden}{', ' if x[2] else ')'}", sql[begin:source], flags=re.I)  # noqa: B023
        sql = f"{sql[:begin]}{head} {view} {back} {sql[stop:]}"
    return sql


def rewritten(spark: SparkSession, sql: str, tables: set[str]) -> tuple[str, set[str]]:
    """The statement without ASOF JOIN and UNION BY NAME, and the tables that it may read: those
    and what their operands became."""

    def planned(part: str) -> DataFrame:
        return plan(spark, part, allowed)

    text, kept = _hidden(sql)
    allowed = set(tables)
    if re.search(_ASOF, text, re.I):
        text = _asof(spark, text, planned, kept, allowed)
    if re.search(r"\bby\s+name\b", text, re.I):
        text = _by_name(spark, text, lambda part: planned(_shown(part, kept)).columns)
    return _shown(text, kept), allowed


def plan(spark: SparkSession, sql: str, tables: set[str]) -> DataFrame:
    """The checked statement as a DataFrame, without a row budget. The operands of an ASOF JOIN
    are checked and sorted here."""
    text, allowed = rewritten(spark, sql, tables)
    return spark.sql(check(spark, text, allowed))


def run(spark: SparkSession, sql: str, tables: set[str], limit: int | None = None, timeout_s: float = TIMEOUT_S) -> dict:
    """At most `limit` rows (1..500); the row budget is a limit in the plan. The job is
    cancelled when the time is up."""
    n = DEFAULT_ROWS if limit is None else limit
    if not isinstance(n, int) or isinstance(n, bool) or not 1 <= n <= MAX_ROWS:
        raise SqlError(f"limit must be an integer in [1, {MAX_ROWS}]")
    tag = f"packetloom-sql-{threading.get_ident()}-{id(sql)}"
    late = threading.Event()

    def stop():
        late.set()
        spark.interruptTag(tag)

    timer = threading.Timer(timeout_s, stop)
    spark.addTag(tag)
    timer.start()
    try:
        df = plan(spark, sql, tables)
        rows = df.limit(n + 1).collect()
    except SqlError:
        raise
    except Exception as e:
        if late.is_set():
            raise SqlError(f"query exceeded {timeout_s:g} s and was cancelled") from None
        raise SqlError(str(e).splitlines()[0][:500]) from None
    finally:
        timer.cancel()
        spark.removeTag(tag)
    return {"columns": df.columns, "rows": [r.asDict(recursive=True) for r in rows[:n]], "row_count": min(len(rows), n), "truncated": len(rows) > n}
