"""URL filter: pattern rules are indexed by their rarest literal token; the tokens of a url
fetch candidate rules and only those run their regular expressions."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import lower_ascii

#: The rules of the query. (verdict, host, path)
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Up to so many rules are held as one literal in the plan; more are joined by token.
LITERAL_RULES = 2000


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> str:
        """Over host and path together; a host has no slash."""
        quote = lambda s: re.sub(r"([^A-Za-z0-9/])", r"\\\1", s)
        return r"^(?:[^/]*\.)?" + quote(self.host) + ("" if self.path else r"(?:/|$)") + quote(self.path)

    def tokens(self) -> list[str]:
        """Literal tokens that any fitting url has. A path's last part is one only if a slash ends it."""
        return [t for t in self.host.split(".") + self.path.split("/")[:-1] if t]


def index(rules: list[Rule]) -> list[tuple[str, Rule]]:
    """(rarest token, rule); rarest among the rules, then the longest."""
    seen = Counter(t for r in rules for t in set(r.tokens()))
    return [(min(r.tokens(), key=lambda t: (seen[t], -len(t), t)), r) for r in rules]


def host_of(url: Column) -> Column:
    """After the first :// up to a slash, ?, # or the end, A-Z lower-cased; empty without ://."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _entry(token: str, rule: Rule) -> Column:
    return F.struct(F.lit(len(rule.name)).alias("len"), F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"), F.lit(rule.pattern).alias("pattern"))


def url_filter(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, otherwise: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict), one row for each row of pages, without a shuffle.

    The longest fitting rule decides (of equally long ones the greatest by code point);
    where none fits, rule is null and the verdict is `otherwise`. Null urls and those
    without :// have an empty host and path, and no rule. Other columns are not read, so
    they can't clash; repeated rows are judged alike, urls of any length are read whole, and an
    empty table gives an empty result. A rule without a literal token (an empty
    host and no directory) can't be indexed, so every url with :// fetches it; with many rules
    the others are joined by token and the verdicts are the same."""
    made = [Rule(*r) for r in rules]
    listed: dict[str, list] = {}
    for token, rule in index([r for r in made if r.tokens()]):
        listed.setdefault(token, []).append(_entry(token, rule))
    always = [_entry("", r) for r in made if not r.tokens()]
    if len(made) > LITERAL_RULES:
        return _joined(pages, made, always, otherwise, id_col, url_col)
    base = _parts(pages, id_col, url_col)
    none = F.array().cast("array<struct<len:int,rule:string,verdict:string,pattern:string>>")
    found = F.array(*always) if always else none
    if listed:
        book = F.create_map(*[x for t, rs in listed.items() for x in (F.lit(t), F.array(*rs))])
        found = F.concat(found, F.flatten(F.transform(_tokens(), lambda t: F.coalesce(F.try_element_at(book, t), none))))
    return _verdict(base.withColumn("__best", F.when(F.col("__known"), _best(found))), id_col, otherwise)


def _parts(pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    url = F.col(url_col)
    return pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"), F.coalesce(F.contains(url, F.lit("://")), F.lit(False)).alias("__known"))


def _tokens() -> Column:
    return F.array_distinct(F.concat(F.split("host", r"\."), F.split("path", "/")))


def _best(found: Column) -> Column:
    """Of the fetched rules that fit, the longest."""
    fits = F.filter(found, lambda r: F.rlike(F.concat("host", "path"), r["pattern"]))
    return F.array_max(F.transform(fits, lambda r: F.struct(r["len"], r["rule"], r["verdict"])))


def _verdict(rows: DataFrame, id_col: str, otherwise: str) -> DataFrame:
    return rows.select(id_col, "host", "path", F.col("__best.rule").alias("rule"), F.coalesce("__best.verdict", F.lit(otherwise)).alias("verdict"))


def _joined(pages: DataFrame, rules: list[Rule], always: list[Column], otherwise: str, id_col: str, url_col: str) -> DataFrame:
    """The same for many rules: distinct urls, exploded to tokens, meet the rules by token;
    those without a token (`always`) are judged on each distinct url. A very frequent token
    has few rules, for it is nobody's rarest; AQE splits it otherwise."""
    spark = pages.sparkSession
    book = spark.createDataFrame([(t, len(r.name), r.name, r.verdict, r.pattern) for t, r in index([r for r in rules if r.tokens()])], "token string, len int, rule string, verdict string, pattern string")
    base = _parts(pages, id_col, url_col)
    urls = base.filter("__known").select("host", "path").distinct()
    best = urls.withColumn("token", F.explode(_tokens())).join(book, "token").filter(F.rlike(F.concat("host", "path"), F.col("pattern"))).select("host", "path", F.struct("len", "rule", "verdict").alias("__r"))
    if always:
        best = best.unionByName(urls.select("host", "path", _best(F.array(*always)).alias("__r")).filter("__r is not null"))
    best = best.groupBy("host", "path").agg(F.max("__r").alias("__best")).withColumn("__known", F.lit(True))
    return _verdict(base.join(best, ["host", "path", "__known"], "left"), id_col, otherwise)


def op9(spark, sf_dir):
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"))


ORACLE = r"""
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (
  SELECT u.*, (SELECT max({'n': length(rhost || rpath), 'rule': rhost || rpath, 'verdict': verdict}) FROM r
               WHERE (u.host = rhost OR ends_with(u.host, '.' || rhost)) AND starts_with(u.path, rpath)) AS best
  FROM u)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM m
"""
