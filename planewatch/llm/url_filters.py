"""Allow and block rules for urls, and exact block lists held in a cascade of Bloom filters.

The key universe is every distinct host of the pages. The first filter encodes the listed keys; the
second the unlisted keys that the first lets through; the third the listed keys that the second lets
through, and so on until a level lets nothing wrong through. For every key of the universe the first
level that says no then tells exactly whether it is listed, without a join.

Filters are arrays of 64-bit words made by an aggregation and read as scalar subqueries. A list that
needs more than ``MOST_BITS`` is cut into parts by a hash of the key, each with its own cascade, and
the parts are applied one after the other, so that no task ever holds more than one.

Only DataFrame functions are used. Defined cases: a null url or one without ``://`` has an empty host
and path, fits no rule and is tested as the key ''; null or repeated page_ids are judged row by row;
a very long url is a key like any other; of rules that fit equally long ones cannot differ;
null keys of the list are ignored, keys that no page has change nothing; an empty list allows all; an
empty table gives an empty result; columns other than page_id and url play no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planewatch.llm.words import stored, table

HASHES, FIRST_BITS, LATER_BITS, MOST_BITS, MOST_RULES = 4, 12, 8, 1 << 26, 500
# The rules of the query (verdict, host, start of the path).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
# Labels whose hosts the query lists.
LISTED_LABELS = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_host_and_path(pages: DataFrame) -> DataFrame:
    url = F.coalesce("url", F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(coalesce(url, ''), instr(coalesce(url, ''), '://') + 3)")).otherwise("")
    split = pages.select("page_id", rest.alias("rest")).withColumn("raw_host", F.regexp_extract("rest", "^[^/?#]*", 0))
    path = F.regexp_extract(F.expr("substring(rest, length(raw_host) + 1)"), "^[^?#]*", 0)
    return split.select("page_id", F.translate("raw_host", UPPER, LOWER).alias("host"), path.alias("path"))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]], what: int) -> Column:
    """Of the longest rule that fits: its text (what = 1) or its verdict (what = 0)."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    out = F.lit(None).cast("string")
    for verdict, top, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == top) | host.endswith("." + top)) & path.startswith(start)
        out = F.when(fits, F.lit((verdict, top + start)[what])).otherwise(out)
    return out


def _places(key: Column, level: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(j)), F.lit(bits)) for j in range(HASHES)]


class Cascade:
    """Exact membership of the keys of a universe in a list."""

    def __init__(self, universe: DataFrame, listed: DataFrame) -> None:
        """universe: key, distinct; listed: key, distinct."""
        inside = stored(universe.join(listed, "key", "left_semi"), "cascade-listed")
        outside = stored(universe.join(listed, "key", "left_anti"), "cascade-others")
        self.levels: list[tuple[DataFrame, int]] = []
        n = inside.count()
        while n:
            level, bits = len(self.levels), 64 * max(1, math.ceil(n * (LATER_BITS if self.levels else FIRST_BITS) / 64))
            self.levels.append((stored(self._filter(inside, level, bits), "cascade-level"), bits))
            passing = stored(outside.where(self._passes(F.col("key"), level)), "cascade-passing")
            inside, outside = passing, inside
            n = inside.count()

    def _filter(self, keys: DataFrame, level: int, bits: int) -> DataFrame:
        place = keys.select(F.explode(F.array(*_places(F.col("key"), level, bits))).alias("place"))
        words = place.select(F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, CAST(place & 63 AS INT))").alias("bit"))
        words = words.groupBy("word").agg(F.bit_or("bit").alias("bits"))
        every = keys.sparkSession.range(bits // 64).withColumnRenamed("id", "word").join(words, "word", "left")
        return every.agg(F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))).alias("w")).select(F.col("w.bits").alias("words"))

    def _passes(self, key: Column, level: int) -> Column:
        filter_, bits = self.levels[level]
        words = filter_.scalar()
        out = F.lit(True)
        for place in _places(key, level, bits):
            out = out & (F.getbit(F.get(words, F.shiftright(place, 6).cast("int")), place.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return out

    def holds(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for level in range(len(self.levels) - 1, -1, -1):
            out = F.when(self._passes(key, level), out).otherwise(F.lit(level % 2 == 1))
        return out


def with_listed(rows: DataFrame, listed: DataFrame, key: str, most_bits: int = MOST_BITS) -> DataFrame:
    """``rows`` with the column ``listed``: is ``key`` (never null) one of ``listed.key``?"""
    universe = stored(rows.select(F.col(key).alias("key")).distinct(), "universe")
    listed = stored(listed.select("key").where("key is not null").distinct(), "listed")
    parts = max(1, math.ceil(listed.count() * FIRST_BITS / most_bits))
    part = lambda name: F.pmod(F.xxhash64(name, F.lit(-1)), F.lit(parts))
    rows = rows.withColumn("listed", F.lit(False))
    for p in range(parts):
        cascade = Cascade(universe.where(part("key") == p), listed.where(part("key") == p))
        mine = cascade.holds(F.col(key))
        rows = rows.withColumn("listed", mine if parts == 1 else F.when(part(key) == p, mine).otherwise(F.col("listed")))
        if parts > 1:
            rows = stored(rows, "listed-rows")
    return rows


def judged(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, one row per row of ``pages``; listed: key (a host)."""
    marked = with_listed(with_host_and_path(pages), listed, "host")
    host, path = F.col("host"), F.col("path")
    method = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return marked.select("page_id", "host", "path", rule_of(host, path, rules, 1).alias("rule"), F.coalesce(rule_of(host, path, rules, 0), method).alias("verdict"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list holds the hosts, of all hosts in the table, that have one of ``LISTED_LABELS``."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    hosts = with_host_and_path(pages).select(F.col("host").alias("key")).distinct()
    return judged(pages, RULES, hosts.where(F.arrays_overlap(F.split("key", r"\."), F.array(*map(F.lit, LISTED_LABELS)))))


SQL = f"""
WITH r AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM r), p AS (
  SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h
), rules(verdict, top, start) AS (VALUES {", ".join(map(str, RULES))}), fit AS (
  SELECT page_id, host, path, arg_max(top || start, length(top || start)) AS rule, arg_max(verdict, length(top || start)) AS v
  FROM p JOIN rules ON (host = top OR ends_with(host, '.' || top)) AND starts_with(path, start) GROUP BY ALL
)
SELECT p.page_id, p.host, p.path, rule,
  coalesce(v, CASE WHEN list_has_any(string_split(p.host, '.'), {LISTED_LABELS}) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN (SELECT DISTINCT page_id, host, path, rule, v FROM fit) f ON f.page_id = p.page_id AND f.host = p.host AND f.path = p.path
"""
