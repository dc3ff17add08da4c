"""Operator 9: URL rules over a Bloom filter cascade, in DataFrame functions only.

The cascade's levels encode, in turn, the listed keys and the other level's false positives over the
complete universe of keys, until a level has none. For any key of the universe the first level that
rejects it then tells membership exactly: an even level means listed, an odd one not listed. Levels are
arrays of 64-bit words which a scalar subquery hands to the scan, so pages are neither joined nor shuffled.
A universe whose cascade would be large is cut by hash into shards with a cascade each, and each shard's pages are judged by theirs alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ascii_lower, materialize, table

# The rules (verdict, host, path) of the query's contract.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: Bytes of a cascade's levels together that are sent to the executors, about; the universe is cut into as many shards as that takes.
MAX_CASCADE_BYTES = 32 << 20
MAX_LEVELS = 40


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls if none does."""
    rule = verdict = None
    for says, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule = (F if rule is None else rule).when(fits, F.lit(h + p))
        verdict = (F if verdict is None else verdict).when(fits, F.lit(says))
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


class Level:
    """One Bloom filter: m bits, k probes, words as a one-row table."""

    def __init__(self, number: int, n: int, p: float):
        self.number = number
        self.k = max(1, round(math.log2(1 / p)))
        self.m = max(64, 64 * math.ceil(n * math.log2(1 / p) / math.log(2) / 64))
        self.words: DataFrame | None = None

    def probes(self, key: Column) -> list[Column]:
        m = F.lit(self.m).cast("long")
        a = F.pmod(F.xxhash64(key, F.lit(2 * self.number)), m)
        b = F.pmod(F.xxhash64(key, F.lit(2 * self.number + 1)), m)
        return [F.pmod(a + F.lit(j).cast("long") * b, m) for j in range(self.k)]

    def fill(self, keys: DataFrame) -> None:
        spark = keys.sparkSession
        bits = keys.select(F.explode(F.array(*self.probes(F.col("key")))).alias("bit"))
        words = bits.select(F.expr("bit div 64").alias("w"), F.expr("shiftleft(1L, int(bit % 64))").alias("v"))
        zeros = spark.range(self.m // 64).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("v"))
        each = words.unionByName(zeros).groupBy("w").agg(F.bit_or("v").alias("v"))
        row = each.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "v"))), lambda x: x["v"]).alias("words"))
        self.words = materialize(row, f"level{self.number}")

    def passes(self, key: Column) -> Column:
        words = self.words.scalar()
        out = F.lit(True)
        for bit in self.probes(key):
            out = out & (F.getbit(F.element_at(words, (F.floor(bit / 64) + 1).cast("int")), F.pmod(bit, F.lit(64)).cast("int")) == 1)
        return out


class Cascade:
    """Exact membership among the universe's keys; keys outside the universe may err at the first level's rate."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    @property
    def size(self) -> int:
        return sum(x.m // 8 for x in self.levels)

    def contains(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for x in reversed(self.levels):
            out = F.when(~x.passes(key), F.lit(x.number % 2 == 0)).otherwise(out)
        return out


def build_cascade(universe: DataFrame, listed: int, others: int) -> Cascade:
    """universe: distinct (key, listed); listed, others: how many there are of each."""
    if not listed:
        return Cascade([])
    inside, outside = universe.filter("listed").select("key"), universe.filter("not listed").select("key")
    n, levels = listed, []
    for number in range(1, MAX_LEVELS + 1):
        level = Level(number, n, first_rate(listed, others) if number == 1 else 0.5)
        levels.append(level)
        level.fill(inside)
        wrong = materialize(outside.filter(level.passes(F.col("key"))), f"wrong{number}")
        n = wrong.count()
        if not n:
            return Cascade(levels)
        inside, outside = wrong, inside
    raise RuntimeError("the cascade didn't end; are keys distinct?")


def first_rate(listed: int, others: int) -> float:
    """The first level's rate of false positives that makes the whole smallest."""
    return min(0.5, max(2.0**-20, listed / (math.sqrt(2) * max(others, 1))))


def cascade_bytes(listed: int, others: int) -> int:
    """About how many bytes all levels take: the later ones hold about as much again as the listed keys at one and a half bits a key and round."""
    return math.ceil(listed * (math.log2(1 / first_rate(listed, others)) + 3) / math.log(2) / 8)


def filter_urls(pages: DataFrame, listed: Column, rules=RULES, max_bytes: int = MAX_CASCADE_BYTES) -> DataFrame:
    """Judge pages (page_id, url): page_id, host, path, rule, verdict.

    listed: a condition on the page that puts its key (host and path) on the block list; a key is listed
    if any of its pages meets it. The cascade is built over all keys of pages. Null or malformed urls have an
    empty host and path and the key "", which is judged like any other; a condition that is null lists nothing.
    Long urls are keys like others; of rules that fit the longest wins, and no two are as long. Repeated rows and repeated or null page ids each
    give a row; an empty table gives none; other columns of pages are ignored, whatever their names.
    """
    own = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.coalesce(listed, F.lit(False)).alias("listed"))
    key = F.concat("host", "path")
    universe = materialize(own.groupBy(key.alias("key")).agg(F.bool_or("listed").alias("listed")), "universe")
    counts = universe.agg(F.count(F.when(F.col("listed"), 1)).alias("r"), F.count(F.when(~F.col("listed"), 1)).alias("s")).first()
    shards = max(1, -(-cascade_bytes(counts.r, counts.s) // max_bytes))
    if shards == 1:
        judged = own.withColumn("member", build_cascade(universe, counts.r, counts.s).contains(key))
    else:
        shard, parts = lambda c: F.pmod(F.xxhash64(c, F.lit(-1)), F.lit(shards)), []
        sizes = {r.shard: r for r in universe.groupBy(shard(F.col("key")).alias("shard")).agg(F.count(F.when(F.col("listed"), 1)).alias("r"), F.count("*").alias("n")).collect()}  # one row a shard
        for i, c in sorted(sizes.items()):
            cascade = build_cascade(universe.filter(shard(F.col("key")) == i), c.r, c.n - c.r)
            parts.append(materialize(own.filter(shard(key) == i).withColumn("member", cascade.contains(key)), f"judged{i}"))
        judged = parts[0]
        for p in parts[1:]:
            judged = judged.unionByName(p)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    other = F.when(F.coalesce(F.col("member"), F.lit(False)), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, other).alias("verdict"))


#: The query's list: keys that were ever requested with a tracking parameter.
TRACKED = r"[?&]utm_source="


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed keys: host and path of every url that has a utm_source parameter."""
    return filter_urls(table(spark, sf_dir, "pages"), F.col("url").rlike(TRACKED))


OP9_SQL = r"""
WITH p AS (
  SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
k AS (SELECT host || path AS key, bool_or(coalesce(regexp_matches(url, '[?&]utm_source='), false)) AS listed FROM p GROUP BY 1),
r AS (
  SELECT page_id, host, path, host || path AS key,
    CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM p)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN k.listed THEN 'block' ELSE 'allow' END AS verdict
FROM r JOIN k USING (key)
"""
