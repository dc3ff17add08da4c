"""Alignments derived from the table orders: one template per order, in the order of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The dimensions that go with the derived alignments.
CONTIGS = (("chr1", 100_000, 1), ("chr2", 50_000, 2))
READ_GROUPS = (("rgA", "s1", "lib1"), ("rgB", "s1", "lib1"), ("rgC", "s2", "lib2"))
MAX_READ_LENGTH = 1000


def contigs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONTIGS, "name string, length int, seq_num int")


def read_groups(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(READ_GROUPS, "id string, sample string, library string")


_TEMPLATE = """
  o_orderkey AS k, o_orderkey % 20 AS cls, 100 + ((o_custkey * 31 + o_orderkey % 7) % 1999) * 10 AS locus, 100 + (o_orderkey % 3) * 10 AS ins,
  o_orderkey % 4 AS s, o_orderkey % 3 AS e, CASE WHEN o_custkey % 2 = 0 THEN 'chr1' ELSE 'chr2' END AS chr, CASE WHEN o_custkey % 2 = 0 THEN 'chr2' ELSE 'chr1' END AS ochr,
  CASE o_custkey % 5 WHEN 0 THEN 'rgA' WHEN 1 THEN 'rgB' WHEN 2 THEN 'rgC' WHEN 3 THEN 'rgX' END AS rg
"""
_ENDS = """
  *, CASE WHEN k % 1009 = 0 THEN '2000H50M' WHEN s > 0 THEN concat(CAST(s AS STRING), 'S', CAST(50 - s AS STRING), 'M') ELSE '50M' END AS lcig,
  CASE WHEN k % 1009 = 0 THEN 1 ELSE locus + s END AS lpos,
  CASE WHEN k % 29 = 0 THEN '20M2D28M' WHEN e > 0 THEN concat(CAST(50 - e AS STRING), 'M', CAST(e AS STRING), 'S') ELSE '50M' END AS rcig,
  CASE WHEN k % 29 = 0 THEN locus + ins - 2 ELSE locus + ins END AS rpos, CASE WHEN k % 23 = 0 THEN ochr ELSE chr END AS rchr
"""
# condition, rec_idx, flag, rname, pos, mapq, cigar
_RECORDS = (
    ("cls > 6", "0", "CASE WHEN k % 13 = 0 THEN 163 WHEN k % 17 = 0 THEN 67 ELSE 99 END", "chr", "lpos", "60", "lcig"),
    ("cls > 6", "1", "CASE WHEN k % 13 = 0 THEN 83 WHEN k % 17 = 0 THEN 131 ELSE 147 END", "rchr", "rpos", "k % 61", "rcig"),
    ("cls > 6 AND k % 7 = 0", "2", "2113", "ochr", "locus + 500", "30", "'25S25M'"),
    ("cls > 6 AND k % 11 = 0", "3", "355", "ochr", "locus + 900", "0", "'50M'"),
    ("cls IN (0, 1)", "0", "CASE WHEN k % 40 < 20 THEN 73 ELSE 89 END", "chr", "lpos", "60", "lcig"),
    ("cls IN (0, 1)", "1", "133", "chr", "lpos", "0", "'*'"),
    ("cls IN (2, 3)", "0", "CASE WHEN k % 40 < 20 THEN 0 ELSE 16 END", "chr", "lpos", "60", "lcig"),
    ("cls = 4", "0", "4", "'*'", "0", "0", "'*'"),
    ("cls = 5", "0", "73", "chr", "lpos", "60", "lcig"),
    ("cls = 6", "0", "77", "'*'", "0", "0", "'*'"),
    ("cls = 6", "1", "141", "'*'", "0", "0", "'*'"),
)


def alignments(orders: DataFrame) -> DataFrame:
    """(ord, rec_idx, qname, flag, rname, pos, mapq, cigar, rg): one scan, each order makes its records."""
    rows = orders.selectExpr(*_split(_TEMPLATE)).selectExpr(*_split(_ENDS))
    each = [
        f"IF({when}, named_struct('rec_idx', int({i}), 'flag', int({flag}), 'rname', {rname}, 'pos', int({pos}), 'mapq', int({mapq}), 'cigar', {cigar}), NULL)"
        for when, i, flag, rname, pos, mapq, cigar in _RECORDS
    ]
    made = rows.select("k", "rg", F.inline(F.filter(F.expr(f"array({', '.join(each)})"), lambda x: x.isNotNull())))
    return made.select(F.col("k").cast("long").alias("ord"), "rec_idx", F.concat(F.lit("q"), F.col("k").cast("string")).alias("qname"), "flag", "rname", "pos", "mapq", "cigar", "rg")


def _split(text: str) -> list[str]:
    """Expressions of a select list, cut at commas outside of parentheses."""
    out, depth, part = [], 0, ""
    for c in text.strip():
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(part.strip())
            part = ""
        else:
            part += c
    return [*out, part.strip()]


#: The same rows in DuckDB SQL.
SQL = f"""
  SELECT CAST(k AS BIGINT) AS ord, CAST(rec_idx AS INT) AS rec_idx, concat('q', CAST(k AS STRING)) AS qname, CAST(flag AS INT) AS flag, rname, CAST(pos AS INT) AS pos,
    CAST(mapq AS INT) AS mapq, cigar, rg FROM (
  {" UNION ALL ".join(f"SELECT k, {i} AS rec_idx, {flag} AS flag, {rname} AS rname, {pos} AS pos, {mapq} AS mapq, {cigar} AS cigar, rg FROM lr WHERE {when}" for when, i, flag, rname, pos, mapq, cigar in _RECORDS)}
  ) u
"""
PREFIX = f"t AS (SELECT {_TEMPLATE} FROM orders), lr AS (SELECT {_ENDS} FROM t), al AS ({SQL})"
