"""Per-library metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import __version__
from .headers import ALL

# The report's columns; the counters among them.
COUNTERS = ("total_templates", "duplicate_templates", "mapped_pairs", "duplicate_pairs", "mapped_orphans", "duplicate_orphans", "unmapped_orphans", "unmapped_pairs", "unmated_templates")
COLUMNS = (
    "sample", "library", "version", "total_templates", "duplicate_templates", "frac_duplicates", "mapped_pairs", "duplicate_pairs", "mapped_orphans", "duplicate_orphans",
    "unmapped_orphans", "unmapped_pairs", "unmated_templates", "estimated_library_size",
)


def _counters() -> list[Column]:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long"))
    of = lambda kind, c: total(F.when(F.col("class") == kind, F.col(c)))
    return [
        total(F.col("n")).alias("total_templates"), total(F.col("dups")).alias("duplicate_templates"), of("pair", "n").alias("mapped_pairs"), of("pair", "dups").alias("duplicate_pairs"),
        of("fragment", "n").alias("mapped_orphans"), of("fragment", "dups").alias("duplicate_orphans"), of("unmapped_orphan", "n").alias("unmapped_orphans"),
        of("both_unmapped", "n").alias("unmapped_pairs"), of("unmated", "n").alias("unmated_templates"),
    ]


def library_stats(counts: DataFrame) -> DataFrame:
    """One row per library. counts: (library, lib_idx, class, n, dups) of keys or of anything else that adds up."""
    return counts.groupBy("library", "lib_idx").agg(*_counters()).drop("lib_idx")


def library_stats_rollup(counts: DataFrame) -> DataFrame:
    """The libraries' rows and their sum, All Reads."""
    total = F.grouping("library") == 1
    return counts.rollup("library").agg(total.alias("_total"), *_counters()).select(F.when(F.col("_total"), F.lit(ALL)).otherwise(F.col("library")).alias("library"), *COUNTERS)


def frac_duplicates() -> Column:
    reads = F.col("mapped_orphans") + 2 * F.col("mapped_pairs")
    return F.when(reads == 0, F.lit(0.0)).otherwise((F.col("duplicate_orphans") + 2 * F.col("duplicate_pairs")) / F.nullif(reads, F.lit(0).cast("long"))).cast("double")


def library_size(pairs: Column, unique: Column) -> Column:
    """Lander-Waterman estimate of the different molecules, by bisection; null without pairs or duplicates."""
    n, c = pairs.cast("double"), unique.cast("double")
    over = lambda x: c / (x * c) - 1 + F.exp(-n / (x * c))
    high = F.aggregate(F.sequence(F.lit(1), F.lit(300)), F.lit(100.0), lambda h, _: F.when(over(h) > 0, h * 10).otherwise(h))
    start = F.struct(F.lit(1.0).alias("lo"), high.alias("hi"), F.lit(False).alias("done"))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        v = over(mid)
        done = s["done"] | (v == 0)
        return F.struct(F.when(~done & (v > 0), mid).otherwise(s["lo"]).alias("lo"), F.when(~done & (v < 0), mid).otherwise(s["hi"]).alias("hi"), done.alias("done"))

    size = F.aggregate(F.sequence(F.lit(1), F.lit(40)), start, halve, lambda s: c * (s["lo"] + s["hi"]) / 2)
    return F.when((pairs > 0) & (unique < pairs) & (unique > 0), size.cast("long")).when((pairs > 0) & (unique == 0), F.lit(0).cast("long"))


def metrics_rows(counts: DataFrame, sample: DataFrame) -> DataFrame:
    """The report's rows, in the order of libraries, unknown ones first: each library with templates, or one row All Reads of zeros."""
    size = library_size(F.col("mapped_pairs"), F.col("mapped_pairs") - F.col("duplicate_pairs"))
    rows = counts.groupBy("library", "lib_idx").agg(*_counters())
    none = counts.agg(F.count("*").alias("_n")).filter("_n = 0").select(F.lit(ALL).alias("library"), F.lit(0).alias("lib_idx"), *(F.lit(0).cast("long").alias(c) for c in COUNTERS))
    rows = rows.unionByName(none).join(F.broadcast(sample))
    rows = rows.withColumns({"version": F.lit(__version__), "frac_duplicates": frac_duplicates(), "estimated_library_size": size})
    return rows.orderBy("lib_idx").select(*COLUMNS)


def clamped_templates(keyed: DataFrame) -> DataFrame:
    """One row, clamped: templates with an end beyond its contig's padding."""
    return keyed.agg(F.count(F.when(F.col("clamped"), 1)).alias("clamped"))
