"""From marks back to records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.flags import DUPLICATE, FIRST, LAST, NOT_PRIMARY, UNMAPPED, has


def flagged(rows: DataFrame, marks: DataFrame, remove: bool = False, late: bool = False) -> DataFrame:
    """rows with the duplicate bit overwritten by their template's mark, or without duplicates' rows. marks: (ord, dup), and class if late,
    which adds the column late: 1 for fragments' rows, 0 for others."""
    own = marks if late else marks.filter("dup")
    own = own.select("ord", F.col("dup").alias("_dup"), *([(F.col("class") == "fragment").cast("int").alias("late")] if late else []))
    out = rows.join(own, "ord", "left")
    dup = F.coalesce("_dup", F.lit(False))
    if remove:
        out = out.filter(~dup)
    bit = F.when(dup, F.lit(DUPLICATE)).otherwise(F.lit(0))
    flag = F.col("flag").bitwiseAND(~DUPLICATE).bitwiseOR(bit)
    return out.select(*(flag.alias(c) if c == "flag" else c for c in rows.columns), *([F.coalesce("late", F.lit(0)).alias("late")] if late else []))


def in_order(rows: DataFrame) -> DataFrame:
    """Rows in input order; those of fragments after all others if there is a column late, as an exact run writes them."""
    if "late" not in rows.columns:
        return rows.orderBy("ord", "rec_idx")
    return rows.orderBy("late", "ord", "rec_idx").drop("late")


def name_key(qname: Column) -> Column:
    """A text that sorts like the name with its runs of digits as numbers."""
    parts = F.regexp_extract_all(qname, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    number = lambda x: F.regexp_replace(x, "^0+(?=.)", "")
    # 254 characters are the longest name, so three digits hold a number's length
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike("^[0-9]"), F.concat(F.lpad(F.length(number(x)).cast("string"), 3, "0"), number(x))).otherwise(x)), "")


def by_name(rows: DataFrame) -> DataFrame:
    """Rows without the duplicate bit, grouped by name: names in natural order, first ends before second ones, primary rows before others."""
    out = rows.withColumn("flag", F.col("flag").bitwiseAND(~DUPLICATE))
    return out.orderBy(name_key(F.col("qname")), "qname", has(F.col("flag"), LAST), has(F.col("flag"), NOT_PRIMARY), "ord", "rec_idx")


def by_coordinate(rows: DataFrame, contigs: DataFrame) -> DataFrame:
    """Rows by contig, in the header's order, and position; those without a contig come last."""
    place = contigs.select(F.col("name").alias("rname"), F.col("seq_num").alias("_place"))
    return rows.join(F.broadcast(place), "rname", "left").orderBy(F.col("_place").asc_nulls_last(), "pos", "ord", "rec_idx").select(*rows.columns)


def with_mate_tags(rows: DataFrame, classified: DataFrame) -> DataFrame:
    """rows with mc and mq filled, where they were null, from the mate's CIGAR and mapping quality.

    Only templates with both ends get any; an end gets them if its mate is mapped, on all its rows.
    """
    ends = classified.filter("class in ('pair', 'fragment') and first is not null and second is not null").select("ord", F.col("first").alias("_f"), F.col("second").alias("_s"))
    for name, kind in (("mc", "string"), ("mq", "long")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    joined = rows.join(ends, "ord", "left")
    bit = lambda c: has(c, FIRST)
    own = bit(F.col("flag"))
    # if both ends have the same bit, the second direction only fills what the first left
    source = lambda field: F.coalesce(
        F.when((own == bit(F.col("_f.flag"))) & ~has(F.col("_s.flag"), UNMAPPED), F.col(f"_s.{field}")), F.when((own == bit(F.col("_s.flag"))) & ~has(F.col("_f.flag"), UNMAPPED), F.col(f"_f.{field}"))
    )
    out = joined.withColumns({"mc": F.coalesce("mc", source("cigar")), "mq": F.coalesce("mq", source("mapq").cast("long"))})
    return out.select(*rows.columns)


def numbered(rows: DataFrame, by: list[str], width: int = 1 << 16, name: str = "place") -> DataFrame:
    """Number rows from 1 in the order of by, whose last but one column is a template's ord: by place within pieces of width templates, plus the rows of the
    pieces before. Only one count per piece is gathered, and no branch depends on where another's sort put its bounds."""
    from pyspark.sql import Window

    *front, order, _ = by
    piece = rows.withColumn("_piece", F.expr(f"{order} div {width}"))
    parts = [*front, "_piece"]
    counts = piece.groupBy(*parts).agg(F.count("*").alias("_n"))
    before = counts.select(*parts, F.coalesce(F.sum("_n").over(Window.orderBy(*parts).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = piece.withColumn("_row", F.row_number().over(Window.partitionBy(*parts).orderBy(*by)))
    return own.join(before, parts).withColumn(name, F.col("_before") + F.col("_row")).select(*rows.columns, name)
