"""SAM text: scan with line numbers, parsed records, and a sink.

Lines are read by Spark's text source, from any file system it knows. Their numbers come from the block they were read in and their
place there: only one row per block is gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sam_fields
from ..operators import templates


def numbered(rows: DataFrame, blocks: list[str], place: str) -> DataFrame:
    """Add line_no, from 0, in the order of blocks and place; within a block, places are consecutive."""
    sizes = rows.groupBy(*blocks).agg(F.count("*").alias("_n"), F.min(place).alias("_least"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(*blocks).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = sizes.withColumn("_before", before).drop("_n")
    return rows.join(first, blocks).withColumn("line_no", F.col("_before") + F.col(place) - F.col("_least")).drop("_before", "_least")


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of all lines of the file or files, in name order."""
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"), "value"
    )
    return numbered(rows, ["_file", "_start"], "_id").select("line_no", "value")


def header_lines(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("value").startswith("@"))


def records(lines: DataFrame) -> DataFrame:
    """Parsed alignment lines: line_no, the eleven fields, aux (texts) and error (null if the line is fine). Empty lines are skipped."""
    body = lines.filter(~F.col("value").startswith("@") & (F.regexp_replace("value", "\r$", "") != ""))
    parsed = sam_fields.parse(F.col("value"))
    return body.select("line_no", *(c.alias(n) for n, c in parsed.items()))


def check(records_: DataFrame) -> None:
    wrong = records_.filter("error is not null").orderBy("line_no").limit(1).collect()
    if wrong:
        raise ValueError(f"line {wrong[0].line_no + 1}: {wrong[0].error}")


def lifted(rows: DataFrame) -> DataFrame:
    """Add rg, mc, mq and kf: the first aux value of each tag."""
    first = lambda tag: F.get(F.filter("aux", lambda x: F.substring(x, 1, 3) == f"{tag}:"), F.lit(0))
    value = lambda tag: F.substr(first(tag), F.lit(6))
    return rows.withColumns({"rg": value("RG"), "mc": value("MC"), "mq": value("MQ").try_cast("long"), "kf": value("kf")})


def blocks(records_: DataFrame) -> DataFrame:
    """Add ord and rec_idx: the template of consecutive rows of one name, and the place in it."""
    runs = templates.group_runs(records_)
    return runs.withColumn("rec_idx", (F.row_number().over(Window.partitionBy("ord").orderBy("line_no")) - 1).cast("int"))


def aux_with_mates(rows: DataFrame) -> DataFrame:
    """aux with MC and MQ from the columns mc and mq where it has none."""
    has = lambda tag: F.exists("aux", lambda x: F.substring(x, 1, 3) == f"{tag}:")
    own = lambda tag, kind, c: F.when(F.col(c).isNotNull() & ~has(tag), F.array(F.concat(F.lit(f"{tag}:{kind}:"), F.col(c).cast("string")))).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("aux", F.concat("aux", own("MC", "Z", "mc"), own("MQ", "i", "mq")))


def lines_of(rows: DataFrame) -> DataFrame:
    """SAM lines of records, in their order."""
    fields = [F.col(c).cast("string") for c in sam_fields.FIELDS]
    return rows.select(F.concat_ws("\t", *fields, F.when(F.size("aux") > 0, F.array_join("aux", "\t"))).alias("value"))


def write(rows: DataFrame, path: str, header: list[str]) -> None:
    """A folder of text parts, the header's first."""
    spark = rows.sparkSession
    head = spark.createDataFrame([("\n".join(header),)], "value string").coalesce(1)
    head.union(lines_of(rows)).write.text(path)
