"""Reports of GNU time, and their collation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The report's keys and our columns.
KEYS = {
    "Elapsed (wall clock) time (h:mm:ss or m:ss)": "wall_s", "User time (seconds)": "user_s", "System time (seconds)": "sys_s", "Percent of CPU this job got": "cpu_percent",
    "Maximum resident set size (kbytes)": "max_rss_kb", "Exit status": "exit_status",
}


def seconds(text: Column) -> Column:
    """h:mm:ss, m:ss or plain seconds."""
    parts = F.split(F.trim(text), ":")
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a * 60 + x.try_cast("double"))


def parsed(lines: DataFrame, *by: str) -> DataFrame:
    """One row per run of (by, line): the six fields, null where a report lacks one."""
    key, value = F.regexp_extract("line", r"^\s*(.*): ", 1), F.regexp_extract("line", r".*: (.*)$", 1)
    rows = lines.select(*by, key.alias("key"), F.trim(value).alias("value"))
    number = {"wall_s": seconds(F.col("value"))} | {c: F.rtrim(F.regexp_replace("value", "%$", "")).try_cast("double" if c in ("user_s", "sys_s") else "long") for c in KEYS.values() if c != "wall_s"}
    return rows.groupBy(*by).agg(*(F.max(F.when(F.col("key") == k, number[c])).alias(c) for k, c in KEYS.items()))


def collate(spark: SparkSession, root: str) -> DataFrame:
    """(sample, tool, rep, ...) of root/<sample>/<tool>/rep<N>/time.devnull.txt, ordered."""
    lines = spark.read.text(f"{root}/*/*/rep*/time.devnull.txt").select(F.input_file_name().alias("path"), F.col("value").alias("line"))
    names = F.split("path", "/")
    rows = parsed(lines, "path")
    return rows.select(F.element_at(names, -4).alias("sample"), F.element_at(names, -3).alias("tool"), F.regexp_extract("path", r"/rep(\d+)/", 1).cast("int").alias("rep"), *KEYS.values()).orderBy("sample", "tool", "rep")
