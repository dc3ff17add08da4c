"""Header dimensions: contigs, read groups, libraries and programs. All are as small as a file's header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNKNOWN, ALL = "Unknown Library", "All Reads"

CONTIGS = "name string, length int, seq_num int"
READ_GROUPS = "id string, sample string, library string"
PROGRAMS = "id string, pn string, vn string, pp string, cl string"


def parse_header(lines: DataFrame) -> DataFrame:
    """Header lines (line_no, value) as (line_no, record, tag, value): one row per tag; @CO lines have the tag ""."""
    body = lines.filter(F.col("value").startswith("@")).withColumn("value", F.regexp_replace("value", "\r$", ""))
    parts = F.split("value", "\t")
    rows = body.select("line_no", F.substring(F.get(parts, F.lit(0)), 2, 2).alias("record"), "value", F.explode_outer(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).alias("field"))
    comment = F.col("record") == "CO"
    return rows.select(
        "line_no", "record", F.when(comment, F.lit("")).otherwise(F.substring("field", 1, 2)).alias("tag"),
        F.when(comment, F.col("field")).otherwise(F.substr("field", F.lit(4))).alias("value"),
    )


def _tags(header: DataFrame, record: str, **tags: str) -> DataFrame:
    rows = header.filter(F.col("record") == record).groupBy("line_no")
    return rows.agg(*(F.max(F.when(F.col("tag") == tag, F.col("value"))).alias(name) for name, tag in tags.items()))


def contigs(header: DataFrame) -> DataFrame:
    """(name, length, seq_num), numbered from 1 in header order."""
    from pyspark.sql import Window

    rows = _tags(header, "SQ", name="SN", length="LN")
    return rows.select("name", F.col("length").cast("int").alias("length"), F.row_number().over(Window.orderBy("line_no")).alias("seq_num"))


def read_groups(header: DataFrame) -> DataFrame:
    return _tags(header, "RG", id="ID", sample="SM", library="LB").drop("line_no")


def programs(header: DataFrame) -> DataFrame:
    return _tags(header, "PG", id="ID", pn="PN", vn="VN", pp="PP", cl="CL").drop("line_no")


def buckets(groups: DataFrame, unaware: bool = False) -> list[str]:
    """Library names by bucket. One if there are fewer than two libraries or they are not told apart; else 0 is for unknown ones and the others are sorted."""
    names = sorted({r.library for r in groups.select("library").distinct().collect() if r.library}, key=lambda x: x.encode())
    if unaware or len(names) < 2:
        return [ALL if len(names) >= 2 else names[0] if names else UNKNOWN]
    return [UNKNOWN, *names]


def library_index(groups: DataFrame, unaware: bool = False) -> DataFrame:
    """(library, lib_idx) of all buckets."""
    return groups.sparkSession.createDataFrame([(n, i) for i, n in enumerate(buckets(groups, unaware))], "library string, lib_idx int")


def with_bucket(rows: DataFrame, groups: DataFrame, names: list[str]) -> DataFrame:
    """Add lib_idx by the column rg; unknown, missing or nameless read groups get bucket 0. With one bucket no read group is looked up."""
    if len(names) == 1:
        return rows.withColumn("lib_idx", F.lit(0))
    place = {n: i for i, n in enumerate(names)}
    known = [(r.id, place[r.library]) for r in groups.select("id", "library").collect() if r.library]
    dims = rows.sparkSession.createDataFrame(known, "rg string, _idx int")
    return rows.join(F.broadcast(dims), "rg", "left").select(*rows.columns, F.coalesce("_idx", F.lit(0)).alias("lib_idx"))


def bucket_name(names: list[str]) -> Column:
    return F.get(F.array(*(F.lit(n) for n in names)), F.col("lib_idx"))


def sample_names(groups: DataFrame, override: str | None = None) -> DataFrame:
    """One row, sample: the override, or the different non-empty names, sorted and joined by commas."""
    joined = F.array_join(F.array_sort(F.collect_set(F.when(F.col("sample") != "", F.col("sample")))), ",")
    return groups.agg((F.lit(override) if override is not None else joined).alias("sample"))


def dangling_programs(programs_: DataFrame) -> DataFrame:
    """Programs whose predecessor isn't there."""
    ids = programs_.select(F.col("id").alias("pp"))
    return programs_.filter("pp is not null").join(ids, "pp", "left_anti").select("id", "pp")


def leaf_programs(programs_: DataFrame) -> DataFrame:
    """Programs that are nobody's predecessor."""
    return programs_.select("id").join(programs_.select(F.col("pp").alias("id")), "id", "left_anti")


def with_program(spark: SparkSession, programs_: DataFrame, name: str, version: str, command: str) -> DataFrame:
    """programs_ with this program after each leaf. A taken id gets the leaf's id as a suffix; a dangling predecessor is a ValueError."""
    wrong = dangling_programs(programs_).limit(1).collect()
    if wrong:
        raise ValueError(f"@PG ID:{wrong[0].id} has PP:{wrong[0].pp}, which is no program's ID")
    ids = {r.id for r in programs_.select("id").collect()}
    leaves = sorted(r.id for r in leaf_programs(programs_).collect())
    rows = []
    for leaf in leaves or [None]:
        own = name if name not in ids else f"{name}-{leaf}"
        ids.add(own)
        rows.append((own, name, version, leaf, command))
    return programs_.select("id", "pn", "vn", "pp", "cl").union(spark.createDataFrame(rows, PROGRAMS))
