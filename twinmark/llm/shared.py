"""What several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.workspace import folder

# The white space of the contracts, [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"
WHITE_BYTES = WHITE.encode()
# ASCII capitals and their small letters.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

def materialize(df: DataFrame, name: str, level: int = 3) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors. level: zstd's, of 1 to 22."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}"
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[id(out)] = (out, path)
    return out


_written: dict[int, tuple[DataFrame, str]] = {}


def forget(*written: DataFrame) -> None:
    """Delete what materialize wrote for these, which nothing reads any more."""
    for df in written:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(_written.pop(id(df))[1])
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: spread_join: keys that are broadcast at most, and rows from which on they are.
SPREAD_KEYS, SPREAD_ROWS = 50_000, 4096


def spread_join(many: DataFrame, few: DataFrame, on: list[str], total: int, how: str = "inner") -> DataFrame:
    """many joined (inner or left) with few, which was written and has in rows the number of many's rows that meet each of its keys; total: many's rows.

    Keys with many rows are broadcast, so that their rows stay where they are: at most SPREAD_KEYS keys have more than total / SPREAD_KEYS rows.
    """
    most = max(SPREAD_ROWS, total // SPREAD_KEYS)
    hot = few.filter(F.col("rows") > most)
    if not hot.take(1):
        return many.join(few, on, how)
    rest = many.join(F.broadcast(hot.select(*on).distinct()), on, "left_anti").join(few.filter(F.col("rows") <= most), on, how)
    return many.join(F.broadcast(hot), on).unionByName(rest)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, UPPER, LOWER)


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def shards(df: DataFrame, least: int = 8) -> int:
    """How many partitions an exchange gets: the session's setting, which belongs to the cluster and the input's size."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
