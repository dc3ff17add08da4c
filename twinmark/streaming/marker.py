"""Marking as a stream: the first template with a key, by arrival, wins; keys are kept for good."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

OUTPUT = StructType([StructField("ord", LongType()), StructField("library", StringType()), StructField("dup", BooleanType())])
_STATE = StructType([StructField("first", LongType())])


class FirstWins(StatefulProcessor):
    """Rows of one key: (library, key, ord, is_pair, emit). Within a batch the smallest ord comes first."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        df = pd.concat(list(rows)).sort_values("ord")
        first = self.first.get()[0] if self.first.exists() else None
        if first is None:
            first = int(df["ord"].iloc[0])
            self.first.update((first,))
        out = df[df["emit"]]
        yield pd.DataFrame({"ord": out["ord"].astype("int64"), "library": out["library"], "dup": out["ord"] != first})

    def close(self) -> None:
        pass


def events(keyed: DataFrame, strategy: str = "strand-aware") -> DataFrame:
    """Keyed templates as rows (library, key, ord, emit) whose key's first row wins. The exact strategy needs all pairs first, so it has no stream."""
    if strategy == "picard-exact":
        raise ValueError("the exact strategy is for batches")
    pair = F.col("class") == "pair"
    s = lambda c: F.col(c).cast("string")
    row = lambda key, emit: F.struct(key.alias("key"), F.lit(emit).alias("emit"))
    fragment = F.array(row(F.concat(F.lit("f:"), s("lk" if strategy == "samblaster-legacy" else "k")), True))
    whole = row(F.concat_ws(":", F.lit("p"), s("a"), s("b")), True)
    ends = [row(F.concat(F.lit("f:"), s(c)), False) for c in ("a", "b")] if strategy == "picard-approx" else []
    rows = keyed.select("library", "ord", F.explode(F.when(pair, F.array(whole, *ends)).otherwise(fragment)).alias("e"))
    return rows.select("library", F.concat_ws("|", "library", "e.key").alias("key"), "ord", "e.emit")


def mark_stream(keyed: DataFrame, strategy: str = "strand-aware") -> DataFrame:
    """(ord, library, dup) of a stream of keyed templates. The session's state store must be RocksDB."""
    return events(keyed, strategy).groupBy("key").transformWithStateInPandas(FirstWins(), OUTPUT, "Append", "None")
