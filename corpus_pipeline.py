"""The corpus pipeline: quality rules, exact dedup, MinHash near-dedup, suffix-array dedup, best-fit packing.

Each stage takes all that its predecessor kept and returns the columns of documents; the last returns one row per packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from twinmark.llm import quality_rules
from twinmark.llm.exact_dedup import drop_exact_duplicates
from twinmark.llm.near_dedup import drop_near_duplicates
from twinmark.llm.packing import default_tokenizer, pack
from twinmark.llm.shared import materialize, table
from twinmark.llm.suffix_dedup import PASSAGE_WORDS, drop_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep."""
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules).filter("kept").select("doc.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates."""
    return drop_near_duplicates(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of over 50 words that occur elsewhere, whatever the white space; a document may be left empty."""
    return drop_repeats(docs, PASSAGE_WORDS, words=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 1024 tokens."""
    return pack(docs, default_tokenizer(), added_tokens=True)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("MinHash near-dedup", near), ("suffix-array dedup", repeats), ("best-fit packing", packed)]

#: SQL can't express learned rules, MinHash components or packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline's result over the table documents; what each stage but the last returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
