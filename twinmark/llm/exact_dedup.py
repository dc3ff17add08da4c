"""Operator 3: exact duplicates by deterministic block naming.

A text is a sequence of fixed-size blocks. Naming sorts the different blocks into whole numbers, then names
adjacent pairs of names in the same way until each text has one. Names are given by sorted content, never by a
hash, so two texts share one exactly if they are equal. First each Arrow batch names its own texts, so that equal
ones travel once; then the batches' classes meet by fingerprint and are named again. Members of a class never
meet in one task: they get the outcome by a join on their batch's class.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .shared import WHITE, WHITE_BYTES, materialize, shards, table

BLOCK = 4096
#: Texts of one fingerprint are named in bundles of so many bytes.
BUNDLE_BYTES = 16 << 20


def name_texts(texts: list[bytes], block: int = BLOCK) -> list[int]:
    """A number for each text, the same for equal texts only."""
    if not texts:
        return []
    pieces = [[t[i : i + block] for i in range(0, len(t), block)] or [b""] for t in texts]
    names = {b: i for i, b in enumerate(sorted({b for p in pieces for b in p}), 1)}
    rows = [[names[b] for b in p] for p in pieces]
    while max(map(len, rows)) > 1:
        ends = np.cumsum([(len(r) + 1) // 2 for r in rows])
        flat = np.array([x for r in rows for x in (r if len(r) % 2 == 0 else [*r, 0])], dtype=np.int64)
        _, named = np.unique(flat[0::2] << 32 | flat[1::2], return_inverse=True)
        rows = [(x + 1).tolist() for x in np.split(named, ends[:-1])]
    return [r[0] for r in rows]


# lid: the batch's class; fp: where equal texts meet; members: the class's rows; best_*: the one that would stay
_LOCAL = "lid long, fp long, text binary, sha string, n long, best_chars long, best_id long, members array<long>"


def _local_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lid = TaskContext.get().partitionId() << 40
    for batch in batches:
        ids, given = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
        texts = [t.encode("utf-8", "surrogatepass").translate(None, WHITE_BYTES) for t in given]
        classes: dict[int, list[int]] = {}
        for i, name in enumerate(name_texts(texts)):
            classes.setdefault(name, []).append(i)
        out: list[list] = [[] for _ in range(8)]
        for members in classes.values():
            text = texts[members[0]]
            digest = hashlib.sha256(text)
            best = min(members, key=lambda i: (-len(given[i]), ids[i] is None, ids[i] or 0))
            row = (lid, int.from_bytes(digest.digest()[:8], "little", signed=True), text, digest.hexdigest(), len(members), len(given[best]), ids[best], [ids[i] for i in members])
            for column, value in zip(out, row):
                column.append(value)
            lid += 1
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["lid", "fp", "text", "sha", "n", "best_chars", "best_id", "members"])


def _global_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lid, fp, text) sorted by fp -> (lid, name). Holds one bundle, and one text of each class of the open fingerprint."""
    number = TaskContext.get().partitionId() << 40
    held: list[tuple[int | None, bytes, int | None]] = []  # lid (None: already out), text, name
    size, last = 0, None

    def flush(open_fp: bool) -> tuple[list[int], list[int], list]:
        nonlocal number
        local = name_texts([t for _, t, _ in held])
        given: dict[int, int] = {k: g for k, (_, _, g) in zip(local, held) if g is not None}
        lids, names, first = [], [], {}
        for k, (lid, text, _) in zip(local, held):
            if k not in given:
                given[k] = number = number + 1
            first.setdefault(k, (None, text, given[k]))
            if lid is not None:
                lids.append(lid)
                names.append(given[k])
        return lids, names, list(first.values()) if open_fp else []

    def out(lids: list[int], names: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(lids, pa.int64()), pa.array(names, pa.int64())], ["lid", "name"])

    for batch in batches:
        for lid, fp, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if size > BUNDLE_BYTES:
                lids, names, held = flush(fp == last)
                size = sum(len(t) for _, t, _ in held) if fp == last else 0
                size = min(size, BUNDLE_BYTES // 2)
                yield out(lids, names)
            held.append((lid, text, None))
            size, last = size + len(text) + 64, fp
    lids, names, held = flush(False)
    yield out(lids, names)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without the characters [\\x20\\x09-\\x0D]; null counts as empty, and empty texts equal each
    other. Of equal texts that with the most code points stays, then the smallest doc_id; null ids come last, and keep_id is null
    if only such are there. Rows that repeat an id share its fate and each count in group_size. An empty table gives no rows.
    Other columns of docs are ignored, whatever their names.
    """
    classes = materialize(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_local_classes, _LOCAL), "classes")
    meet = classes.select("lid", "fp", "text").repartition(shards(docs), "fp").sortWithinPartitions("fp")
    named = materialize(meet.mapInArrow(_global_names, "lid long, name long"), "named")
    small = classes.select("lid", "n", "best_chars", "best_id").join(named, "lid")
    best = F.min(F.struct((-F.col("best_chars")).alias("c"), F.col("best_id").isNull().alias("none"), F.col("best_id").alias("id")))
    groups = small.groupBy("name").agg(best.alias("best"), F.sum("n").alias("group_size"))
    fate = named.join(groups, "name").select("lid", F.col("best.id").alias("keep_id"), "group_size")
    rows = classes.select("lid", "sha", F.explode("members").alias("doc_id")).join(fate, "lid")
    return rows.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


#: Bytes of dropped rows' names that may be broadcast; more are joined by shuffle.
MAX_BROADCAST_BYTES = 8 << 20


def without(docs: DataFrame, dropped: DataFrame, on: list[str], row_bytes: int) -> DataFrame:
    """docs without the rows that dropped names by the columns of on, nulls included; dropped takes row_bytes a row."""
    dropped = materialize(dropped.select(*(F.col(c).alias(f"_dropped_{c}") for c in on)), "dropped")
    small = dropped.count() * row_bytes <= MAX_BROADCAST_BYTES
    same = [F.col(c).eqNullSafe(F.col(f"_dropped_{c}")) for c in on]
    return docs.join(F.broadcast(dropped) if small else dropped, same, "left_anti")


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns, whatever their names."""
    digest = F.sha2(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), WHITE, "").cast("binary"), 256)
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("id"), digest.alias("sha"))
    dropped = exact_dedup(docs).filter("not kept").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"))
    return without(rows, dropped, ["id", "sha"], 80).select("doc.*")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars, sha256(translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS text_sha256
  FROM documents)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM (
  SELECT doc_id, text_sha256, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
"""
