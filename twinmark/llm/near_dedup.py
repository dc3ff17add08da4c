"""Operator 6: MinHash near-duplicates with odd sketches.

Texts with the same set of shingles are one class. A class's MinHash samples make bands, whose buckets give
candidates, and are folded into an odd sketch: a bitmap of parities. The population count of two sketches' XOR
estimates their similarity; pairs far below the threshold go, the rest is confirmed on full sets. Pairs are not
made within buckets: first each class meets the leaders of its buckets (another one in each, chosen by hash), and only
where a bucket still holds several components do its classes meet, in blocks, which give no more links than it takes to join components.
There the classes of the bucket's largest component meet only those outside it, so a large group with few strangers isn't multiplied.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_dedup import without
from .graphs import components
from .shared import materialize, shards, spread_join, table
from .shingles import folded, mix, shingle_hashes

#: Shingle length, per cent of similarity, bands, samples in a band, bits of a sketch.
WORDS, PERCENT, BANDS, ROWS, BITS = 5, 75, 40, 4, 512
#: Pairs whose estimate is so far below the threshold go unconfirmed: five standard deviations.
MARGIN = 0.22
#: Rows of a block of a bucket; bytes of ids that may be broadcast.
BLOCK, MAX_BROADCAST_BYTES = 256, 8 << 20

_rng = np.random.default_rng(11)
_A = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def most_bits(percent: int = PERCENT, margin: float = MARGIN) -> int:
    """The largest XOR count of sketches that still is a candidate: expected count at similarity threshold - margin."""
    different = 2 * BANDS * ROWS * (1 - (percent / 100 - margin))
    return int(BITS / 2 * (1 - np.exp(-2 * different / BITS)))


def sketches(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """hashes of the non-empty sets, one after the other -> bands (n x BANDS, int64), odd sketches (n x BITS/64, int64)."""
    n, k = len(counts), BANDS * ROWS
    least = np.empty((n, k), np.uint64)
    ends = np.cumsum(counts)
    at = 0
    while at < n:
        start = ends[at] - counts[at]
        to = max(at + 1, int(np.searchsorted(ends, start + 32768, side="right")))
        own, offsets = hashes[start : ends[to - 1]], ends[at:to] - counts[at:to] - start
        room = np.empty_like(own)
        for i in range(k):
            np.multiply(own, _A[i], out=room)
            room += _B[i]
            least[at:to, i] = np.minimum.reduceat(room, offsets)
        at = to
    grouped = least.reshape(n, BANDS, ROWS)
    bands = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bands = np.broadcast_to(bands, (n, BANDS)).copy()
    for r in range(ROWS):
        bands = mix(bands + grouped[:, :, r])
    place = (mix(least + np.arange(k, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) % np.uint64(BITS)).astype(np.int64)
    odd = np.bincount((np.arange(n)[:, None] * BITS + place).ravel(), minlength=n * BITS).reshape(n, BITS) & 1
    return bands.view(np.int64), np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)


_SIGNED = "doc_id long, n long, h1 long, h2 long, bands array<long>, sketch array<long>"


def _sign(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            hashes, counts = shingle_hashes([folded(t) for t in part.column(1).to_pylist()], words)
            sizes, h1, h2, ends = [], [], [], np.cumsum(counts)
            for s, e in zip((ends - counts).tolist(), ends.tolist()):
                own = np.unique(hashes[s:e])
                digest = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                sizes.append(len(own))
                h1.append(int.from_bytes(digest[:8], "little", signed=True))
                h2.append(int.from_bytes(digest[8:], "little", signed=True))
            some = counts > 0
            bands, odd = np.zeros((len(counts), BANDS), np.int64), np.zeros((len(counts), BITS // 64), np.int64)
            if some.any():
                bands[some], odd[some] = sketches(hashes, counts[some])
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel())) for x in (bands, odd)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), *lists], ["doc_id", "n", "h1", "h2", "bands", "sketch"])


def _confirm(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b, text of a, text of b) -> (a, b) of those that are similar enough on their full sets."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            a, b, left, right = (part.column(i).to_pylist() for i in range(4))
            texts = {t: i for i, t in enumerate(dict.fromkeys([*left, *right]))}
            hashes, counts = shingle_hashes([folded(t) for t in texts], words)
            ends = np.cumsum(counts)
            sets = [np.unique(hashes[e - c : e]) for e, c in zip(ends.tolist(), counts.tolist())]
            similar = []
            for x, y in zip(left, right):
                x, y = sets[texts[x]], sets[texts[y]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                similar.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            pick = pa.array(similar, pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()).filter(pick), pa.array(b, pa.int64()).filter(pick)], ["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> (id, own): the sorted hashes of the shingles."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            hashes, counts = shingle_hashes([folded(t) for t in part.column(1).to_pylist()], words)
            ends = np.cumsum(counts)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([np.unique(hashes[e - c : e]).tobytes() for e, c in zip(ends.tolist(), counts.tolist())], pa.binary())], ["id", "own"])


class _Groups:
    """Union-find over a block's rows."""

    def __init__(self, labels: list[int]):
        first: dict[int, int] = {}
        self.up = [first.setdefault(c, i) for i, c in enumerate(labels)]

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i


def _links(rows: list[tuple], most: int, percent: int) -> Iterator[tuple[int, int]]:
    """Links that join different components of a block pair's rows (key, i, j, block, id, component, sketch, own): no more than rows."""
    groups, i, j = _Groups([r[5] for r in rows]), rows[0][1], rows[0][2]
    odd = np.array([r[6] for r in rows], np.int64).view(np.uint64)
    sets = [np.frombuffer(r[7], np.uint64) for r in rows]
    sizes, block = np.array([len(x) for x in sets]), np.array([r[3] for r in rows])
    other = np.flatnonzero(block == j)
    for p in np.flatnonzero(block == i).tolist():
        root = groups.find(p)
        q = other[other > p] if i == j else other
        near = np.bitwise_count(odd[p] ^ odd[q]).sum(axis=1, dtype=np.int32) <= most
        near &= 100 * np.minimum(sizes[p], sizes[q]) >= percent * np.maximum(sizes[p], sizes[q])
        q = np.array([x for x in q[near].tolist() if groups.find(x) != root], np.int64)
        if not len(q):
            continue
        flat, starts = np.concatenate([sets[x] for x in q]), np.cumsum(sizes[q]) - sizes[q]
        at = np.minimum(np.searchsorted(sets[p], flat), sizes[p] - 1)
        both = np.add.reduceat((sets[p][at] == flat).astype(np.int64), starts)
        for x in q[100 * both >= percent * (sizes[p] + sizes[q] - both)].tolist():
            a, b = groups.find(p), groups.find(x)
            if a != b:
                groups.up[a] = b
                yield rows[p][4], rows[x][4]


def _across(batches: Iterator[pa.RecordBatch], most: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, i, j, block, id, component, sketch, own) sorted by key, i, j -> links (a, b)."""

    def out(links: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    held: list[tuple] = []
    for batch in batches:
        found: list[tuple[int, int]] = []
        for row in zip(*(batch.column(i).to_pylist() for i in range(8))):
            if held and row[:3] != held[-1][:3]:
                found += _links(held, most, percent)
                held = []
            held.append(row)
        yield out(found)
    if held:
        yield out(list(_links(held, most, percent)))


def _distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda s, x: s + x)


def similar_links(classes: DataFrame, texts: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(node, component) of the classes (id, sketch, bands) that some other class is linked with; texts: (doc_id, text)."""
    most, parts = most_bits(percent), shards(classes)
    buckets = classes.select(F.col("id"), F.explode("bands").alias("key"))
    # another leader in each bucket, and the count, by partial aggregation
    leaders = buckets.groupBy("key").agg(F.count("*").alias("rows"), F.min_by("id", F.xxhash64("id", "key")).alias("leader")).filter("rows > 1")
    total = classes.count() * BANDS
    shared = materialize(spread_join(buckets, materialize(leaders, "leaders"), ["key"], total), "shared")
    star = shared.filter("id <> leader").select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()
    odd = classes.select("id", "sketch")
    near = star.join(odd.toDF("a", "sa"), "a").join(odd.toDF("b", "sb"), "b").select("a", "b", _distance(F.col("sa"), F.col("sb")).alias("z")).filter(F.col("z") <= most)
    near = materialize(near, "near")
    if not near.take(1) and not shared.take(1):
        return classes.sparkSession.createDataFrame([], "node long, component long")
    wanted = shared.select("id").distinct()
    many = wanted.count()
    wanted = F.broadcast(wanted) if many * 8 <= MAX_BROADCAST_BYTES else wanted
    own = materialize(texts.join(wanted.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi"), "texts")

    def confirmed(pairs: DataFrame) -> DataFrame:
        both = pairs.join(own.toDF("a", "ta"), "a").join(own.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")
        return both.mapInArrow(partial(_confirm, words=words, percent=percent), "a long, b long")

    def apart(pairs: DataFrame, known: DataFrame) -> DataFrame:
        """Pairs whose classes are in different components so far, with these as ca and cb."""
        of = lambda x: known.toDF(x, f"c{x}")
        out = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")})
        return out.filter("ca <> cb")

    def merged(known: DataFrame, links: DataFrame, name: str) -> DataFrame:
        """Components after more links, found on the graph of the components so far."""
        joined = materialize(apart(links, known).select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), name)
        if not joined.take(1):
            return known
        moved = components(joined)
        out = known.join(moved.toDF("component", "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        fresh = moved.join(known, "node", "left_anti")
        return materialize(out.union(fresh.select("node", "component")), f"{name}_components")

    # first the most similar leader of each class
    first = near.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("p"), "z")
    first = first.groupBy("p.x").agg(F.min(F.struct("z", "p.y")).alias("best")).select(F.least("x", "best.y").alias("a"), F.greatest("x", "best.y").alias("b")).distinct()
    first = materialize(first, "first")
    known = materialize(components(confirmed(first)), "first_components")
    rest = materialize(apart(near.join(first, ["a", "b"], "left_anti").select("a", "b"), known).select("a", "b"), "rest")
    known = merged(known, materialize(confirmed(rest), "rest_links"), "rest_joined")
    # buckets of three or more that still hold several components
    labelled = shared.filter("rows > 2").join(known.withColumnRenamed("node", "id"), "id", "left").select("key", "rows", "id", F.coalesce("component", "id").alias("component"))
    labelled = materialize(labelled, "labelled")
    parts_of = labelled.groupBy("key", "component").agg(F.count("*").alias("own"))
    mixed = parts_of.groupBy("key").agg(F.sum("own").alias("rows"), F.max("own").alias("most"), F.max(F.struct("own", "component"))["component"].alias("big"), F.count("*").alias("n")).filter("n > 1")
    rows = materialize(spread_join(labelled.drop("rows"), materialize(mixed.drop("n"), "mixed_keys"), ["key"], total), "mixed")
    left = own.join(rows.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi").mapInArrow(partial(_sets, words=words), "id long, own binary")
    # blocks 0.. are of the classes outside the largest component, those after them of the classes in it, which don't meet each other
    rows = rows.join(odd, "id").join(left, "id").withColumns({"outer": F.ceil((F.col("rows") - F.col("most")) / BLOCK).cast("int"), "inner": F.ceil(F.col("most") / BLOCK).cast("int"), "inside": F.col("component") == F.col("big")})
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    rows = rows.withColumn("block", F.when(F.col("inside"), F.col("outer") + dealt("inner")).otherwise(dealt("outer")))
    others = F.when(F.col("inside"), F.sequence(F.lit(0), F.col("outer") - 1)).otherwise(F.sequence(F.lit(0), F.col("outer") + F.col("inner") - 1))
    rows = rows.withColumn("other", F.explode(others))
    rows = rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "component", "sketch", "own")
    pairs = rows.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(partial(_across, most=most, percent=percent), "a long, b long")
    pairs = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    return merged(known, materialize(confirmed(pairs), "pair_links"), "pair_joined")


def near_dedup(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    component_id is the smallest doc_id that links reach. Texts without words (null, empty, white space) have no shingles and no links.
    Rows that repeat an id are one node of the graph, and are kept or not together. Rows with a null id are linked with nothing, have a null
    component_id and stay. Long texts are hashed in parts; their sets are whole. An empty table gives no rows. Other columns of docs are ignored, whatever their names.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    signed = materialize(texts.mapInArrow(partial(_sign, words=words), _SIGNED), "signed")
    full = signed.filter("n > 0 and doc_id is not null")
    first = F.min(F.struct(F.col("doc_id").alias("id"), "sketch", "bands")).alias("c")
    classes = materialize(full.groupBy("h1", "h2").agg(F.count("*").alias("rows"), first).select("h1", "h2", "rows", "c.*"), "classes")
    known = similar_links(classes.select("id", "sketch", "bands"), texts, words, percent)
    # a row that repeats an id may be in several classes: the classes' ids are joined through it
    rows = spread_join(full.select("doc_id", "h1", "h2"), classes.select("h1", "h2", "rows", "id"), ["h1", "h2"], full.count()).drop("rows")
    rows = rows.join(known.withColumnRenamed("node", "id"), "id", "left").select("doc_id", "h1", "h2", F.coalesce("component", "id").alias("component"))
    fate = rows.groupBy("doc_id").agg(F.min("component").alias("component_id"))
    out = signed.select("doc_id", F.col("n").alias("n_shingles")).join(fate, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that near_dedup keeps, with all their columns, whatever their names."""
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("id"))
    return without(rows, near_dedup(docs).filter("not kept").select(F.col("doc_id").alias("id")), ["id"], 8).select("doc.*")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))
