"""Operator 8: language-model scores from a weighted backoff automaton.

The model has n-grams of up to three words, each order smoothed by the one below. As an automaton, each sequence of one or two words that was
seen before another word is a state: it has an arc for each word that was seen after it, weighted by the smoothed probability, and
a failure arc to the state without its first word, weighted by what it leaves to unseen words; the root has an arc for each
word and one for unknown words. A text is one traversal from left to right that carries the state: while a state has no arc for the word it
fails to the next shorter one, and the weights of the arcs taken add up. Many texts are traversed side by side.

Counts cover all training texts. Texts form blocks of bounded size, which are written with their numbers, one row a block; a block counts its n-grams,
sorts their hashes and sends them, cut by hash range, to the ranges' tasks. These add up all blocks' counts and return, to each block, the
totals in the order in which it sent the hashes. So a block gets the part of the automaton that its texts can reach, and no task holds more than a
block's or a range's share; the number of ranges follows from the size of the texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .shared import materialize, shards, table
from .shingles import folded, mix, word_hashes

#: Bytes of text in a block; bytes of text whose n-grams make one range; weights, in counts, of the next shorter context's model.
BLOCK_BYTES, RANGE_BYTES, WEIGHTS = 3 << 20, 4 << 20, (16.0, 4.0)
#: Tokens of a lane: longer texts are traversed in several, each of which finds its state from the two words before.
LANE = 256

_END = np.uint64(0x5851F42D4C957F2D)
#: Keys of n-grams have 56 bits: a hash, and the order in the last two.
_KEY_BYTES = 7


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2


def _tokens(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Word hashes with the end token after each text."""
    out = np.full(len(hashes) + len(counts), _END, np.uint64)
    out[np.arange(len(hashes)) + np.repeat(np.arange(len(counts)), counts)] = hashes
    return out


def _key(h: np.ndarray, order: int) -> np.ndarray:
    return (mix(h) >> np.uint64(64 - 8 * _KEY_BYTES)) & ~np.uint64(3) | np.uint64(order)


def ngram_keys(tokens: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the n-grams of one, two and three tokens that end at each token; an end token is also what stands before a text.
    firsts: places of texts' first tokens, at which there are none of three (their places are left out)."""
    before = np.empty_like(tokens)
    before[1:], before[:1] = tokens[:-1], _END
    two = before * np.uint64(0xC2B2AE3D27D4EB4F) + tokens * np.uint64(0x165667B19E3779F9)
    inner = np.ones(len(tokens), bool)
    inner[firsts] = False
    at = np.flatnonzero(inner)
    three = mix(two[at - 1]) * np.uint64(0x9E3779B97F4A7C15) + tokens[at] * np.uint64(0x165667B19E3779F9)
    return _key(tokens * np.uint64(0x9E3779B97F4A7C15), 1), _key(two, 2), _key(three, 3)


def _planes(x: np.ndarray, width: int) -> bytes:
    """The lower bytes in order of significance, which compress well for sorted or small numbers."""
    return x.view(np.uint8).reshape(len(x), x.dtype.itemsize)[:, :width].T.tobytes()


def _from_planes(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return out.view(np.uint64).ravel()


def _bounds(ranges: int) -> np.ndarray:
    return np.array([(i << 8 * _KEY_BYTES) // ranges for i in range(1, ranges)], np.uint64)


_BLOCK = "block long, doc_ids array<long>, texts array<string>, held array<boolean>"


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, held) -> rows of _BLOCK."""
    number, rows, size = TaskContext.get().partitionId() << 24, [], 0

    def out() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.string(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([list(c)], pa.list_(k)) for c, k in zip(zip(*rows), kinds))], ["block", "doc_ids", "texts", "held"])

    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(3))):
            rows.append(row)
            size += 4 + len(row[1] or "")
            if size > block_bytes:
                yield out()
                number, rows, size = number + 1, [], 0
    if rows:
        yield out()


def _block_tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of a block's texts, and how many each has."""
    parts, sizes, held, size = [], [], [], 0
    for i, t in enumerate(texts):
        held.append(folded(t))
        size += len(held[-1])
        if size > 1 << 20 or i + 1 == len(texts):
            hashes, counts = word_hashes(held)
            parts.append(_tokens(hashes, counts))
            sizes.append(counts + 1)
            held, size = [], 0
    return np.concatenate(parts), np.concatenate(sizes)


def _count(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    """(block, texts, held) -> (block, part, keys, counts)."""
    bounds = _bounds(ranges)
    for batch in batches:
        for i in range(batch.num_rows):
            tokens, sizes = _block_tokens(batch.column(1)[i].as_py())
            train = np.repeat(~np.array(batch.column(2)[i].as_py(), bool), sizes)
            firsts = np.cumsum(sizes) - sizes
            one, two, three = ngram_keys(tokens, firsts)
            inner = np.ones(len(tokens), bool)
            inner[firsts] = False
            keys, at = np.unique(np.concatenate([one, two, three]), return_inverse=True)
            counts = np.bincount(at, weights=np.concatenate([train, train, train[inner]]), minlength=len(keys)).astype(np.uint32)
            cuts = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
            parts = [p for p in range(ranges) if cuts[p] < cuts[p + 1]]
            yield pa.RecordBatch.from_arrays([
                pa.array([batch.column(0)[i].as_py()] * len(parts), pa.int64()), pa.array(parts, pa.int32()),
                pa.array([_planes(keys[cuts[p] : cuts[p + 1]], _KEY_BYTES) for p in parts], pa.binary()), pa.array([zlib.compress(_planes(counts[cuts[p] : cuts[p + 1]], 4), 1) for p in parts], pa.binary()),
            ], ["block", "part", "keys", "counts"])


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, part, keys, counts) sorted by part -> (block, part, totals, tokens, types); the range's own sums are in a row of block -1."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        keys = [_from_planes(r[2], _KEY_BYTES) for r in rows]
        ends = np.cumsum([len(k) for k in keys])
        unique, at = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.concatenate([_from_planes(zlib.decompress(r[3]), 4) for r in rows])
        sums = np.bincount(at, weights=counts, minlength=len(unique)).astype(np.int64)
        words = sums[(unique & np.uint64(3)) == 1]
        totals = [zlib.compress(_planes(x, 8), 1) for x in np.split(sums[at], ends[:-1])]
        own = [r[0] for r in rows]
        return pa.RecordBatch.from_arrays([
            pa.array([*own, -1], pa.int64()), pa.array([rows[0][1]] * (len(rows) + 1), pa.int32()), pa.array([*totals, None], pa.binary()),
            pa.array([0] * len(rows) + [int(words.sum())], pa.int64()), pa.array([0] * len(rows) + [int((words > 0).sum())], pa.int64()),
        ], ["block", "part", "totals", "tokens", "types"])

    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if held and row[1] != held[-1][1]:
                yield flush(held)
                held = []
            held.append(row)
    if held:
        yield flush(held)


class Automaton:
    """The part of the automaton that some texts can reach.

    States: 0 is the root, 1 + w the context of the word w, 1 + words + p that of the pair p. words: training counts by word; pairs and
    triples: (context, word, count) of n-grams, the context a word or a pair; end: the end token, after which no text goes on; size: training tokens and types.
    """

    def __init__(self, words: np.ndarray, pairs: tuple, triples: tuple, end: int, size: tuple[int, int], weights: tuple[float, float] = WEIGHTS):
        n, (tokens, types) = len(words), size
        one = (words + 1) / (tokens + types + 1)
        of, word, count = pairs
        two = (count + weights[0] * one[word]) / (words[of] + weights[0])
        pair_of = {"order": np.lexsort((word, of))}  # pairs by context and word, to find a triple's shorter form
        sorted_pairs = (of[pair_of["order"]].astype(np.int64) << 32) | word[pair_of["order"]]
        ctx, last, times = (x[triples[2] > 0] for x in triples)
        shorter = pair_of["order"][np.searchsorted(sorted_pairs, (word[ctx].astype(np.int64) << 32) | last)]
        three = (times + weights[1] * two[shorter]) / (count[ctx] + weights[1])
        seen = np.flatnonzero(count > 0)
        state = lambda p: np.where(word[p] == end, 0, 1 + n + p)
        arcs = np.concatenate([((1 + of[seen]).astype(np.int64) << 32) | word[seen], ((1 + n + ctx).astype(np.int64) << 32) | last])
        order = np.argsort(arcs)
        #: arcs by state and word, with their weights and targets; the root's are by word
        self.arcs = arcs[order]
        self.weight = np.concatenate([np.log10(two[seen]), np.log10(three)])[order]
        self.target = np.concatenate([state(seen), state(shorter)])[order]
        self.root_weight = np.log10(one)
        self.root_target = np.where(words > 0, 1 + np.arange(n), 0)
        #: failure arcs
        with np.errstate(divide="ignore"):
            self.fail_weight = np.log10(np.concatenate([[1.0], weights[0] / (words + weights[0]), weights[1] / (count + weights[1])]))
        self.fail_target = np.concatenate([np.zeros(1 + n, np.int64), self.root_target[word]])
        self.start = int(self.root_target[end])

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state, weight) after each state has read its word."""
        state, weight, due = state.copy(), np.zeros(len(state)), np.arange(len(state))
        while len(due):
            at_root = state[due] == 0
            some = due[at_root]
            weight[some] += self.root_weight[word[some]]
            state[some] = self.root_target[word[some]]
            due = due[~at_root]
            asked = (state[due] << 32) | word[due]
            found = np.minimum(np.searchsorted(self.arcs, asked), len(self.arcs) - 1)
            hit = self.arcs[found] == asked if len(self.arcs) else np.zeros(len(due), bool)
            some, found = due[hit], found[hit]
            weight[some] += self.weight[found]
            state[some] = self.target[found]
            due = due[~hit]
            weight[due] += self.fail_weight[state[due]]
            state[due] = self.fail_target[state[due]]
        return state, weight

    def traverse(self, words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The weight of each text; words: the texts' words, end tokens included, one text after the other."""
        starts = np.cumsum(sizes) - sizes
        lanes = -(-sizes // LANE)
        text = np.repeat(np.arange(len(sizes)), lanes)
        own = (np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE  # where in its text a lane begins
        first, stop = starts[text] + own, starts[text] + np.minimum(own + LANE, sizes[text])
        state = np.full(len(text), self.start, np.int64)
        inner = np.flatnonzero(own)
        state[inner] = 0
        for back in (2, 1):  # a state is at most two words
            state[inner], _ = self.step(state[inner], words[first[inner] - back])
        order = np.argsort(first - stop, kind="stable")  # longest first, so that the lanes that go on come first
        first, left, state, total = first[order], (stop - first)[order], state[order], np.zeros(len(order))
        for i in range(int(left[0]) if len(left) else 0):
            on = int(np.searchsorted(-left, -i))  # lanes with more than i tokens
            state[:on], weight = self.step(state[:on], words[first[:on] + i])
            total[:on] += weight
        return np.bincount(text[order], weights=total, minlength=len(sizes))


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_block(texts: list[str | None], totals: np.ndarray, size: tuple[int, int], weights: tuple[float, float]) -> tuple[np.ndarray, ...]:
    """(tokens, known tokens, base score, score) of a block's texts; totals: training counts by the block's keys in order."""
    tokens, sizes = _block_tokens(texts)
    firsts = np.cumsum(sizes) - sizes
    keys_one, keys_two, keys_three = ngram_keys(tokens, firsts)
    one, word = np.unique(keys_one, return_inverse=True)
    two, pair = np.unique(keys_two, return_inverse=True)
    three, triple = np.unique(keys_three, return_inverse=True)
    del keys_one, keys_two, keys_three
    order = np.sort(np.concatenate([one, two, three])) & np.uint64(3)
    if len(order) != len(totals):
        raise RuntimeError("a block's totals are not of its n-grams")
    words, pairs, triples = (totals[order == k] for k in (1, 2, 3))
    del order, totals
    end = int(np.searchsorted(one, ngram_keys(np.array([_END]), np.array([0]))[0][0]))
    before = np.empty_like(word)
    before[1:], before[:1] = word[:-1], end
    inner = np.ones(len(tokens), bool)
    inner[firsts] = False
    at_two, at_three = np.empty(len(two), np.int64), np.empty(len(three), np.int64)  # a place of each
    at_two[pair], at_three[triple] = np.arange(len(tokens)), np.flatnonzero(inner)
    automaton = Automaton(words, (before[at_two], word[at_two], pairs), (pair[at_three - 1], word[at_three], triples), end, size, weights)
    del pair, triple, before, at_two, at_three, pairs, triples
    known = np.add.reduceat((words[word] > 0).astype(np.int64), firsts)
    return sizes, known, np.add.reduceat(automaton.root_weight[word], firsts), automaton.traverse(word, sizes)


def _score(batches: Iterator[pa.RecordBatch], tokens: int, types: int, weights: tuple[float, float]) -> Iterator[pa.RecordBatch]:
    """(block, part, totals, doc_ids, texts, held), sorted by block and part: first a block's texts, then its totals."""
    own: tuple | None = None
    totals: list[bytes] = []

    def flush() -> pa.RecordBatch:
        ids, texts, held = own
        known = np.concatenate([_from_planes(zlib.decompress(t), 8) for t in totals]).view(np.int64)
        totals.clear()
        sizes, known, base, score = score_block(texts, known, (tokens, types), weights)
        out = [pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(sizes), pa.array(known), pa.array(np.full(len(sizes), tokens, np.int64)), pa.array(base), pa.array(score)]
        return pa.RecordBatch.from_arrays(out, [x.split()[0] for x in _SCORED.split(", ")])

    for batch in batches:
        part = batch.column(1).to_pylist()
        for i in range(batch.num_rows):
            if part[i] < 0:
                if own is not None:
                    yield flush()
                own, totals = tuple(batch.column(k)[i].as_py() for k in (3, 4, 5)), []
            else:
                totals.append(batch.column(2)[i].as_py())
    if own is not None:
        yield flush()


def lm_scores(docs: DataFrame, held: Column, weights: tuple[float, float] = WEIGHTS, block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    held: the condition of rows that the model doesn't learn from; docs are read once, in any order. Null and empty texts have the end token alone.
    Repeated rows and null ids are texts of their own, and repeats are learned repeatedly. An empty table gives no rows; if no row is learned
    from, every word is unknown. A long text is a block of its own, which a task holds. Other columns are ignored, whatever their names.
    """
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(held, F.lit(False)).alias("held"))
    blocks = materialize(own.mapInArrow(partial(_blocks, block_bytes=block_bytes), _BLOCK), "blocks", level=9)
    size = blocks.agg(F.sum(F.aggregate("texts", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(F.length(x), F.lit(0)) + 4))).first()[0] or 0
    parts, ranges = shards(docs), max(1, -(-size // range_bytes))
    sent = blocks.select("block", "texts", "held").mapInArrow(partial(_count, ranges=ranges), "block long, part int, keys binary, counts binary")
    added = sent.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_add_up, "block long, part int, totals binary, tokens long, types long")
    added = materialize(added, "totals")
    sums = added.filter("block = -1").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("types"), F.lit(0)).alias("types")).first()
    none = lambda kind: F.lit(None).cast(kind)
    rows = blocks.select("block", F.lit(-1).alias("part"), none("binary").alias("totals"), "doc_ids", "texts", "held")
    back = added.filter("block >= 0").select("block", "part", "totals", none("array<long>").alias("doc_ids"), none("array<string>").alias("texts"), none("array<boolean>").alias("held"))
    both = rows.union(back).repartition(parts, "block").sortWithinPartitions("block", "part")
    return both.mapInArrow(partial(_score, tokens=sums.tokens, types=sums.types, weights=weights), _SCORED)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"), held_out(F.col("doc_id")))
