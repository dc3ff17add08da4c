"""Operator 1: repeated strings by merging shard Burrows-Wheeler transforms.

A text is a sequence of symbols: its bytes, or its words. A string of `length` symbols has one anchor: the place, within it,
of its smallest half-length substring (the core) by hash. Equal strings have equal anchors, so consecutive strings of a text that
share an anchor form a window, and only windows whose core occurs elsewhere go on. Identical windows are one class with a weight.

Windows of equal cores meet in one task. They are aligned at the core, which is one symbol, so their suffixes fall into columns by the
distance from the right end, and a suffix can only equal one of its own column. Each shard of windows sorts its own suffixes
and keeps the symbols before them: its transform. Transforms are merged by the interleave, which says from which shard each suffix of the merged
order comes: one round reads the symbols before the suffixes along the interleave and deals the interleave out by them (the LF
step), which refines it from one column to the next. No suffixes of different shards are ever compared or sorted. Common prefixes follow from those of the
round before as least values of ranges; neighbours that agree in `length` symbols, and classes of weight two or more, are the repeated intervals.

Cores with very many different windows are split by the symbols next to them: a string that starts far left of its core also holds
the symbols before it, one that starts close to it those after it, so such windows are cut in several with longer cores, and merged in the same way.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import forget, materialize, shards, spread_join, table
from .shingles import word_places

#: Symbols of a string: bytes, and words of the pipeline's passages ("over 50 words").
LENGTH, PASSAGE_WORDS = 400, 51
#: Bytes hashed at once, windows merged at once, windows in a shard, different windows of one core that may meet in one task.
CHUNK, BUNDLE, SHARD, HOT = 1 << 20, 8192, 1024, 1024
#: Into how many windows one of a very common core is cut; bytes of such cores' keys that may be broadcast.
SPLIT = 8
MAX_BROADCAST_BYTES = 8 << 20

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1


@cache
def _values() -> np.ndarray:
    return np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64."""
    up, down = np.ones(n, np.uint64), np.ones(n, np.uint64)
    up[1:], down[1:] = np.uint64(_MULTIPLIER), np.uint64(pow(_MULTIPLIER, -1, 1 << 64))
    return np.cumprod(up), np.cumprod(down)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA0761D6478BD642F)
    h ^= h >> np.uint64(32)
    return h


class _Sums:
    """Hashes of ranges of a sequence of 64-bit values, which don't depend on the range's place."""

    def __init__(self, values: np.ndarray):
        size = 1 << max(21, len(values).bit_length())
        up, self.down = _powers(size)
        self.total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.total[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.total[stop] - self.total[start]) * self.down[start]

    def of_all(self, width: int) -> np.ndarray:
        n = len(self.total) - width
        return (self.total[width:] - self.total[:n]) * self.down[:n]


def window_rows(data: bytes, ends: np.ndarray, length: int, words: bool = False) -> tuple[np.ndarray, ...]:
    """data: segments that end (in bytes) at ends. (segment, b0, size, n, off, key, class hash) of each window: the strings that start
    at the symbols 0..n-1 of the window share the core at its symbol off; the window is size bytes from the segment's byte b0."""
    core, none = length // 2, tuple(np.zeros(0, np.int64) for _ in range(7))
    b = np.frombuffer(data, np.uint8)
    bytes_ = _Sums(_values()[b])
    if words:
        sb, se = word_places(b)
        symbols = _Sums(_mix(bytes_.of(sb, se) + (se - sb).astype(np.uint64)))
        last_symbol = np.searchsorted(sb, ends)  # of each segment: where its symbols end
    else:
        sb, se, symbols, last_symbol = np.arange(len(b)), np.arange(1, len(b) + 1), bytes_, ends
    if len(sb) < length:
        return none
    width, m = length - core + 1, len(sb) - core + 1
    rolled = symbols.of_all(core)
    # the place in the low bits makes the leftmost of equal hashes the smallest
    bits = np.uint64((1 << 32) - 1)
    full = np.full(-(-m // width) * width, ~np.uint64(0))
    full[:m] = (_mix(rolled) & ~bits) | np.arange(m, dtype=np.uint64)
    full = full.reshape(-1, width)
    head = np.minimum.accumulate(full, axis=1).ravel()
    tail = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    n_strings = len(sb) - length + 1
    anchor = (np.minimum(tail[:n_strings], head[width - 1 : width - 1 + n_strings]) & bits).astype(np.int64)
    starts = np.concatenate([[0], last_symbol[:-1]])
    last = np.maximum(last_symbol - length + 1, starts)  # strings of a segment start before
    marks = np.zeros(n_strings + 1, np.int32)
    np.add.at(marks, np.minimum(starts, n_strings), 1)
    np.add.at(marks, np.minimum(last, n_strings), -1)
    valid = np.cumsum(marks[:-1]) > 0
    new = np.ones(n_strings, bool)
    new[1:] = anchor[1:] != anchor[:-1]
    new[starts[starts < n_strings]] = True
    new[1:] |= ~valid[:-1]
    p0 = np.flatnonzero(new & valid)
    if not len(p0):
        return none
    stop = np.flatnonzero(np.append((new | ~valid)[1:], True)) + 1
    n = stop[np.searchsorted(stop, p0, side="right")] - p0
    at, b0, b1 = anchor[p0], sb[p0], se[p0 + n + (length - 2)]
    whole = _mix(bytes_.of(b0, b1) + (b1 - b0).astype(np.uint64))
    segment = np.searchsorted(ends, b0, side="right")
    key = _mix(rolled[at] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1))
    return segment, b0 - np.concatenate([[0], ends[:-1]])[segment], b1 - b0, n, at - p0, key.view(np.int64), whole.view(np.int64)


def _segments(text: bytes, length: int, words: bool) -> Iterator[tuple[int, bytes]]:
    """(place, part) of parts of about CHUNK bytes that share length - 1 symbols, so that each string is in one of them."""
    if not words or len(text) <= CHUNK:
        step = CHUNK if not words else len(text)
        for start in range(0, max(1, len(text) - length + 1), step):
            yield start, text[start : start + step + length - 1]
        return
    sb, se = word_places(np.frombuffer(text, np.uint8))
    at = 0
    while at + length <= len(sb):
        to = max(at + 1, int(np.searchsorted(sb, sb[at] + CHUNK)))  # strings that start at the words at..to-1
        yield int(sb[at]), text[sb[at] : se[min(to + length - 2, len(se) - 1)]]
        at = to


_ANCHORS = "key long, wh long, doc_id long, crc int, b0 int, size int, n int, off int"


def _anchors(batches: Iterator[pa.RecordBatch], length: int, words: bool) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _ANCHORS.split(", ")]
    gap = b" " if words else b""

    def out(parts: list, data: list) -> pa.RecordBatch:
        segment, b0, size, n, off, key, whole = window_rows(gap.join(data) + gap, np.cumsum([len(x) + len(gap) for x in data]), length, words)
        place = np.array([x[2] for x in parts], np.int64)
        pick = lambda i, kind: pa.array([parts[s][i] for s in segment.tolist()], kind)
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(whole, pa.int64()), pick(0, pa.int64()), pick(1, pa.int32()), *(pa.array(x.astype(np.int32)) for x in (b0 + place[segment], size, n, off))], names)

    parts, data, held = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not text or len(text) < (2 * length - 1 if words else length):
                continue
            crc = zlib.crc32(text) - (1 << 31)
            for start, own in _segments(text, length, words):
                if data and held + len(own) > CHUNK:
                    yield out(parts, data)
                    parts, data, held = [], [], 0
                parts.append((doc_id, crc, start))
                data.append(own)
                held += len(own)
    if data:
        yield out(parts, data)


class Shard:
    """A shard's transform. symbols: columns x rows, from the windows' right ends to the left, 0 where a window has none."""

    def __init__(self, symbols: np.ndarray):
        columns, rows = symbols.shape
        #: for each column, the rows in the order of the suffixes right of it, and the symbols before these: the transform
        self.rows, self.before = np.empty((columns + 1, rows), np.int32), np.empty_like(symbols)
        order = np.arange(rows, dtype=np.int32)
        for j in range(columns):
            self.rows[j], self.before[j] = order, symbols[j][order]
            order = order[np.argsort(self.before[j], kind="stable")]
        self.rows[columns] = order


def _least(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Least of values[start:stop] for each pair; all ranges hold something."""
    if not len(start):
        return np.zeros(0, values.dtype)
    level = np.frexp((stop - start).astype(np.float64))[1] - 1
    out, now = np.empty(len(start), values.dtype), values  # now: the least of 2**k values from each place
    for k in range(int(level.max()) + 1):
        if k:
            now = np.minimum(now[: -(1 << (k - 1))], now[1 << (k - 1) :])
        own = np.flatnonzero(level == k)
        if len(own):
            out[own] = np.minimum(now[start[own]], now[stop[own] - (1 << k)])
    return out


class Merge:
    """Merges shards' transforms. sides: of each row, the symbols that a string has beside its core; right: columns right of the core."""

    def __init__(self, shards_: list[Shard], sides: np.ndarray, right: int):
        self.sides, self.right, self.columns = sides, right, len(shards_[0].before)
        base = np.cumsum([0, *(x.rows.shape[1] for x in shards_)])
        self.of = np.repeat(np.arange(len(shards_)), np.diff(base)).astype(np.uint16)
        self.rows = np.concatenate([x.rows + b for x, b in zip(shards_, base[:-1])], axis=1)  # shard after shard
        self.before = np.concatenate([x.before for x in shards_], axis=1)

    def repeated(self) -> np.ndarray:
        """(left + 1) x rows: whether the string that starts d symbols before the row's core occurs in another row."""
        found = np.zeros((self.columns - self.right, len(self.of)), bool)
        alive = None  # all rows
        interleave = self.of  # every suffix is empty: one shard after the other
        places = np.arange(len(interleave))  # of the shards' suffixes, shard after shard, in the merged order
        common = np.zeros(len(interleave), np.int32)  # symbols that a suffix shares with the one before it
        for j in range(self.columns):
            before = self.before[j] if alive is None else self.before[j][alive[self.rows[j]]]
            along = np.empty_like(before)
            along[places] = before
            step = np.argsort(along, kind="stable")
            interleave, along = interleave[step], along[step]
            same = np.flatnonzero((along[1:] == along[:-1]) & (along[1:] != 0)) + 1
            made = np.zeros(len(step), np.int32)
            made[same] = 1 + _least(common, step[same - 1] + 1, step[same] + 1)
            common, places = made, np.argsort(interleave, kind="stable")
            d = j - self.right
            if d < 0:
                continue
            own = np.empty(len(step), np.int64)  # the row of each place
            own[places] = self.rows[j + 1] if alive is None else self.rows[j + 1][alive[self.rows[j + 1]]]
            hit = np.flatnonzero(common > self.sides[own])
            found[d, own[hit]] = True
            found[d, own[hit - 1]] = True
            if d % 8 == 0:  # a row that shares not even core and left part with a neighbour has no partner from here on
                alone = np.maximum(common, np.append(common[1:], 0)) <= d
                if alone.any():
                    keep = np.flatnonzero(~alone)
                    if not len(keep):
                        break
                    alive = np.ones(len(self.of), bool) if alive is None else alive
                    alive[own[alone]] = False
                    common = np.minimum.reduceat(common[: keep[-1] + 1], np.concatenate([[0], keep[:-1] + 1]))
                    common[0], interleave = 0, interleave[keep]
                    places = np.argsort(interleave, kind="stable")
        return found


def repeated_starts(windows: list[tuple], length: int, words: bool) -> Iterator[tuple[int, np.ndarray]]:
    """windows: (key, weight, core, off, n, text). (number of the window, sorted starts of its strings that occur twice or more)."""
    cores: dict[tuple, int] = {}
    numbers: dict[bytes, int] = {}
    texts, groups = [], np.empty(len(windows), np.int64)
    for i, (key, _, core, off, _, text) in enumerate(windows):
        if words:  # bytes.split() knows the same white space
            texts.append(np.array([numbers.setdefault(x, len(numbers) + 1) for x in text.split()], np.int64))
        else:
            texts.append(np.frombuffer(text, np.uint8).astype(np.int64) + 1)
        groups[i] = cores.setdefault((key, texts[-1][off : off + core].tobytes()), len(cores) + 1)
    core, off, n = (np.array([w[k] for w in windows], np.int64) for k in (2, 3, 4))
    sides, weight = length - core, np.array([w[1] for w in windows], np.int64)
    side = int(sides.max())
    most = max(len(numbers) if words else 256, len(cores))
    matrix = np.zeros((2 * side + 1, len(windows)), np.uint16 if most < 1 << 16 else np.int32)
    for i, t in enumerate(texts):
        after = t[off[i] + core[i] :][:side]
        matrix[side - len(after) : side, i] = after[::-1]
        matrix[side + 1 : side + 1 + off[i], i] = t[: off[i]][::-1]
    matrix[side] = groups
    made = [Shard(np.ascontiguousarray(matrix[:, s : s + SHARD])) for s in range(0, len(windows), SHARD)]
    found = Merge(made, sides, side).repeated()
    at = np.arange(side + 1)[:, None]
    found |= (weight > 1) & (at >= off - n + 1) & (at <= off)
    for i in np.flatnonzero(found.any(axis=0)).tolist():
        yield i, (off[i] - np.flatnonzero(found[:, i]))[::-1]


def _runs(starts: np.ndarray, length: int, text: bytes, words: bool) -> list[int]:
    """Starts and stops, in turn, of the bytes that the strings at starts cover."""
    cut = np.flatnonzero(np.diff(starts) > length)  # strings that only touch are one run
    first, last = starts[np.concatenate([[0], cut + 1])], starts[np.append(cut, len(starts) - 1)]
    if words:
        sb, se = word_places(np.frombuffer(text, np.uint8))
        return np.stack([sb[first], se[last + length - 1]], axis=1).ravel().tolist()
    return np.stack([first, last + length], axis=1).ravel().tolist()


#: A class of windows: weight is the number of its windows, rows that of the rows that get its outcome.
_CLASS = "key long, wh long, weight long, rows long, core int, off int, n int, text binary"
_PART = _CLASS.replace("rows long, ", "") + ", at int, of_key long, of_wh long, of_rows long"
_FOUND = "key long, wh long, rows long, spans array<int>"
_PA = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _PA[k]) for i, k in enumerate(kinds)], list(names))


def _merged(batches: Iterator[pa.RecordBatch], length: int, words: bool) -> Iterator[pa.RecordBatch]:
    """Rows of _CLASS, sorted by key -> rows of _FOUND; spans: starts and stops of the window's bytes, in turn."""
    held: list[tuple] = []

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        found = repeated_starts([(r[0], r[2], *r[4:8]) for r in rows], length, words)
        return _batch([(*rows[i][:2], rows[i][3], _runs(starts, length, rows[i][7], words)) for i, starts in found], _FOUND)

    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(8))):
            if len(held) >= BUNDLE and row[0] != held[-1][0]:
                yield flush(held)
                held = []
            held.append(row)
    if held:
        yield flush(held)


def split_window(core: int, off: int, n: int, text: bytes, length: int, words: bool) -> Iterator[tuple[int, int, int, int, bytes, bytes]]:
    """(byte place, core, off, n, text, core's bytes) of the windows into which a window is cut. Strings that start lo to hi symbols before the core
    all hold the lo symbols before it and side - hi after it, which make the longer core of their window."""
    side = length - core
    sb, se = word_places(np.frombuffer(text, np.uint8)) if words else (range(len(text)), range(1, len(text) + 1))
    width = -(-(side + 1) // SPLIT)
    for lo in range(0, side + 1, width):
        hi = min(lo + width - 1, side)
        first, last = max(0, off - hi), min(n - 1, off - lo)
        if first <= last:
            at, longer = off - lo, core + lo + side - hi
            own = text[sb[at] : se[at + longer - 1]]
            yield int(sb[first]), longer, at - first, last - first + 1, text[sb[first] : se[last + length - 1]], b" ".join(own.split()) if words else own


def _split(batches: Iterator[pa.RecordBatch], length: int, words: bool) -> Iterator[pa.RecordBatch]:
    """Rows of _CLASS -> their parts (_PART), with keys of their longer cores; at: the part's first byte in the window."""
    hashed = lambda *x: int.from_bytes(hashlib.blake2b(b"\0".join(x), digest_size=8).digest(), "little", signed=True)
    for batch in batches:
        rows = []
        for key, wh, weight, of_rows, *window in zip(*(batch.column(i).to_pylist() for i in range(8))):
            for at, core, off, n, text, own in split_window(*window, length, words):
                rows.append((hashed(str((key, core)).encode(), own), hashed(str(off).encode(), text), weight, core, off, n, text, at, key, wh, of_rows))
        yield _batch(rows, _PART)


def _joined(spans: list) -> list[list[int]]:
    """Spans that overlap or touch as one, in order."""
    runs: list[list[int]] = []
    for s, e in sorted(spans):
        if runs and s <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e])
    return runs


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text, spans, passages) -> doc, sizes, digest, what is left of the text, and the passages' bytes."""
    names, kinds = zip(*((n, {"long": pa.int64(), "string": pa.string()}[k]) for n, k in _CUT))
    for batch in batches:
        out: list[list] = [[] for _ in _CUT]
        for text, spans, passages in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
            text, runs, kept, at = text or b"", _joined(spans or []), [], 0
            for s, e in runs:
                kept.append(text[at:s])
                at = e
            kept = b"".join([*kept, text[at:]])
            for column, x in zip(out, (len(text), sum(e - s for s, e in runs), len(runs), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore"), sum(e - s for s, e in _joined(passages or [])))):
                column.append(x)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds))], ["doc", *names])


_CUT = (("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string"), ("kept", "string"), ("n_passage_bytes", "long"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, words: bool = False, hot: int = HOT) -> DataFrame:
    """(doc_id, crc, start, stop) of docs (doc_id long, text binary): bytes that repeated strings cover, which may overlap."""
    spark, parts = docs.sparkSession, shards(docs)
    anchors = materialize(docs.mapInArrow(partial(_anchors, length=length, words=words), _ANCHORS), "anchors")
    total = anchors.count()
    common = materialize(anchors.groupBy("key").agg(F.count("*").alias("rows")).filter("rows > 1"), "common")
    again = materialize(spread_join(anchors, common, ["key"], total).drop("rows"), "again")
    forget(anchors, common)
    rep = F.min(F.struct("doc_id", "crc", "b0", "size", "n", "off")).alias("rep")
    asked = again.groupBy("key", "wh").agg(F.count("*").alias("rows"), rep).select("key", "wh", "rows", "rep.*")
    # rows that repeat id and text are fetched once
    texts = docs.select(F.col("doc_id").alias("i"), "text", (F.crc32("text") - F.lit(1 << 31)).cast("int").alias("c")).groupBy("i", "c").agg(F.first("text").alias("text"))
    fetched = asked.join(texts, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("crc") == F.col("c")))
    text = F.substring("text", F.col("b0") + 1, F.col("size")).alias("text")
    level = materialize(fetched.select("key", "wh", F.col("rows").alias("weight"), "rows", F.lit(length // 2).cast("int").alias("core"), "off", "n", text), "windows")
    found, cut = [], []  # by level
    while True:
        many = materialize(level.filter(F.col("core") < length).groupBy("key").agg(F.count("*").alias("windows")).filter(F.col("windows") > hot).select("key"), "many")
        split = many.count()
        own = F.broadcast(many) if split * 8 <= MAX_BROADCAST_BYTES else many
        merge = level.join(own, "key", "left_anti") if split else level
        merge = merge.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(partial(_merged, length=length, words=words), _FOUND)
        found.append(materialize(merge, "found"))
        if not split:
            forget(level)
            break
        part = materialize(level.join(own, "key", "left_semi").mapInArrow(partial(_split, length=length, words=words), _PART), "parts")
        forget(level)
        firsts = [F.first(c).alias(c) for c in ("core", "off", "n", "text")]
        level = materialize(part.groupBy("key", "wh").agg(F.sum("weight").alias("weight"), F.count("*").alias("rows"), *firsts), "windows")
        cut.append(part)
    out = found.pop()
    while cut:  # what is found in a part is found in the windows that it is of
        part = cut.pop()
        joined = spread_join(part.drop("weight", "text"), out, ["key", "wh"], part.count())
        joined = joined.select(F.col("of_key").alias("key"), F.col("of_wh").alias("wh"), F.col("of_rows").alias("rows"), F.transform("spans", lambda x: x + F.col("at")).alias("spans"))
        out = materialize(joined.unionByName(found.pop()), "found")
    spans = spread_join(again, out.select("key", "wh", "rows", F.get("spans", F.lit(0)).alias("s"), F.get("spans", F.lit(1)).alias("e")), ["key", "wh"], total)
    return spans.select("doc_id", "crc", (F.col("b0") + F.col("s")).alias("start"), (F.col("b0") + F.col("e")).alias("stop"))


def cut_repeats(docs: DataFrame, length: int = LENGTH, words: bool = False, passage_words: int = 0) -> DataFrame:
    """One row per row of docs (doc_id, text, ...): struct doc of all its columns, n_bytes, n_removed, n_spans, kept_sha256 (of the
    bytes that stay), kept (these bytes as text, without the parts of characters that a cut may leave), and n_passage_bytes: if
    passage_words is given, the bytes in passages of at least so many words that occur elsewhere, else 0.

    Each byte covered by a string of `length` bytes that also starts elsewhere in the input, the same text included, is removed; texts are
    UTF-8, null is empty. With words, a string is `length` words, whatever the white space between them, and goes from its first word's first byte to its last one's last.
    Repeated rows count as texts of their own, and so lose what is `length` or longer; null ids are allowed. Texts of any length are read in
    overlapping parts. Ties don't arise: all occurrences go. An empty table gives no rows; other columns are only carried, whatever their names.
    """
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b"")).alias("text"))
    spans = repeated_spans(rows.select("doc_id", "text"), length, words)
    if passage_words:
        spans = spans.withColumn("cut", F.lit(True)).unionByName(repeated_spans(rows.select("doc_id", "text"), passage_words, True).withColumn("cut", F.lit(False)))
    else:
        spans = spans.withColumn("cut", F.lit(True))
    # one window's strings cover one run; windows that follow each other overlap
    of = lambda cut: F.collect_list(F.when(F.col("cut") == cut, F.array("start", "stop")))
    spans = spans.groupBy(F.col("doc_id").alias("i"), F.col("crc").alias("c")).agg(of(True).alias("spans"), of(False).alias("passages"))
    both = rows.withColumn("crc", (F.crc32("text") - F.lit(1 << 31)).cast("int"))
    joined = both.join(spans, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("crc") == F.col("c")), "left").select("doc", "text", "spans", "passages")
    schema = StructType().add("doc", joined.schema["doc"].dataType)
    for name, kind in _CUT:
        schema = schema.add(name, kind)
    return joined.mapInArrow(_cut, schema)


def drop_repeats(docs: DataFrame, length: int = LENGTH, words: bool = False) -> DataFrame:
    """docs with its columns: text without the repeated strings and the parts of characters that a cut leaves, and n_chars, if there, made new."""
    cut = cut_repeats(docs, length, words)
    text = F.when(F.col("n_removed") == 0, F.col("doc.text")).otherwise(F.col("kept"))
    cut = cut.select("doc", text.alias("left"))
    made = {"text": F.col("left"), "n_chars": F.length(F.coalesce("left", F.lit(""))).cast("long")}
    return cut.select(*(made.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and n_passage_bytes: bytes in repeated passages of over 50 words, which may have fewer than 400 bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = cut_repeats(docs, passage_words=PASSAGE_WORDS)
    return cut.select(F.col("doc.doc_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes")
