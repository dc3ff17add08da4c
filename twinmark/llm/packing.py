"""Operator 7: bounded-space online best-fit packing of tokenized documents.

Each partition tokenizes its documents and packs the pieces into sequences: a piece goes to the open sequence
with the least free space that holds it, found in a bitset whose bit f says that some open sequence has f free
places. A fixed number of sequences is open; when one more is needed the fullest closes. A look-ahead window of
fixed size is packed longest piece first (ahead = 1: strictly online). What is still open when a partition ends, a bounded number of sequences,
is packed anew together with that of other partitions, in the same way, so many small partitions leave no more room than few. Memory does not depend on the input.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .shared import materialize, table

MAX_TOKENS, END_ID = 1024, 2
#: Open sequences, pieces looked ahead, words whose ids are remembered.
OPEN, AHEAD, REMEMBERED = 8192, 16384, 250_000
#: Left-over pieces that one task packs anew, about.
AGAIN = 200_000
#: Words of more characters are not remembered.
LONG_WORD = 64

# A blank that a word follows starts a new pre-token, so texts may be cut there; tests compare with whole texts.
_CUT = re.compile(r" (?=[^\s])")


class Packer:
    """Places pieces of 1..size tokens; sequence numbers count from 0."""

    def __init__(self, size: int = MAX_TOKENS, bins: int = OPEN):
        self.size, self.bins = size, bins
        self.free = 0  # bit f: there is an open sequence with f free places
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]
        self.open = self.count = 0
        self.closed: list[int] = []  # sequences that get no more pieces; the caller empties it

    def _take(self, f: int) -> int:
        number = self.by_free[f].pop()
        if not self.by_free[f]:
            self.free &= ~(1 << f)
        self.open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) of a piece."""
        fits = self.free >> length
        if fits:
            f = (fits & -fits).bit_length() - 1 + length
            number = self._take(f)
        else:
            f, number = self.size, self.count
            self.count += 1
        left = f - length
        if left:
            if self.open == self.bins:
                self.closed.append(self._take((self.free & -self.free).bit_length() - 1))
            self.by_free[left].append(number)
            self.free |= 1 << left
            self.open += 1
        else:
            self.closed.append(number)
        return number, self.size - f


class _Sequences:
    """Rows by open sequence. A row is (doc_id, piece, start, length, crc[, ids])."""

    def __init__(self, size: int, bins: int, base: int):
        self.packer, self.base, self.rows = Packer(size, bins), base, {}

    def place(self, rows: list[tuple]) -> list[tuple]:
        """Place rows, longest first; the rows of the sequences that close, with their place."""
        out = []
        for x in sorted(rows, key=lambda x: -x[3]):
            number, offset = self.packer.place(x[3])
            self.rows.setdefault(number, []).append((*x[:5], self.base + number, offset, *x[5:]))
            while self.packer.closed:
                out += self.rows.pop(self.packer.closed.pop())
        return out

    def rest(self) -> list[tuple]:
        return [x for rows in self.rows.values() for x in rows]


# Fixed value: the pre-tokens of byte-level BPE.
_PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def _tokenizer(path: str):
    """The byte-level BPE of a tokenizers file as a (faster) tiktoken encoder, whose merge ranks are the file's ids, each id's size in bytes, and the ids of added tokens.

    To the encoder an added token's string is ordinary text.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    model, special = made["model"], {t["content"] for t in made.get("added_tokens", [])}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(plain))}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    order = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if order != sorted(order):
        raise ValueError(f"{path}: ids are not in the order of merges")
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        sizes[i] = len(token)
    if any(t.get(k) for t in made.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError(f"{path}: added tokens that take what is beside them into account")
    added = {t["content"]: t["id"] for t in made.get("added_tokens", [])}
    return tiktoken.Encoding(name="own", pat_str=_PRE_TOKENS, mergeable_ranks=ranks, special_tokens={}), sizes, added


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes; remembers a bounded number of words, most recent ones first.

    With added_tokens, texts are split at the file's added tokens first, which get their own ids; without, their strings are ordinary text.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED, added_tokens: bool = False):
        (self.tokenizer, self.sizes, added), self.remembered = _tokenizer(path), remembered
        self.added = {t: i.to_bytes(4, "little") for t, i in added.items()} if added_tokens else {}
        # the longest of those that begin at a place
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _encode(self, words: list[str]) -> Iterator[bytes]:
        """Ids of words that follow a blank, all in one text: no token reaches over the blank's left."""
        for at in range(0, len(words), 20_000):
            some = [" " + w for w in words[at : at + 20_000]]
            ids = np.array(self.tokenizer.encode_ordinary("".join(some)), np.uint32)
            ends = np.cumsum([len(w.encode()) for w in some])
            cuts = (4 * np.searchsorted(np.cumsum(self.sizes[ids]), ends, side="right")).tolist()
            data = ids.tobytes()
            yield from (data[s:e] for s, e in zip([0, *cuts], cuts))

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.added:
            return self._ordinary(texts)
        # ordinary text and added tokens by turns
        runs = [self.split(t) for t in texts]
        got = iter(self._ordinary([x for r in runs for x in r[::2]]))
        return [b"".join(self.added[x] if k % 2 else next(got) for k, x in enumerate(r)) for r in runs]

    def _ordinary(self, texts: list[str]) -> list[bytes]:
        # words after the first are kept without the blank before them
        parts = [t.split(" ") for t in texts]
        firsts = [p.pop(0) for p in parts]
        new = set().union(*parts).difference(self.young)
        odd = {w for w in new if not w or w[0].isspace()}
        if odd:  # a blank before white space starts no pre-token
            for i, p in enumerate(parts):
                if not odd.isdisjoint(p):
                    firsts[i], parts[i] = _split(texts[i])
            new = set().union(*parts).difference(self.young)
        if len(self.young) + len(new) > self.remembered:
            self.young, self.old = {}, self.young
            new = set().union(*parts)
        known = new.intersection(self.old)
        self.young.update((w, self.old[w]) for w in known)
        new = sorted(new - known)
        self.young.update(zip(new, self._encode(new)))
        first = {f: np.array(self.tokenizer.encode_ordinary(f), np.uint32).tobytes() for f in set(firsts)}
        get = self.young.__getitem__
        out = [b"".join((first[f], *map(get, p))) for f, p in zip(firsts, parts)]
        for w in new:
            if len(w) > LONG_WORD:
                del self.young[w]
        return out


def _split(text: str) -> tuple[str, list[str]]:
    """Cut before each blank that a word follows: the first part, and the others without their blank."""
    first, *rest = _CUT.split(text)
    return first, rest


def pieces_of(n: int, size: int = MAX_TOKENS) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole if it fits, else a shorter first piece and full ones."""
    if n <= size:
        return [(0, n)]
    first = n % size
    return ([(0, first)] if first else []) + [(s, size) for s in range(first, n, size)]


_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _batch(rows: list[tuple], ids: bool, closed: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5, *([pa.binary()] if ids else [])]
    names = [x.split()[0] for x in _PLACED.split(", ")] + ["ids"] * ids
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds)), pa.array([closed] * len(rows), pa.bool_())], [*names, "closed"])


def _again(batches: Iterator[pa.RecordBatch], size: int, bins: int, ahead: int, ids: bool) -> Iterator[pa.RecordBatch]:
    """Pieces of sequences that partitions left open, packed anew."""
    sequences, waiting = _Sequences(size, bins, (1 << 62) + (TaskContext.get().partitionId() << 40)), []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns[: 7 + ids])):
            waiting.append((*row[:5], *row[7:]))
            if len(waiting) >= ahead:
                yield _batch(sequences.place(waiting), ids, True)
                waiting = []
    yield _batch(sequences.place(waiting) + sequences.rest(), ids, True)


def _pack(batches: Iterator[pa.RecordBatch], path: str, size: int, end_id: int, bins: int, ahead: int, ids: bool, added_tokens: bool) -> Iterator[pa.RecordBatch]:
    encode, sequences, waiting = Encoder(path, added_tokens=added_tokens), _Sequences(size, bins, TaskContext.get().partitionId() << 40), []
    end = end_id.to_bytes(4, "little")
    for batch in batches:
        doc_ids = batch.column(0).to_pylist()
        texts = batch.column(1).to_pylist()
        for at in range(0, len(texts), 256):
            for doc_id, got in zip(doc_ids[at : at + 256], encode([t or "" for t in texts[at : at + 256]])):
                got += end
                for piece, (start, length) in enumerate(pieces_of(len(got) // 4, size)):
                    own = got[4 * start : 4 * (start + length)]
                    waiting.append((doc_id, piece, start, length, zlib.crc32(own), *([own] if ids else [])))
            if len(waiting) >= ahead:
                yield _batch(sequences.place(waiting), ids, True)
                waiting = []
    yield _batch(sequences.place(waiting), ids, True)
    yield _batch(sequences.rest(), ids, False)


def pack(docs: DataFrame, tokenizer: str, size: int = MAX_TOKENS, end_id: int = END_ID, bins: int = OPEN, ahead: int = AHEAD, ids: bool = False, added_tokens: bool = False) -> DataFrame:
    """One row per piece of each row of docs (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ids adds the piece's ids as little-endian unsigned 32-bit integers; added_tokens gives the tokenizer's added tokens in a text their own ids. Null and empty texts are their end id alone; a long
    text is encoded whole and cut into pieces. Of sequences with the same free space the one that came to it last is taken; of pieces of one length the first in a window goes first. Repeated rows
    and null ids are documents of their own; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    run = partial(_pack, path=tokenizer, size=size, end_id=end_id, bins=bins, ahead=ahead, ids=ids, added_tokens=added_tokens)
    schema = _PLACED + ", ids binary" * ids + ", closed boolean"
    placed = materialize(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema), "placed")
    left = placed.filter("not closed")
    tasks = -(-left.count() // AGAIN)
    if tasks:
        # each partition's sequences are dealt out evenly
        again = left.repartition(tasks, F.xxhash64("sequence_id")).mapInArrow(partial(_again, size=size, bins=bins, ahead=AGAIN, ids=ids), schema)
        placed = placed.filter("closed").unionByName(again)
    return placed.drop("closed")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer(), added_tokens=True)
