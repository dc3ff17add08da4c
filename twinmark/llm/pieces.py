"""Operator 4: SentencePiece encoding and decoding by an Aho-Corasick automaton that drives a Viterbi search.

One pass over the text: at each place the automaton's output links give every piece that ends there, and each
relaxes the best score of that place from the best score of its start. In a unigram model a path's score is the sum of its pieces' scores.
In a BPE model a step costs nothing if the piece before it and its own piece stay apart when the two are merged by the model's ranks, and is
ruled out if not: a path whose neighbours all stay apart is what merging the whole text gives, so the ids are the model's own.
Pieces hold the blank only in front, so the best path of a text consists of the best paths of its words with the blanks before them, and
words' paths are remembered.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

BLANK = "▁"
#: How far below the least score a character without a piece is, as its bytes.
UNKNOWN = 10.0
#: Words that are remembered (words of more characters are not), and pairs of pieces.
REMEMBERED, LONG_WORD, REMEMBERED_PAIRS = 250_000, 64, 1_000_000

_WORDS = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")


class Pieces:
    """A SentencePiece model's pieces with their scores and byte fallback. merges: the scores are ranks of merges (BPE), not log-probabilities."""

    def __init__(self, vocabulary: list[tuple[str, float]], byte_ids: list[int], merges: bool = False):
        """vocabulary: (piece, score) by id; a score of None marks pieces that no text gives (control, unknown, bytes). byte_ids: by byte."""
        import ahocorasick

        self.byte_ids, self.merges = byte_ids, merges
        self.automaton = ahocorasick.Automaton()
        self.least = min(s for _, s in vocabulary if s is not None) - UNKNOWN
        self.apart = True
        self.raw, self.pieces = [b""] * len(vocabulary), [p for p, _ in vocabulary]
        self.ranks = {p: s for p, s in vocabulary if s is not None}
        self.stay: dict[int, bool] = {}  # by both ids
        for i, (piece, score) in enumerate(vocabulary):
            if score is not None and piece:
                self.automaton.add_word(piece, (i, len(piece), 0.0 if merges else score))
                self.apart &= BLANK not in piece.lstrip(BLANK)
                self.raw[i] = piece.replace(BLANK, " ").encode()
        for b, i in enumerate(byte_ids):
            self.raw[i] = bytes([b])
        self.automaton.make_automaton()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """A short text's characters, merged best rank first, of equal ones the leftmost."""
        parts, rank, none = list(text), self.ranks.get, -math.inf
        ranks = [rank(a + b, none) for a, b in zip(parts, parts[1:])]  # of each part with the next
        while ranks and (best := max(ranks)) > none:
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank(parts[at - 1] + parts[at], none)
            if at < len(ranks):
                ranks[at] = rank(parts[at] + parts[at + 1], none)
        return parts

    def _stays(self, before: int, piece: int) -> bool:
        """Whether merging a piece and the one before it (-1: the text's start or bytes, with which nothing merges) gives them back."""
        parts = [self.pieces[i] for i in (before, piece) if i >= 0]
        if len(self.stay) >= REMEMBERED_PAIRS:
            self.stay.clear()
        out = self.stay[before << 20 | piece] = self.merged("".join(parts)) == parts
        return out

    def _stable_path(self, text: str) -> tuple[list[int], list[int]]:
        """For each place, the last piece (-1: bytes) of the one path to it whose neighbours all stay apart, and where it starts."""
        n, known = len(text), self.stay.get
        piece, start = [-2] * (n + 1), list(range(-1, n))
        piece[0] = -1
        for last, (i, length, _) in self.automaton.iter(text):
            end = last + 1
            if piece[end] == -2:
                s = end - length
                before = piece[s]
                if before == -2:  # no piece ends there, so the character before it goes as bytes
                    before = -1
                stays = known(before << 20 | i)
                if stays or (stays is None and self._stays(before, i)):
                    piece[end], start[end] = i, s
        return piece, start

    def _best_sums(self, text: str) -> tuple[list[int], list[int]]:
        """For each place, the last piece (-1: bytes) of the path with the largest sum of scores, and where it starts; of equal ones, that with the
        fewest pieces, then the longest last ones."""
        n = len(text)
        score, count, start, piece = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1), [-2] * (n + 1)
        done = 0  # places up to here are final

        def unknown(to: int) -> None:
            # places that no piece ends at are reached by the character before them, as its bytes
            nonlocal done
            for i in range(done + 1, to + 1):
                if piece[i] == -2:
                    score[i], count[i], start[i], piece[i] = score[i - 1] + self.least, count[i - 1] + 1, i - 1, -1
            done = to

        for last, (i, length, own) in self.automaton.iter(text):
            end = last + 1
            if end - 1 > done:
                unknown(end - 1)
            s = end - length
            total, steps = score[s] + own, count[s] + 1
            if piece[end] == -2 or total > score[end] or (total == score[end] and (steps < count[end] or (steps == count[end] and s < start[end]))):
                score[end], count[end], start[end], piece[end] = total, steps, s, i
        unknown(n)
        return piece, start

    def best_path(self, text: str) -> list[int]:
        """Ids of the best path of a text."""
        piece, start = self._stable_path(text) if self.merges else self._best_sums(text)
        out, n = [], len(text)
        while n:
            if piece[n] >= 0:
                out.append(piece[n])
            else:
                out.extend(self.byte_ids[b] for b in reversed(text[n - 1].encode("utf-8", "surrogatepass")))
            n = start[n]
        return out[::-1]

    def _ids(self, word: str) -> bytes:
        found = self.young.get(word)
        if found is None:
            found = self.old.get(word)
            if found is None:
                ids = self.best_path(word)
                found = np.array(ids, np.int32).tobytes()
            if len(word) <= LONG_WORD:
                if len(self.young) >= REMEMBERED:
                    self.young, self.old = {}, self.young
                self.young[word] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids as native 32-bit integers. The text gets a blank in front, and spaces are blanks."""
        if not text:
            return b""
        shown = BLANK + text.replace(" ", BLANK)
        if not self.apart:
            return np.array(self.best_path(shown), np.int32).tobytes()
        return b"".join(map(self._ids, _WORDS.findall(shown)))

    def decode(self, ids: list[int]) -> bytes:
        """The text's UTF-8 bytes."""
        return b"".join(map(self.raw.__getitem__, ids))[1:]


@cache
def load(path: str) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    vocabulary, byte_ids = [], [0] * 256
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        plain = not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
        vocabulary.append((piece, model.get_score(i) if plain else None))
    # scores of BPE pieces are ranks, whole numbers
    return Pieces(vocabulary, byte_ids, merges=all(s == int(s) for _, s in vocabulary if s is not None))


_ENCODED = "doc_id long, n_pieces long, ids array<int>, decoded_sha256 string"


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    pieces = load(path)
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            got = [pieces.encode(t or "") for t in part.column(1).to_pylist()]
            flat, ends = np.frombuffer(b"".join(got), np.int32), np.cumsum([0, *(len(x) // 4 for x in got)])
            digests = [hashlib.sha256(pieces.decode(flat[s:e].tolist())).hexdigest() for s, e in zip(ends[:-1], ends[1:])]
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(ends), pa.int64()), ids, pa.array(digests)], ["doc_id", "n_pieces", "ids", "decoded_sha256"])


def encode_texts(docs: DataFrame, model: str) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_pieces, ids, and the SHA-256 of what the ids decode to: the text, but a blank sign (U+2581)
    in it, which to the model is a space, comes back as one. Null and empty texts have no pieces; a long text is one pass, and held whole. Works row by row: repeated rows give a row each, an empty table none; other columns are ignored.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(partial(_encode, path=model), _ENCODED)


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    pieces = load(path)
    for batch in batches:
        texts = [pieces.decode(x or []).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])


def decode_ids(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, text). Null and empty ids decode to the empty text; bytes that are no UTF-8 become U+FFFD."""
    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(partial(_decode, path=model), "doc_id long, text string")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), default_model())
