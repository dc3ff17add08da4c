"""Word and shingle hashes of many texts at once (numpy)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

from .shared import WHITE_BYTES

#: Bytes hashed at once.
CHUNK = 1 << 20

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_FACTORS = np.random.default_rng(5).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WHITE = np.zeros(256, bool)
_WHITE[list(WHITE_BYTES)] = True


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA0761D6478BD642F)
    h ^= h >> np.uint64(32)
    return h


@cache
def _values() -> np.ndarray:
    return np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.ones(n, np.uint64), np.ones(n, np.uint64)
    up[1:], down[1:] = np.uint64(_MULTIPLIER), np.uint64(pow(_MULTIPLIER, -1, 1 << 64))
    return np.cumprod(up), np.cumprod(down)


def word_places(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of bytes."""
    word = np.zeros(len(b) + 2, np.int8)
    word[1:-1] = ~_WHITE[b]
    edges = np.diff(word)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def _hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of data; a word's hash doesn't depend on its place."""
    b = np.frombuffer(data, np.uint8)
    starts, ends = word_places(b)
    size = CHUNK * 2
    while size < len(b) + 1:
        size *= 2
    up, down = _powers(size)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_values()[b] * up[: len(b)], out=total[1:])
    return starts, mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _parts(text: bytes) -> Iterator[bytes]:
    """Pieces of about CHUNK bytes, cut at white space."""
    at = 0
    while len(text) - at > CHUNK:
        end = at + CHUNK
        while end < len(text) and text[end] not in WHITE_BYTES:
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): hashes of all words of all texts, in order, and the number of words of each text."""
    hashes, counts = [], np.zeros(len(texts), np.int64)
    held, owners, size = [], [], 0

    def flush() -> None:
        starts, got = _hash_words(b" ".join(held))
        ends = np.cumsum([len(x) + 1 for x in held])
        np.add.at(counts, np.array(owners, np.int64)[np.searchsorted(ends, starts, side="right")], 1)
        hashes.append(got)

    for i, text in enumerate(texts):
        for part in _parts(text):
            if held and size + len(part) > CHUNK:
                flush()
                held, owners, size = [], [], 0
            held.append(part)
            owners.append(i)
            size += len(part) + 1
    if held:
        flush()
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts


def shingle_hashes(texts: list[bytes], words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the shingles of the texts, repeats included; a text with fewer words has its whole sequence as one."""
    hashes, counts = word_hashes(texts)
    short = (counts > 0) & (counts < words)
    made = np.where(short, 1, np.maximum(counts - words + 1, 0))
    first = np.cumsum(counts) - counts
    out = np.zeros(int(made.sum()), np.uint64)
    at = np.repeat(first - (np.cumsum(made) - made), made) + np.arange(len(out))
    padded = np.concatenate([hashes, np.zeros(words, np.uint64)])
    size = np.repeat(np.minimum(counts, words), made)
    for j in range(words):
        out += np.where(j < size, padded[at + j] * _FACTORS[j], np.uint64(0))
    return mix(out + size.astype(np.uint64)), made


def folded(text: str | None) -> bytes:
    """UTF-8 with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower()
