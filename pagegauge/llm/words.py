"""Word shingles of whole texts as 64-bit hashes, many texts at a time in numpy.

Words are runs of bytes other than blank, tab, line feed, vertical tab, form
feed and carriage return; A-Z count as a-z.  A text with at least ``size``
words has its distinct shingles of ``size`` words; one with fewer, its whole
sequence of words; one without words, none.

Every word is hashed on its own under a key (xxHash, 64 bits), and the hashes
of a shingle are chained in order through a mixing function, together with
their number.  Neither step is linear, so different shingles share a hash only
by chance, about once in 2**64 pairs, whatever the words are and however long.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import xxhash

#: Words whose shingles are made at a time.
BLOCK = 1 << 18
_KEY = 0x2545F4914F6CDD1D
_CHAIN = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A well spread 64-bit value of each 64-bit value."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def digest(words: list[bytes]) -> bytes:
    """128 bits of the word sequence; equal for texts with the same words."""
    return hashlib.md5(b" ".join(words), usedforsecurity=False).digest()


def _chained(hashes: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words that begin at ``first``."""
    value = np.full(len(first), size, np.uint64)
    for k in range(size):
        value = mixed(value * _CHAIN + hashes[first + k])
    return value


def shingle_sets(texts: list[list[bytes]], size: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each word list."""
    out: list[np.ndarray] = []
    hashed = partial(xxhash.xxh3_64_intdigest, seed=_KEY)
    for words in texts:
        hashes = np.fromiter(map(hashed, words), np.uint64, len(words))
        if len(words) <= size:
            out.append(_chained(hashes, np.zeros(min(1, len(words)), np.int64), len(words)))
            continue
        starts = np.arange(len(words) - size + 1)
        parts = [np.unique(_chained(hashes, starts[k:k + BLOCK], size)) for k in range(0, len(starts), BLOCK)]
        out.append(parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts)))
    return out
