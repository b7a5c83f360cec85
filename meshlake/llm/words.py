"""Word and shingle hashes of batches of texts, as arrays.

Words are what stands between ASCII white space, with A-Z lower-cased and punctuation taken off their ends (a word of
nothing but punctuation is left as it is).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SHINGLE = 5
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class Vocabulary(dict):
    """Hash of each word met so far; forgets them when there are too many."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.strip(MARKS) or word, 9)
        return h

    def hashes(self, text: bytes) -> list[int]:
        return [self[w] for w in text.lower().split()]


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of `k` words (empty where there are fewer)."""
    n = len(words) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for i in range(1, k):
        h = h * _ODD + words[i : i + n]
    h ^= h >> np.uint64(29)
    h *= _MIX
    h ^= h >> np.uint64(32)
    return h


def blocks(texts: Iterable[bytes | None], vocabulary: Vocabulary, most: int = 1 << 17) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts of about `most` words: (number of the first text, hashes of all words, where each text begins and the last ends)."""
    first, words, starts = 0, [], [0]
    for i, text in enumerate(texts):
        words += vocabulary.hashes(text or b"")
        starts.append(len(words))
        if len(words) >= most:
            yield first, np.array(words, np.uint64), np.array(starts)
            first, words, starts = i + 1, [], [0]
    if len(starts) > 1:
        yield first, np.array(words, np.uint64), np.array(starts)


class Lookup:
    """Where hashes of a fixed sorted set occur in an array; a bitmap leaves out most others at once."""

    def __init__(self, values: np.ndarray, bits: int = 20):
        self.values, self.shift = np.unique(values), np.uint64(64 - bits)
        self.map = np.zeros(1 << bits, bool)
        self.map[self.values >> self.shift] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in `h`, places in `values`) of all occurrences."""
        at = np.nonzero(self.map[h >> self.shift])[0]
        if not len(at) or not len(self.values):
            return at[:0], at[:0]
        place = np.searchsorted(self.values, h[at])
        ok = self.values[np.minimum(place, len(self.values) - 1)] == h[at]
        return at[ok], place[ok]


def bag(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(h, return_counts=True)


def shared(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """Weight that two bags have in common."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    return int(np.minimum(a[1][i], b[1][j]).sum())
