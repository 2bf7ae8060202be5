"""Hashed word shingles of a text (small per-row helper)."""

from __future__ import annotations

import numpy as np
import xxhash

_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Distinct words whose hashes a task keeps before it starts anew.
MAX_WORDS = 200_000


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every other."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words; ``bytes.split`` cuts at exactly the ASCII white space."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, text: str | None) -> np.ndarray:
        """Hashes of the lower-cased (A-Z) words of a text, in order."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if len(self) > MAX_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles; shorter texts are one shingle, empty ones none."""
    if not len(words):
        return words
    size = min(size, len(words))
    acc = np.full(len(words) - size + 1, size, np.uint64)
    for at in range(size):
        acc = acc * _STEP + words[at:len(words) - size + 1 + at]
    return np.unique(mixed(acc))
