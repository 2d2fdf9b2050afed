"""Word shingles as sorted sets of 64-bit hashes (used inside tasks)."""

from __future__ import annotations

import numpy as np
import xxhash

SIZE = 5
_MIX = np.uint64(0x9E3779B97F4A7C15)
_WORDS_KEPT = 2_000_000


class WordHash(dict):
    """64-bit hash per word, kept for words seen before; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASH = WordHash()


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words of a text, A-Z lower-cased. ``bytes.lower`` and
    ``bytes.split`` are exactly that alphabet and space, \\t \\n \\x0b \\x0c \\r."""
    words = text.encode().lower().split()
    return np.fromiter(map(_HASH.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, size: int = SIZE) -> np.ndarray:
    """Sorted distinct shingle hashes; a text of fewer words is one shingle, a
    text without words has none."""
    w = word_hashes(text or "")
    if not len(w):
        return w
    if len(w) < size:
        h = np.uint64(len(w))
        for x in w:
            h = np.uint64((int(h) * int(_MIX) + int(x)) & 0xFFFFFFFFFFFFFFFF)
        return mixed(np.array([h], dtype=np.uint64))
    n = len(w) - size + 1
    h = w[:n]
    for k in range(1, size):
        h = h * _MIX + w[k:k + n]
    return np.unique(mixed(h))


def word_hashes_as_written(text: str) -> tuple[list[bytes], np.ndarray]:
    """Words of a text, case kept, and their hashes."""
    words = text.encode().split()
    return words, np.fromiter(map(_HASH.__getitem__, words), dtype=np.uint64, count=len(words))
