"""Words of a text as 64-bit numbers, shingles of them, and sets of shingles."""

from __future__ import annotations

import numpy as np
import xxhash

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hash of a word (bytes), remembered for up to ``room`` words."""

    room = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.room:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def split_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, other letters as they are; [] for null."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_numbers(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def rolled(numbers: np.ndarray, size: int) -> np.ndarray:
    """One number per run of ``size`` words, in order."""
    x = np.zeros(max(0, len(numbers) - size + 1), np.uint64)
    for i in range(size):
        x = x * _MULTIPLY + numbers[i:i + len(x)]
    return mixed(x)


def shingle_set(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingles; a text of fewer words is one shingle, an empty one has none."""
    numbers = word_numbers(split_words(text), hashes)
    return np.unique(rolled(numbers, min(size, max(1, len(numbers)))))
