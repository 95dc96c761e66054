"""Hashed word shingles of texts, one batch at a time, on numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

SHINGLE_WORDS = 5
CACHE_WORDS = 1 << 19
STEP = np.uint64(0x9E3779B97F4A7C15)
UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


class WordHashes(dict):
    """64-bit hashes of words, kept while they fit."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def split_words(text: bytes) -> list[bytes]:
    """Runs of bytes other than ASCII space, A-Z lower-cased."""
    return text.translate(UPPER).split()


def shingle_sets(texts: list[bytes | None], hashes: WordHashes) -> Iterator[np.ndarray]:
    """Sorted distinct 63-bit shingle hashes of each text; a text of fewer words is one shingle, without words none."""
    for text in texts:
        found = split_words(text) if text else []
        n = len(found)
        if not n:
            yield np.empty(0, np.int64)
            continue
        h = np.fromiter(map(hashes.__getitem__, found), np.uint64, n)
        size = min(n, SHINGLE_WORDS)
        out = h[: n - size + 1].copy()
        for i in range(1, size):
            out *= STEP
            out += h[i : n - size + 1 + i]
        yield np.unique((mixed(out + np.uint64(size)) >> np.uint64(1)).view(np.int64))
