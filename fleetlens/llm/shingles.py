"""Word shingles as sorted arrays of distinct 64-bit hashes (Python helpers that run inside tasks)."""

from __future__ import annotations

import numpy as np
import xxhash

_MUL = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)
KEPT_WORDS = 300_000


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > KEPT_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(hashes: np.ndarray, n: int, k: int) -> np.ndarray:
    """One hash for each k words that follow each other; n keeps lengths apart."""
    out = np.full(len(hashes) - k + 1, n, np.uint64)
    for j in range(k):
        out = (out ^ hashes[j : len(hashes) - k + 1 + j]) * _MUL
        out ^= out >> _SHIFT
    return out


def sequence_hashes(words: list[bytes], k: int, known: WordHashes) -> np.ndarray:
    """Hashes of all k-word shingles in order; of fewer words the whole sequence is one; none without words."""
    if not words:
        return np.zeros(0, np.uint64)
    k = min(k, len(words))
    return mixed(known.of(words), k, k)


def white_words(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, as UTF-8 (bytes.lower and bytes.split know ASCII only)."""
    return text.encode("utf-8", "surrogatepass").lower().split()
