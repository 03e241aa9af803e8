"""Fast splitting into words (maximal runs of letters and digits of the lower-cased text) and stable word hashes."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
_BLANKED = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in range(256))
_CACHE_ENTRIES = 1_000_000


def words(text: str) -> list[bytes]:
    """The words of `text` as UTF-8; ASCII texts take a byte-table path that gives the same result as the pattern."""
    text = text.lower()
    if text.isascii():
        return text.encode().translate(_BLANKED).split()
    return [w.encode() for w in WORD.findall(text)]


class WordHashes(dict):
    """word -> 64-bit hash; only a cache, so it may be emptied at any time."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer on uint64 (the public splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingle_hashes(texts: list[str | None], size: int, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all `size`-word sequences of the texts, and the offsets (len(texts) + 1) where each text's begin.

    A text with fewer than `size` words, or a null, has none.
    """
    flat: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    look = hashes.__getitem__
    for i, text in enumerate(texts):
        if text:
            own = words(text)
            if len(own) >= size:
                counts[i] = len(own)
                flat.extend(map(look, own))
    values = np.array(flat, np.uint64)
    ends = np.cumsum(counts)
    made = np.maximum(counts - (size - 1), 0)
    if not len(values):
        return values, np.zeros(len(texts) + 1, np.int64)
    whole = len(values) - size + 1
    sums = np.zeros(whole, np.uint64)
    for k in range(size):
        sums = mix64(sums * np.uint64(0x9E3779B97F4A7C15) + values[k : k + whole]) if k else mix64(values[:whole])
    keep = np.ones(whole, bool)
    for end in ends[counts > 0][:-1]:
        keep[end - size + 1 : end] = False
    return sums[keep], np.concatenate([[0], np.cumsum(made)])
