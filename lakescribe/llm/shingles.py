"""Word shingles as 64-bit fingerprints, computed on whole texts inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers, one per word of a shingle, from a fixed linear congruential rule.
_ODD = [(0x9E3779B97F4A7C15 * (2 * i + 1) ^ (0xD1B54A32D192ED03 >> i)) & (2**64 - 1) | 1 for i in range(64)]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of fingerprints (a bijection on 64 bits)."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def lower_words(text: str | bytes | None) -> list[bytes]:
    """Words of the text (runs without ASCII white space), A-Z in lower case; none for null."""
    return (text.encode() if isinstance(text, str) else text or b"").lower().split()


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, sorted."""
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


def shingle_set(text: str | bytes | None, width: int = 5) -> np.ndarray:
    """Sorted distinct fingerprints of `width`-word shingles; of fewer words the whole sequence is the
    only one; without words the set is empty."""
    words = lower_words(text)
    if not words:
        return np.empty(0, np.uint64)
    ids = np.array(list(map(xxhash.xxh3_64_intdigest, words)), np.uint64)
    n = min(width, len(words))
    total = np.full(len(words) - n + 1, 0 if n == width else n, np.uint64)
    for j in range(n):
        total += ids[j : len(ids) - n + 1 + j] * np.uint64(_ODD[j])
    return distinct(mix(total))
