"""Sets of word shingles as sorted 64-bit hashes, for whole batches of texts at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from gridsignal.llm.blobs import mix

# fixed values: ASCII white space, and A-Z to a-z
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(int(BASE), -1, 1 << 64))
SALTS = [np.uint64(pow(int(BASE), 3 * i + 5, 1 << 64)) for i in range(16)]


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    def of(base: np.uint64) -> np.ndarray:
        out = np.full(size, base)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return of(BASE), of(UNBASE)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    up, down = _powers(1 << max(16, (size - 1).bit_length()))
    return up[:size], down[:size]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes modulo 2^64; substring hashes are scaled differences of two of them."""
    out = np.zeros(len(data) + 1, np.uint64)
    up, _ = powers(max(1, len(data)))
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (lower-case A-Z, cut at ASCII white space), and where each text's words begin."""
    solid = ~SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.concatenate([[False], solid[:-1]]) if len(data) else solid
    after = np.concatenate([solid[1:], [False]]) if len(data) else solid
    starts = np.flatnonzero(solid & (~before | first[:-1]))
    ends = np.flatnonzero(solid & (~after | first[1:])) + 1
    prefix = prefix_hashes(LOWER[data])
    _, down = powers(max(1, len(data)))
    words = mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return words, np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Each text's distinct shingles of ``size`` words, ascending. Fewer words are one shingle; none give an empty set."""
    words, begin = word_hashes(data, offsets)
    counts = np.diff(begin)
    grams = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for j in range(size):
        grams += words[j : j + len(grams)] * SALTS[j]
    grams = mix(grams)
    sets = []
    for start, n in zip(begin[:-1].tolist(), counts.tolist()):
        if n >= size:
            part = np.sort(grams[start : start + n - size + 1])
            sets.append(part[np.concatenate([[True], part[1:] != part[:-1]])])
        elif n:
            one = np.sum(words[start : start + n] * np.array(SALTS[:n]), dtype=np.uint64) + np.uint64(n)
            sets.append(mix(np.array([one], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets
