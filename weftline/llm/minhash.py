"""Word sets and SuperMinHash signatures."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

STEP = np.uint64(0x9E3779B97F4A7C15)
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def words(text: Column | str) -> Column:
    """The distinct lower-cased words (longest runs of letters and digits) of a text, sorted; empty for null."""
    c = F.col(text) if isinstance(text, str) else text
    found = F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.coalesce(found, F.array().cast("array<string>"))))


def word_hashes(sorted_words: Column) -> Column:
    """64-bit hashes of words, sorted."""
    return F.array_sort(F.transform(sorted_words, lambda w: F.xxhash64(w)))


def set_key(sorted_words: Column) -> Column:
    """16 bytes that equal word sets share."""
    return F.unhex(F.md5(F.concat_ws(" ", sorted_words)))


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finisher, elementwise on uint64."""
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


def signatures(flat: np.ndarray, offsets: np.ndarray, m: int, seed: int = 1) -> np.ndarray:
    """SuperMinHash signatures, one row of m values per set; rows of empty sets are infinite.

    flat holds the elements' uint64 hashes, set i being flat[offsets[i]:offsets[i+1]]. Each element owns a random permutation of
    the m places, drawn step by step, and offers j + uniform at the place it reaches in step j; a place keeps the least offer.
    As offers of step j are at least j, a set whose places all hold less than j takes no further step.
    """
    n = len(offsets) - 1
    sig = np.full(n * m, np.inf)
    if not len(flat):
        return sig.reshape(n, m)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    uniq, inv = np.unique(flat, return_inverse=True)
    with np.errstate(over="ignore"):
        base = mix(uniq.astype(np.uint64) + np.uint64(seed) * _C1)
    perm = np.tile(np.arange(m, dtype=np.int32 if m > 32767 else np.int16), (len(uniq), 1))
    rows = np.arange(len(uniq))
    with np.errstate(over="ignore"):
        for j in range(m):
            draw = mix(base + np.uint64(2 * j + 1) * _C1)
            r = (draw >> np.uint64(11)) * 2.0**-53
            k = j + ((mix(draw + _C1) >> np.uint64(11)) * 2.0**-53 * (m - j)).astype(np.int64)
            here, there = perm[rows, j].copy(), perm[rows, k]
            perm[rows, j], perm[rows, k] = there, here
            at = owner * m + there[inv].astype(np.int64)
            offer = (j + r)[inv]
            better = sig[at] > offer
            np.minimum.at(sig, at[better], offer[better])
            if j % 8 == 7 or j == m - 1:
                open_ = sig.reshape(n, m).max(1) > j + 1
                go = open_[owner]
                if not go.any():
                    break
                if go.mean() < 0.7:
                    owner, inv = owner[go], inv[go]
                    used, inv = np.unique(inv, return_inverse=True)
                    base, perm, rows = base[used], perm[used], np.arange(len(used))
    return sig.reshape(n, m)


def bands(sig: np.ndarray, rows: int, count: int) -> np.ndarray:
    """(n, count) int64 keys, each over `rows` consecutive values and its own number."""
    bits = np.ascontiguousarray(sig[:, : rows * count]).view(np.uint64).reshape(len(sig), count, rows)
    key = np.broadcast_to(np.arange(1, count + 1, dtype=np.uint64) * _C1, bits.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for i in range(rows):
            key = mix(key ^ bits[:, :, i]) + _C1
    return key.view(np.int64)


def sketch(sig: np.ndarray, bits: int) -> np.ndarray:
    """(n, bits/64) uint64 words with one random bit of each of the first `bits` values; two sets of similarity s agree in (1+s)/2 of them."""
    one = (mix(np.ascontiguousarray(sig[:, :bits]).view(np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(one, axis=1, bitorder="little").view(np.uint64)


def flat_lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Values (uint64) and offsets of an Arrow list<int64> array."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].view(np.uint64), offsets - offsets[0]
