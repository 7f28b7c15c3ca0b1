"""Hashed word shingles of whole texts, vectorised within a text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .common import WordTable, words_of

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value over all bits."""
    x = (x ^ (x >> _S33)) * _M1
    x = (x ^ (x >> _S33)) * _M2
    return x ^ (x >> _S33)


#: 64-bit hash of a word's bytes, remembered per worker process.
_HASHES = WordTable(lambda words: [np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in words), dtype=np.uint64, count=len(words))], 300_000, "shingles")


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` values, in order."""
    n = len(hashes) - size + 1
    total = np.full(max(n, 0), np.uint64(size), dtype=np.uint64)
    for k in range(size if n > 0 else 0):
        total += hashes[k : k + n] * _ODD[k % len(_ODD)] + np.uint64(k // len(_ODD))
    return mix(total)


def shingle_sets(texts: pa.Array, size: int = 5):
    """For each text its sorted distinct shingles, with A-Z lower-cased.

    Fewer words than ``size`` make one shingle of the whole sequence; without words
    or text the set is empty.
    """
    words, bounds = words_of(pc.ascii_lower(texts))
    hashes = _HASHES.values(words)[0]
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        mine = hashes[lo:hi]
        if 0 < len(mine) < size:
            yield np.array([xxhash.xxh3_64_intdigest(mine.tobytes())], dtype=np.uint64)
        else:
            yield np.unique(windows(mine, size)) if len(mine) else mine


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    return next(shingle_sets(pa.array([text], pa.string()), size))
