"""Simple-8b word-aligned coding of unsigned integers.

A 64-bit word holds a 4-bit selector (its top bits) and up to 60 bits of payload.
Selector s < 14 packs COUNTS[s] values of WIDTHS[s] bits, first value in the
lowest bits.  A value of 60 bits or more is escaped: a word with selector 15
announces that the next word is the value as it is.  A stream is decoded alone
once its count of values is known, so blocks keep a word offset and a count for
each document.
"""

from __future__ import annotations

import numpy as np

#: values per word and bits per value, by selector
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], dtype=np.int64)
WIDTHS = 60 // COUNTS
ESCAPE = 15
#: values that a word takes in, by selector (14 is not in use)
_STEP = np.array([*COUNTS, 1, 1], dtype=np.uint8)
_SHIFT = np.uint64(60)


#: bits of each value below 2**16
_BITS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)


def _best(values: np.ndarray) -> np.ndarray:
    """For each position the selector of the fullest word that can start there (ESCAPE if none)."""
    n = len(values)
    top = int(values.max()) if n else 0
    if top < 1 << 16:
        bits = _BITS[values]
    elif top < 2**52:
        bits = np.frexp(values.astype(np.float64))[1].astype(np.uint8)  # exact below 2**53
    else:
        bits = np.array([int(v).bit_length() for v in values.tolist()], dtype=np.uint8)
    best = np.full(n, ESCAPE, dtype=np.int8)
    best[bits <= 60] = 13
    widest, have = bits, 1  # the most bits of the ``have`` values from each position on
    for s in range(12, -1, -1):
        count, width = int(COUNTS[s]), int(WIDTHS[s])
        if count > n:
            break
        while have < count:
            step = min(have, count - have)
            widest = np.maximum(widest[: n - have - step + 1], widest[step:])
            have += step
        fits = widest <= width
        if not fits.any():
            break
        best[: n - count + 1][fits] = s
    return best


def encode(values: np.ndarray) -> np.ndarray:
    """Words for ``values`` (unsigned 64-bit); greedy, each word as full as its first values allow."""
    return encode_streams(values, np.array([0, len(values)]))[0]


def encode_streams(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of the streams ``values[bounds[i]:bounds[i+1]]`` one after another, and each one's first word.

    A stream starts with a word of its own.  A word may take in fewer values than
    its selector holds at a stream's end: the rest is zero and the count tells.
    """
    values = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(values)
    best = _best(values)
    step = _STEP[best].tobytes()
    starts, first = [], []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        first.append((len(starts), lo))
        i = lo
        while i < hi:
            starts.append(i)
            i += step[i]
    at = np.array(starts, dtype=np.int64)
    chosen = best[at] if len(at) else np.empty(0, np.int8)
    heavy = chosen == ESCAPE
    place = np.arange(len(at)) + np.concatenate(([0], np.cumsum(heavy)[:-1])) if len(at) else at
    words = len(at) + int(heavy.sum())
    out = np.zeros(words, dtype=np.uint64)
    ends = np.repeat(bounds[1:], np.diff([x[0] for x in first] + [len(starts)])) if first else at
    padded = np.concatenate((values, np.zeros(60, np.uint64)))
    for s in range(14):
        mine = np.flatnonzero(chosen == s)
        if not len(mine):
            continue
        over = at[mine] + int(COUNTS[s]) > ends[mine]
        for some, last in ((mine[~over], False), (mine[over], True)):
            word = np.full(len(some), np.uint64(s) << _SHIFT, dtype=np.uint64)
            for k in range(int(COUNTS[s]) if len(some) else 0):
                pos = at[some] + k
                held = np.where(pos < ends[some], padded[pos], np.uint64(0)) if last else padded[pos]
                word |= held << np.uint64(k * int(WIDTHS[s]))
            out[place[some]] = word
    if heavy.any():
        out[place[heavy]] = np.uint64(ESCAPE) << _SHIFT
        out[place[heavy] + 1] = values[at[heavy]]
    where = np.concatenate((place, [words])) if len(at) else np.array([0])
    offsets = np.array([where[x[0]] for x in first] + [words], dtype=np.int64)
    return out, offsets


def decode_streams(words: np.ndarray, offsets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All values of the streams; stream i starts at word offsets[i] and has counts[i] values.

    Vectorised: words of equal selector are unpacked together, each into its place.
    """
    words = np.asarray(words, dtype=np.uint64)
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.uint64)
    selector = (words >> _SHIFT).astype(np.int64)
    raw = np.zeros(len(words), dtype=bool)
    if (selector == ESCAPE).any():  # a raw word can look like anything: walk from the front
        i, n = 0, len(words)
        while i < n:
            if selector[i] == ESCAPE:
                raw[i + 1] = True
                i += 1
            i += 1
    held = np.where(raw, 1, np.where(selector == ESCAPE, 0, COUNTS[np.minimum(selector, 13)]))
    cum = np.concatenate(([0], np.cumsum(held)))
    base = np.concatenate(([0], np.cumsum(counts)[:-1]))
    shift = np.repeat(base - cum[offsets[:-1]], np.diff(offsets))
    limit = np.repeat(base + counts, np.diff(offsets))
    to = cum[:-1] + shift
    out = np.empty(total, dtype=np.uint64)
    for s in range(14):
        mine = np.flatnonzero((selector == s) & ~raw)
        if not len(mine):
            continue
        width = int(WIDTHS[s])
        mask = np.uint64((1 << width) - 1)
        word, pos, last = words[mine], to[mine], limit[mine]
        for k in range(int(COUNTS[s])):
            inside = pos + k < last
            if inside.all():
                out[pos + k] = (word >> np.uint64(k * width)) & mask
            else:
                out[(pos + k)[inside]] = (word[inside] >> np.uint64(k * width)) & mask
    if raw.any():
        out[to[raw]] = words[raw]
    return out
