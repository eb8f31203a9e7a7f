"""Words and word hashes of a whole Arrow batch of texts, without a Python step per word.

A word is a maximal run of bytes other than space and \\t \\n \\v \\f \\r; A-Z count as a-z.  Its hash is a polynomial over
random byte values modulo 2**64, read off one prefix sum of the batch, then mixed.  Word boundaries never cross rows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

from windrose.llm.common import GOLD, mix, salt

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * GOLD)
BYTE[65:91] = BYTE[97:123]
RAW_BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * GOLD)
BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 1 << 64)


class Words(NamedTuple):
    hash: np.ndarray     # uint64, all rows' words in order
    first: np.ndarray    # row r has words first[r] .. first[r + 1]
    start: np.ndarray    # byte positions in data
    end: np.ndarray
    data: np.ndarray     # the batch's bytes
    at: np.ndarray       # row r has bytes at[r] .. at[r + 1]


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, at least n of each."""
    size = max(1 << 20, 1 << (n - 1).bit_length()) if n else 1 << 20
    kept = _powers.get(0)
    if kept is None or len(kept[0]) < n:
        made = []
        for b in (BASE, INVERSE):
            p = np.full(size, np.uint64(b))
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        kept = made[0], made[1]
        if size <= 1 << 20:                 # longer tables are for one long text and not kept
            _powers[0] = kept
    return kept


def buffers(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null is empty."""
    text = text.fill_null("").cast(pa.large_string())
    off = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
    raw = text.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0]:off[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def bounds(data: np.ndarray, at: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """first, start, end of the runs of bytes that are not ``space``."""
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = ~space[data]
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | cut[1:]
    stops = np.zeros(n + 1, bool)
    stops[1:] = inside[:-1] & (~inside[1:] | cut[1:])
    start, end = np.flatnonzero(starts), np.flatnonzero(stops)
    return np.searchsorted(start, at), start, end


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray = BYTE) -> np.ndarray:
    """A hash of each data[start:end]."""
    power, inverse = powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * power[:len(data)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * GOLD)


def words_of(text: pa.Array) -> Words:
    data, at = buffers(text)
    first, start, end = bounds(data, at)
    h = span_hashes(data, start, end) if len(start) else np.zeros(0, np.uint64)
    return Words(h, first, start, end, data, at)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k words in a row, also across rows: entry i covers words i .. i + k - 1."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    m = len(h) - k + 1
    v = h[:m].copy()
    for j in range(1, k):
        v = v * np.uint64(BASE) + h[j:j + m]
    return mix(v + salt(k))
