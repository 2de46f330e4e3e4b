"""Vectorised word and line hashing over the UTF-8 bytes of Arrow batches.

Words are runs of bytes outside 0x20 and 0x09-0x0D. Hashes are 64-bit: random polynomial over random byte
values, then a finaliser, so that two different words agree with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one vectorised step handles; a longer single text is still handled whole.
STEP_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
MULTIPLIERS = _rng.integers(1, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_P, _P_INV)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def steps(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, row offsets within them), about STEP_BYTES at a time."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + STEP_BYTES, "right")) - 1)
        end = min(end, n)
        yield at, end, data[off[at] : off[end]], off[at : end + 1] - off[at]
        at = end


class Hasher:
    """Hashes of any segments [start, end) of one buffer."""

    def __init__(self, data: np.ndarray):
        p, self.inv = _power(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUE[data] * p[: len(data)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inv[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of all words; no word spans two rows."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def row_bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """Where the items of each row begin, for items sorted by row; n + 1 values."""
    return np.searchsorted(rows, np.arange(n + 1))


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row, words folded A-Z to a-z; fewer words than `size` give one shingle."""
    data = LOWER[data]
    starts, ends, rows = words(data, off)
    h = Hasher(data)(starts, ends)
    n, bounds = len(off) - 1, row_bounds(rows, len(off) - 1)
    full = np.zeros(0, np.uint64)
    if len(h) >= size:
        m = len(h) - size + 1
        full = np.full(m, np.uint64(size))
        for k in range(size):
            full += h[k : k + m] * MULTIPLIERS[k]
        full = mix(full)
    out = []
    for r in range(n):
        a, b = bounds[r], bounds[r + 1]
        if b - a >= size:
            out.append(np.unique(full[a : b - size + 1]))
        elif b > a:
            one = np.uint64(b - a) + (h[a:b] * MULTIPLIERS[: b - a]).sum(dtype=np.uint64)
            out.append(mix(np.array([one], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
