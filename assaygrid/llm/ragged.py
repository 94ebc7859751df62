"""Words and other units of text as ragged numpy arrays over UTF-8 bytes.

Arrow string columns are used where they lie: a slice of rows is one byte array with row
offsets, units are (start, end) pairs into it, and equal units are found by a 64-bit
polynomial hash of random byte codes plus the unit's length and first bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, up to n."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, SLICE_BYTES + (1 << 17))
        _powers[:] = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers.append(np.cumprod(p, dtype=np.uint64))
    return _powers[0], _powers[1]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, row offsets) of about limit bytes each; a null is empty.

    A row longer than limit comes alone and whole.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def runs(kinds: np.ndarray, offsets: np.ndarray, alone: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of equal kind that cross no row border: starts, ends, kind. Bytes of kind alone are runs of one."""
    n = len(kinds)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), kinds
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(kinds[1:], kinds[:-1], out=change[1:])
    if alone is not None:
        change |= kinds == alone
    inner = offsets[:-1]
    change[inner[inner < n]] = True
    starts = np.flatnonzero(change)
    return starts, np.append(starts[1:], n), kinds[starts]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each unit that does not depend on where it lies."""
    n = len(data)
    power, inverse = _tables(n)
    before = np.zeros(n + 1, np.uint64)
    np.cumsum(_CODE[data] * power[:n], out=before[1:], dtype=np.uint64)
    return mixed((before[ends] - before[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the high bits of a hash over all of it."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def span_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of words, given the words' hashes."""
    n = len(words)
    power, inverse = _tables(n)
    before = np.zeros(n + 1, np.uint64)
    np.cumsum(words * power[:n], out=before[1:], dtype=np.uint64)
    return mixed((before[ends] - before[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def row_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row that each unit lies in."""
    return np.searchsorted(offsets, starts, "right") - 1


def expand(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Indices first[i], first[i] + 1, ... count[i] of them for each i, one after the other."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    keep = count > 0
    f, c = first[keep], count[keep]
    heads = np.cumsum(c) - c
    out[heads[0]] = f[0]
    out[heads[1:]] = f[1:] - (f[:-1] + c[:-1] - 1)
    return np.cumsum(out)
