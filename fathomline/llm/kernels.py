"""Numpy kernels over Arrow string columns: words, word hashes, shingle sets and MinHash signatures.

Everything works on the UTF-8 buffers of a record batch, a bounded number of bytes at a time, so no Python object is
made per word.  Words are maximal runs of bytes other than space and TAB..CR; only A-Z are lower-cased.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
SHINGLE = 5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_random = np.random.default_rng(20260101)
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64)
_PLACE = _random.integers(1, 2**63, SHINGLE + 1, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 2**64)
_pow = np.ones(1, dtype=np.uint64)
_unpow = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least n + 1 of each."""
    global _pow, _unpow
    if len(_pow) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        steps = np.full(size, _BASE, dtype=np.uint64)
        steps[0] = 1
        _pow = np.multiply.accumulate(steps)
        steps = np.full(size, _UNBASE, dtype=np.uint64)
        steps[0] = 1
        _unpow = np.multiply.accumulate(steps)
    return _pow, _unpow


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def release() -> None:
    """Gives freed memory back to the system, at a task's end."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def releasing(run):
    """A function of batches that calls release() when it is done."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def slices(texts: pa.Array, limit: int = SLICE_BYTES):
    """(first row, bytes, offsets) of consecutive rows; at most limit bytes each unless one row alone has more."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    power, unpower = _powers(len(data))
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * unpower[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and how many each row has."""
    solid = ~SPACE[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True  # a row's border splits words
    before = np.zeros(len(data), dtype=bool)
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | first[:-1]))
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | first[1:])) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's distinct shingles, sorted within the row, and the rows' borders in them.

    Five lower-cased words make a shingle; a row of one to four words has its whole sequence as its only one, and a row
    without words has none.
    """
    low = _LOWER[data]
    starts, ends, counts = words(data, offsets)
    h = span_hashes(low, starts, ends)
    rows = len(offsets) - 1
    row_of = np.repeat(np.arange(rows), counts)
    n = len(h)
    if n >= SHINGLE:
        full = np.flatnonzero(row_of[: n - SHINGLE + 1] == row_of[SHINGLE - 1 :])
        out = np.zeros(len(full), dtype=np.uint64)
        for i in range(SHINGLE):
            out += h[full + i] * _PLACE[i]
        out, owner = mix(out), row_of[full]
    else:
        out, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        border = np.concatenate([[0], np.cumsum(counts)])
        extra = np.array([_short(h[border[r] : border[r + 1]]) for r in short], dtype=np.uint64)
        out, owner = np.concatenate([out, extra]), np.concatenate([owner, short])
    order = np.lexsort((out, owner))
    out, owner = out[order], owner[order]
    if len(out):
        new = np.ones(len(out), dtype=bool)
        new[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
        out, owner = out[new], owner[new]
    return out, np.searchsorted(owner, np.arange(rows + 1))


def _short(h: np.ndarray) -> np.uint64:
    with np.errstate(over="ignore"):
        x = np.array([len(h)], dtype=np.uint64) * _PLACE[SHINGLE]
        for i, v in enumerate(h):
            x = x + v * _PLACE[i]
    return mix(x)[0]


def signature_parameters(k: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(k)
    return r.integers(1, 2**32, k, dtype=np.uint32) | np.uint32(1), r.integers(0, 2**32, k, dtype=np.uint32)


def signatures(hashes: np.ndarray, borders: np.ndarray, k: int) -> np.ndarray:
    """MinHash of each row's set: rows x k symbols of 16 bits.  Rows of empty sets come out as zeros."""
    rows = len(borders) - 1
    out = np.zeros((rows, k), dtype=np.uint16)
    full = np.flatnonzero(np.diff(borders) > 0)
    if not len(full):
        return out
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    a, b = signature_parameters(k)
    at = borders[full]
    for i in range(k):
        y = x * a[i]
        y += b[i]
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        low = np.minimum.reduceat(y, at)
        low ^= low >> np.uint32(16)
        low *= np.uint32(0x45D9F3B)
        out[full, i] = (low >> np.uint32(16)).astype(np.uint16)
    return out


def digests(hashes: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that depend on the set only."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes + np.uint64(0x51)), dtype=np.uint64)])
    other = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64)])
    return total[borders[1:]] - total[borders[:-1]], other[borders[1:]] - other[borders[:-1]]


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    r"""Each row cut at \n: starts and ends of the lines, the same without white space at both ends, lines in each row.

    Every row has at least one line; the \n belongs to none.
    """
    breaks = np.flatnonzero(data == 10)
    rows = len(offsets) - 1
    in_row = np.diff(np.searchsorted(breaks, offsets))
    counts = in_row + 1
    border = np.concatenate([[0], np.cumsum(counts)])
    starts = np.empty(border[-1], dtype=np.int64)
    first = np.zeros(border[-1], dtype=bool)
    first[border[:-1]] = True
    starts[first] = offsets[:-1]
    starts[~first] = breaks + 1
    ends = np.empty(border[-1], dtype=np.int64)
    last = np.zeros(border[-1], dtype=bool)
    last[border[1:] - 1] = True
    ends[last] = offsets[1:]
    ends[~last] = breaks
    assert rows == 0 or len(breaks) == in_row.sum()
    solid = np.flatnonzero(~SPACE[data])
    a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    blank = a == b
    if len(solid):
        inner_start = np.where(blank, starts, solid[np.minimum(a, len(solid) - 1)])
        inner_end = np.where(blank, starts, solid[np.maximum(b - 1, 0)] + 1)
    else:
        inner_start = inner_end = starts
    return starts, ends, inner_start, inner_end, counts


_OTHER = _random.integers(1, 2**63, 256, dtype=np.uint64)


def line_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """128 bits for the lower-cased bytes of each span, as two columns, and the span's code points."""
    low = _LOWER[data]
    one = span_hashes(low, starts, ends)
    power, unpower = _powers(len(low))
    total = np.zeros(len(low) + 1, dtype=np.uint64)
    np.cumsum(_OTHER[low] * power[: len(low)], out=total[1:])
    two = mix((total[ends] - total[starts]) * unpower[starts] ^ np.uint64(0x5DEECE66D))
    points = np.zeros(len(low) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    return one, two, points[ends] - points[starts]
