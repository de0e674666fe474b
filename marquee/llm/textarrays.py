"""Words and shingles of many texts at once, as numpy arrays over Arrow's text buffers.

A batch of texts is walked in slices of about a megabyte, so memory depends on the longest text and
not on the batch. Hashes are 64 bits wide and the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) | U64(1)
_FACTORS = np.random.default_rng(7).integers(1, 1 << 63, 64, dtype=np.int64).astype(U64) | U64(1)
_powers: dict[str, np.ndarray] = {}

#: ASCII white space separates words; A to Z are folded.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit; works on a copy."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def _power(name: str, base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i < n at least."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE + 1), base, U64)
        have[0] = 1
        _powers[name] = have = np.multiply.accumulate(have)
        if n > 8 * SLICE:  # of one very long text; not kept
            del _powers[name]
    return have


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers, at least, of an odd number and of its inverse modulo 2 ** 64."""
    return _power("up", _BASE, n), _power("down", _INVERSE, n)


def slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets of the rows in these bytes); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("")
    n = len(column)
    if not n:
        return
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, wide, n + 1, column.offset * np.dtype(wide).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
        yield first, last, raw[at[first]:at[last]], at[first:last + 1] - at[first]
        first = last


def spans(breaks: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first span of each row) of the runs without a break; a run ends with its row."""
    n = len(breaks)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~breaks
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= breaks[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= breaks[1:] | edge[1:n]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span's bytes, by differences of one prefix sum."""
    n = len(data)
    total = np.zeros(n + 1, U64)
    np.cumsum(_BYTES[data] * _power("up", _BASE, n + 1)[:n], out=total[1:])
    return mix64((total[ends] - total[starts]) * _power("down", _INVERSE, n + 1)[starts] + (ends - starts).astype(U64))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each row). Words: runs without ASCII white space, A-Z folded."""
    starts, ends, first = spans(WHITE[data], offsets)
    return span_hashes(FOLD[data], starts, ends), first


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; those over a row's border are to be left out by the caller."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = words[:n] * _FACTORS[0]
    for i in range(1, k):
        total += words[i:i + n] * _FACTORS[i]
    return mix64(total)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> Iterator[np.ndarray]:
    """For each row its sorted set of k-word shingles; with fewer words the whole sequence is one; no word, none."""
    words, first = word_hashes(data, offsets)
    grams = gram_hashes(words, k)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(grams[a:b - k + 1])
        elif b > a:
            yield gram_hashes(words[a:b], b - a) + U64(b - a)
        else:
            yield grams[:0]
