"""Hashes of words and shingles straight from Arrow text buffers, without Python strings.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and
return. Its hash is a polynomial over random 64-bit values of its bytes, read off prefix
sums, then mixed; A-Z can be folded. Texts are handled in pieces of a few megabytes, but
never split: a single longer text makes a larger piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 2_000_000
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _values(fold: bool) -> np.ndarray:
    v = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    if fold:
        v[ord("A") : ord("Z") + 1] = v[ord("a") : ord("z") + 1]
    return v


BYTE_VALUES = {fold: _values(fold) for fold in (False, True)}
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def _powers_to(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, PIECE_BYTES + 1)
        _powers[:] = [np.cumprod(np.where(np.arange(n) > 0, np.uint64(b), np.uint64(1))) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers


def words(data: np.ndarray, offsets: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of texts that lie end to end in data, and the number of words before each text."""
    hashes, begin = word_places(data, offsets, fold)
    return hashes, np.searchsorted(begin, offsets)


def word_places(data: np.ndarray, offsets: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and first bytes of texts that lie end to end in data."""
    n = len(data)
    if n == 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    gap = SPACES[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    first = ~gap
    last = first.copy()
    first[1:] &= gap[:-1] | edge[1:-1]
    last[:-1] &= gap[1:] | edge[1:-1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _powers_to(n)
    sums = np.empty(n + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(BYTE_VALUES[fold][data] * power[:n], out=sums[1:])
    return mix((sums[end] - sums[begin]) * inverse[begin]), begin


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of each run of size words of one text; of fewer words, one for the whole; of none, none."""
    n = len(hashes)
    if n == 0:
        return hashes
    size = min(size, n)
    out = np.full(n - size + 1, size, dtype=np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9FB21C651E98DF25) + hashes[k : n - size + 1 + k]
    return mix(out)


def text_pieces(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows with up to PIECE_BYTES of text; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE_BYTES, side="right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def text_words(column: pa.Array, fold: bool) -> Iterator[np.ndarray]:
    """The word hashes of each row's text, in order."""
    for _, _, data, offsets in text_pieces(column):
        hashes, begins = words(data, offsets, fold)
        for k in range(len(offsets) - 1):
            yield hashes[begins[k] : begins[k + 1]]


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from one numpy array a row."""
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
