"""Vectorised words and their fingerprints over the UTF-8 bytes of many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_VALUES = np.random.default_rng(20240517).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finalizer, so that all bits depend on all bits."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if not _powers or len(_powers[0]) < n:
        size = -(-n // (1 << 18)) << 18
        up, down = np.full(size, U(_BASE)), np.full(size, U(pow(_BASE, -1, 1 << 64)))
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up), np.cumprod(down)]
    return _powers[0], _powers[1]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """p with p[j] - p[i] = base**i times the polynomial hash of data[i:j]."""
    p = np.zeros(len(data) + 1, U)
    np.cumsum(_VALUES[data] * powers(len(data) + 1)[0][: len(data)], out=p[1:])
    return p


def span_hash(p: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((p[ends] - p[starts]) * powers(len(p))[1][starts])


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word [^\\x20\\x09-\\x0D]+, or of each run of bytes that are inside; none crosses rows."""
    inside = ~_SEP[data] if inside is None else inside
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit fingerprint of each lower-cased (A-Z) word, and n + 1 offsets of the rows in them."""
    data, offsets = buffers(column)
    starts, ends, row = word_spans(data, offsets)
    h = span_hash(prefix_sums(lowered(data)), starts, ends)
    return h, np.searchsorted(row, np.arange(len(offsets)))
