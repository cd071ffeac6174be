"""Vectorised words and word hashes of a batch of texts (used inside tasks).

A batch is one byte buffer with row offsets, as Arrow hands it over. Words are
runs of bytes other than ASCII white space; every word gets a 64-bit
polynomial hash of its bytes with A-Z lower-cased, computed for all words of
the batch at once from a running sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one vectorised step takes (a longer text is a step of its own).
STEP_BYTES = 2 << 20

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection that spreads every input bit over the output."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    return mix((np.arange(1, n + 1, dtype=U) + U(seed << 32)) * U(0x9E3779B97F4A7C15))


_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = stream(1, 256)
_BYTE[65:91] = _BYTE[97:123]
_BASE = 0x9E6C63D0876A9A47
_powers = [np.ones(1, U), np.ones(1, U)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n`` of each."""
    if len(_powers[0]) < n:
        for i, g in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            step = np.full(n, g, U)
            step[0] = 1
            _powers[i] = np.multiply.accumulate(step)
    return _powers[0], _powers[1]


def powers(n: int) -> np.ndarray:
    """At least ``n`` powers of the hash's base."""
    return _tables(n)[0]


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column (null: empty)."""
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = col.buffers()[2] if len(col) else None
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def steps(batch: pa.RecordBatch, text: str, step: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch of about ``step`` bytes of text each."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(size) // step
    edge = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edge, edge[1:]):
        if b > a:
            yield batch.slice(a, b - a)


@dataclass
class Words:
    """Words of a batch in text order; ``first[d]:first[d + 1]`` are those of row d."""

    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray
    hash: np.ndarray


def span_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans ``start:end``, A-Z lower-cased."""
    n = len(raw)
    power, inverse = _tables(n + 1)
    total = np.zeros(n + 1, U)
    np.cumsum(_BYTE[raw] * power[:n], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(U))


def split(raw: np.ndarray, off: np.ndarray, gaps: np.ndarray = _GAP) -> Words:
    """Words of rows ``off`` of a byte buffer; ``gaps`` marks the bytes that part them."""
    n, rows = len(raw), len(off) - 1
    gap = gaps[raw]
    before = np.ones(n, bool)
    before[1:] = gap[:-1]
    before[off[:-1][off[:-1] < n]] = True
    after = np.ones(n, bool)
    after[:-1] = gap[1:]
    after[off[1:][off[1:] > 0] - 1] = True
    start, end = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
    row = np.searchsorted(off, start, "right") - 1
    first = np.zeros(rows + 1, np.int64)
    np.cumsum(np.bincount(row, minlength=rows), out=first[1:])
    return Words(raw, start, end, row, first, span_hash(raw, start, end))


def word_bytes(w: Words, which: np.ndarray) -> list[bytes]:
    """Bytes of some words, A-Z lower-cased."""
    low = w.raw.tobytes().lower()
    return [low[a:b] for a, b in zip(w.start[which].tolist(), w.end[which].tolist())]


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row's ``size``-word shingles, and row offsets.

    A row with fewer words has its whole sequence as one; a row without words none.
    """
    rows = len(w.first) - 1
    count = np.diff(w.first)
    factor = U(0x2545F4914F6CDD1D)
    x = w.hash.copy()
    full = len(x) - size + 1
    if full > 0:
        x = x[:full]
        for k in range(1, size):
            x = mix(x * factor + w.hash[k:full + k])
        inside = np.arange(full) + size <= w.first[w.row[:full] + 1]
        x, at = x[inside], w.row[:full][inside]
    else:
        x, at = x[:0], w.row[:0]
    few = np.flatnonzero((count > 0) & (count < size))
    y = np.zeros(len(few), U)
    for k in range(size - 1):
        more = count[few] > k
        y[more] = mix(y[more] * factor + w.hash[w.first[few[more]] + k] + U(k + 1))
    x, at = np.concatenate([x, y]), np.concatenate([at, few])
    order = np.lexsort((x, at))
    x, at = x[order], at[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (at[1:] != at[:-1])
    x, at = x[new], at[new]
    off = np.zeros(rows + 1, np.int64)
    np.cumsum(np.bincount(at, minlength=rows), out=off[1:])
    return x, off
