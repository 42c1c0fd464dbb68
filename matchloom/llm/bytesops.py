"""Numpy kernels over the UTF-8 bytes of whole Arrow string columns (run inside Spark tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE, STEP = U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95)
#: Texts are handled in slices of about so many bytes; a longer text is a slice of its own.
SLICE_BYTES = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def salt(k: int, step: np.uint64 = BASE) -> np.uint64:
    """k-th multiple of a step, wrapped."""
    return U(k * int(step) & 0xFFFFFFFFFFFFFFFF)


def row_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes and the n + 1 offsets of the rows; a null row is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes each."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    out = np.full(n + 1, base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


INVERSE = U(pow(int(BASE), -1, 1 << 64))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span: prefix sums of a polynomial, shifted back to power zero."""
    total = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * powers(len(data))[: len(data)], out=total[1:])
    back = powers(len(data), INVERSE)
    value = (total[ends] - total[starts]) * back[starts]
    return mix(value + (ends - starts).astype(U) * STEP)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``inside`` that don't cross rows, and the n + 1 run offsets of the rows."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) if len(inside) else inside
    after = np.concatenate((inside[1:], [False])) if len(inside) else inside
    starts = np.flatnonzero(inside & (edge[:-1] | ~before))
    ends = np.flatnonzero(inside & (edge[1:] | ~after)) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` in order (A-Z lower-cased) and the word offsets of the rows."""
    white = (data == 32) | ((data >= 9) & (data <= 13))
    starts, ends, rows = spans(~white, offsets)
    return span_hashes(lower_ascii(data), starts, ends), rows


def shingles(word: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word shingles of each row, sorted inside the row, and their row offsets.

    A row of fewer words has its whole sequence as one shingle, a row without words none.
    """
    count = np.diff(rows)
    made = np.where(count >= size, count - size + 1, (count > 0).astype(count.dtype))
    ends = np.concatenate(([0], np.cumsum(made)))
    row = np.repeat(np.arange(len(count)), made)
    at = rows[:-1][row] + (np.arange(ends[-1]) - ends[:-1][row])
    length = np.minimum(count, size)[row]
    value = length.astype(U) * BASE
    for k in range(size):
        there = k < length
        value[there] = value[there] * STEP + mix(word[at[there] + k])
    value = mix(value)
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        value[a:b].sort()
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[new], np.concatenate(([0], np.cumsum(np.bincount(row[new], minlength=len(count)))))
