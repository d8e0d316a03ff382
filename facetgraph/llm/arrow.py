"""Texts of Arrow batches as numpy arrays: bytes, code points, words, rolling codes.

Kernels work on runs of rows of bounded size, so a task holds one batch and a few arrays over one
run; a single long text is a run of its own.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ODD = np.uint64(0x9E3779B97F4A7C15)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column end to end, and where each row begins; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, pa.scalar(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "", column.type))
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    if off is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    starts = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[starts[0] : starts[-1]], starts - starts[0]


def runs(starts: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, one row at least."""
    i, n = 0, len(starts) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def text_runs(batch: pa.RecordBatch, text: str, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, starts within them) for each run of a batch."""
    data, starts = utf8(batch.column(batch.schema.get_field_index(text)))
    for i, j in runs(starts, limit):
        yield i, j, data[starts[i] : starts[j]], starts[i : j + 1] - starts[i]


def code_points(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of valid UTF-8 and where each row begins among them."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(points) == len(data):
        return points, starts
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    return points, heads[starts]


@functools.cache
def categories() -> np.ndarray:
    """For each code point: 0 white space, 1 letter, 2 number, 3 anything else."""
    out = np.full(0x110000, 3, np.uint8)
    for i in range(0x110000):
        c = unicodedata.category(chr(i))[0]
        if c == "L":
            out[i] = 1
        elif c == "N":
            out[i] = 2
    for i in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        out[i] = 0
    return out


@functools.cache
def lower_points() -> np.ndarray:
    """Simple lower-case form of each code point."""
    out = np.arange(0x110000, dtype=np.uint32)
    for i in np.flatnonzero(categories() == 1):
        c = chr(i).lower()
        if len(c) == 1:
            out[i] = ord(c)
    return out


def row_of(starts: np.ndarray) -> np.ndarray:
    """Row number of each element."""
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts))


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64; one table, made longer when a run needs it."""
    if len(_powers[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        for k, base in enumerate((0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64))):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _powers[k] = np.multiply.accumulate(factors)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads low bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of values[begin:end] for each span, alike wherever the span stands."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    part = values.astype(np.uint64)
    part += np.uint64(1)
    part *= up[: len(values)]
    np.cumsum(part, out=total[1:])
    return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))
