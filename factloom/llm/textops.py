"""Byte-level numpy helpers that treat a whole Arrow string column at once.

Every helper works on a flat byte array plus document offsets, so one numpy call covers
many documents. ``chunks`` keeps the working set to a few MB whatever the batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and its offsets (length + 1); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        wide = np.int64
    else:
        wide = np.int32
    _, off, data = column.buffers()
    if len(column) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(off, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Document ranges of about ``limit`` bytes each; a longer document is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n, lo + 16384)
        yield lo, hi
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads 64-bit values."""
    x = x ^ (x >> U64(31))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(29)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses, ``n`` at least."""
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for i, step in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, step, U64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=U64)
    return _powers[0], _powers[1]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash; ``span_hash`` reads the hash of any span from it."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans [start, end): equal bytes, equal hash, wherever they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start])


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document index of the words ``[^\\x20\\x09-\\x0D]+``."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    ink = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = ink.copy()
    starts[1:] &= ~ink[:-1] | cut[1:-1]
    ends = ink.copy()
    ends[:-1] &= ~ink[1:] | cut[1:-1]
    s = np.flatnonzero(starts)
    return s, np.flatnonzero(ends) + 1, np.searchsorted(offsets, s, "right") - 1


def lower_ascii(data: np.ndarray) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())
