"""Vectorised text helpers for Arrow batches: words, lines, byte counts and 64-bit hashes, without a Python loop over rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 4 << 20
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xFF51AFD7ED558CCD)
_M2 = np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _S33)
    x = x * _M1
    x = x ^ (x >> _S33)
    x = x * _M2
    return x ^ (x >> _S33)


def plain(column: pa.Array) -> pa.Array:
    """As a string array in one piece, null as empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.string()), "")


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about max_bytes of text (at least one row each), so that memory doesn't follow the batch's size. What Arrow
    freed meanwhile goes back to the system after each run, as a Python worker lives on beyond its task."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start, base = 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
        yield batch.slice(start, stop - start)
        pa.default_memory_pool().release_unused()
        start, base = stop, int(ends[stop - 1])


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Runs of characters other than space, \\t, \\n, \\v, \\f, \\r: the words of all rows in one array, and where each row's begin (one more offset than rows)."""
    lists = pc.ascii_split_whitespace(texts)
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0] if len(offsets) else 0
    full = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return flat.filter(full), before[offsets]


def encoded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each word as an index of the distinct words, and those."""
    d = words.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False), d.dictionary


def hash_strings(distinct: pa.Array) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, distinct.to_pylist()), dtype=np.uint64, count=len(distinct))


def row_of(offsets: np.ndarray) -> np.ndarray:
    """The row that each element belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def grams(hashes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every n consecutive words within a row, and the offsets of each row's."""
    counts = np.maximum(np.diff(offsets) - (n - 1), 0)
    out = np.concatenate([[0], np.cumsum(counts)])
    first = np.arange(out[-1]) + np.repeat(offsets[:-1] - out[:-1], counts)
    h = np.zeros(out[-1], dtype=np.uint64)
    for i in range(n):
        h = h * _M1 + hashes[first + i] + _GOLD
    return mix(h), out


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of each row's values, exact for integers."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows, and the offsets of each row's."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]
