"""Packing: every document is cut into power-of-two lengths, so that sequences need no padding and never cross documents."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import arrays, common

MAX_LENGTH = 4096
END_ID = 2
CACHE_WORDS = 800_000
ROWS_A_BATCH = 2000


LATIN_LETTERS = re.compile("[a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
#: How byte-level vocabularies spell the UTF-8 bytes of those letters: bytes without a visible character of their own come after U+0100, in order.
BYTE_LETTERS = {b: 0x100 + i for i, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}
SPECIAL = r"(?i)<\|(startoftext|endoftext)\|>"


class WordCache:
    """Token ids of distinct words, at most CACHE_WORDS of them.

    The tokenizer never joins text across ASCII white space, lower-cases, and always cuts between a letter and the mark after it;
    so the ids of a text are those of its lower-cased words in order, with the marks set apart. A word of Latin-1 letters alone is
    only lower-cased and spelled in bytes before merging, so the merge model takes it directly. Rows with a special token's string keep their
    case, as such strings are matched before lower-casing."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.starts, self.used = np.zeros(1 << 20, np.int32), np.zeros(1, np.int64), 0

    def word(self, word: str) -> list[int]:
        if LATIN_LETTERS(word):
            raw = word.lower()
            return [t.id for t in self.merge(raw if raw.isascii() else raw.encode().decode("latin-1").translate(BYTE_LETTERS))]
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids in one array, and the offsets of each row's."""
        lower = pc.if_else(pc.match_substring_regex(texts, SPECIAL), texts, pc.ascii_lower(texts))
        words, offsets = arrays.split_words(pc.replace_substring_regex(lower, r"([a-z])([.,;:!?])", r"\1 \2"))
        index, distinct = arrays.encoded(words)
        known = distinct.to_pylist()
        if len(self.place) + len(known) > CACHE_WORDS:
            self.clear()
        if fresh := [w for w in known if w not in self.place]:
            got = [self.word(w) for w in fresh]
            sizes = np.fromiter(map(len, got), np.int64, len(got))
            flat = np.fromiter(chain.from_iterable(got), np.int32, int(sizes.sum()))
            while self.used + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.int32)])
            self.ids[self.used : self.used + len(flat)] = flat
            self.starts = np.concatenate([self.starts, self.used + np.cumsum(sizes)])
            self.used += len(flat)
            self.place.update(zip(fresh, range(len(self.place), len(self.place) + len(fresh)), strict=True))
        at = np.fromiter(map(self.place.__getitem__, known), np.int64, len(known))[index]
        first, size = self.starts[at], self.starts[at + 1] - self.starts[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.arange(ends[-1]) + np.repeat(first - ends[:-1], size)]
        return ids, ends[offsets]


_caches: dict[str, WordCache] = {}


def cache_of(path: str) -> WordCache:
    """One cache for each tokenizer file and Python worker: the tokenizer stays, the words only for a task."""
    if path not in _caches:
        _caches[path] = WordCache(path)
    return _caches[path]


def cuts(length: int, largest: int) -> list[int]:
    """Piece lengths: as many of the largest as fit, then the binary digits of the rest from high to low."""
    rest = length % largest
    return [largest] * (length // largest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(df: DataFrame, tokenizer_path: str, text: str = "text", key: str = "doc_id", max_length: int = MAX_LENGTH, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document, each a sequence of its own of a power-of-two length.

    Returns key, start, length, ids (array<int>), doc_tokens, bucket (log2 of the length), sequence_id and offset (always 0).
    Sequences of one bucket have ids bucket << 56 | task << 32 | running number: unique, and in runs of equal length.
    A null text counts as empty: its only token is end_id. Repeated rows are packed once for each row, null keys stay; other columns are dropped.
    max_length must be a power of two. Nothing is shuffled: a document's pieces depend on that document alone.
    """
    common.need(df, text, key)
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    key_type = df.schema[key].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    key_arrow = to_arrow_type(key_type)
    fields = [("key", key_arrow), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.list_(pa.int32())), ("doc_tokens", pa.int64()), ("bucket", pa.int32()), ("sequence_id", pa.int64()), ("offset", pa.int64())]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, numbers = cache_of(tokenizer_path), np.zeros(max_length.bit_length(), np.int64)
        task = TaskContext.get().partitionId()
        for batch in batches:
            for part in arrays.slices(batch, "text", 1 << 20):
                ids, offsets = cache.encode(arrays.plain(part.column("text")))
                sizes = np.diff(offsets) + 1
                whole = np.full(int(sizes.sum()), end_id, np.int32)
                begins = np.concatenate([[0], np.cumsum(sizes)])
                whole[np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes - 1)] = ids
                lengths = [cuts(int(n), max_length) for n in sizes]
                row = np.repeat(np.arange(len(sizes)), [len(x) for x in lengths])
                length = np.array([y for x in lengths for y in x], np.int64)
                ends = np.concatenate([[0], np.cumsum(length)])
                bucket = np.log2(length).astype(np.int32)
                sequence = np.empty(len(length), np.int64)
                for b in np.unique(bucket):
                    own = np.flatnonzero(bucket == b)
                    sequence[own] = (int(b) << 56) + (task << 32) + numbers[b] + np.arange(len(own))
                    numbers[b] += len(own)
                keys = part.column("key").take(pa.array(row))
                columns = [keys, ends[:-1] - begins[row], length, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(whole)), sizes[row], bucket, sequence, np.zeros(len(row), np.int64)]
                out = pa.record_batch([pa.array(c, t) if isinstance(c, np.ndarray) else c for c, (_, t) in zip(columns, fields, strict=True)], schema=pa.schema(fields))
                yield from (out.slice(i, ROWS_A_BATCH) for i in range(0, out.num_rows, ROWS_A_BATCH))
        cache.clear()  # a worker doesn't take its words along to its next stage

    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = f"key {key_type.simpleString()}, start long, length long, ids array<int>, doc_tokens long, bucket int, sequence_id long, offset long"
    return rows.mapInArrow(pieces, schema).withColumnRenamed("key", key)


def ids_crc32(pieces: DataFrame) -> DataFrame:
    """Replace ids by the CRC-32 of the ids as little-endian unsigned 32-bit numbers."""
    kept = [c for c in pieces.columns if c != "ids"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            flat, at = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            raw, at = memoryview(flat.tobytes()), (at - at[0]) * 4
            crc = pa.array([zlib.crc32(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), crc], names=[*kept, "ids_crc32"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name != "ids")
    return pieces.mapInArrow(digest, f"{schema}, ids_crc32 long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(common.documents(spark, sf_dir), default_tokenizer())
    return ids_crc32(packed).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")


QUERIES = {"op10_packing": op10_packing}
ORACLES: dict[str, str] = {}
