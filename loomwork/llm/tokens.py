"""Edit-aware token counts: a segment tree of pre-token counts for each document, in which an edit re-encodes only what it touches."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import arrays, common
from loomwork.llm.packing import cache_of, default_tokenizer

CACHE_WORDS = 400_000
#: Rows whose trees are unpacked at a time.
ROWS = 100
#: What an edit makes of the leaves that it touches becomes one leaf up to this many characters, else a leaf for each word.
LEAF_CHARS = 2048
WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
#: Words with the white space after them, and before the first.
PIECES = re.compile(r"(?:\A[\x20\x09-\x0D]*)?[^\x20\x09-\x0D]+[\x20\x09-\x0D]*").findall
MARKS = re.compile(r"([a-z])([.,;:!?])")
SPECIAL = re.compile(r"<\|(startoftext|endoftext)\|>", re.IGNORECASE)

_counts: dict[str, dict[str, int]] = {}


def word_counter(path: str):
    """A function from words to their numbers of tokens, with one bounded cache for each tokenizer and Python worker."""
    cache, known = cache_of(path), _counts.setdefault(path, {})

    def count(words: list[str]) -> list[int]:
        if len(known) > CACHE_WORDS:
            known.clear()
        for w in set(words).difference(known):
            if SPECIAL.search(w):
                known[w] = len(cache.tokenizer.encode(w, add_special_tokens=False).ids)
            else:
                low = "".join(c.lower() if c.isascii() else c for c in w) if not w.isascii() else w.lower()
                known[w] = sum(len(cache.word(p)) for p in MARKS.sub(r"\1 \2", low).split(" "))
        return [known[w] for w in words]

    return count


def grow(leaves: np.ndarray) -> np.ndarray:
    """The heap of sums over leaves, padded to a power of two: node i's children are 2i and 2i + 1, node 1 is the total."""
    size = 1 << max(0, int(len(leaves) - 1).bit_length())
    heap = np.zeros(2 * size, np.int32)
    heap[size : size + len(leaves)] = leaves
    while size > 1:
        half = size // 2
        heap[half:size] = heap[size : 2 * size : 2] + heap[size + 1 : 2 * size : 2]
        size = half
    return heap


class Tree:
    """Two heaps with the same leaves, the pre-tokens of a text: their characters (with the white space after each) and tokens."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.chars, self.tokens, self.size = chars, tokens, len(chars) // 2

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf with the character at `place`, and where that leaf begins."""
        node, before = 1, 0
        while node < self.size:
            left = int(self.chars[2 * node])
            node, before, place = (2 * node, before, place) if place < left else (2 * node + 1, before + left, place - left)
        return node - self.size, before

    def put(self, first: int, last: int, chars: int, tokens: int) -> None:
        """Let leaf `first` stand for the leaves up to `last`, and renew the sums above them."""
        for heap, value in ((self.chars, chars), (self.tokens, tokens)):
            lo, hi = first + self.size, last + self.size
            heap[lo : hi + 1] = 0
            heap[lo] = value
            while lo > 1:
                lo, hi = lo // 2, hi // 2
                heap[lo : hi + 1] = heap[2 * lo : 2 * hi + 2 : 2] + heap[2 * lo + 1 : 2 * hi + 2 : 2]


    def split(self, first: int, last: int, chars: list[int], tokens: list[int]) -> Tree:
        """The tree with leaves of their own instead of the leaves from `first` to `last`; the other leaves keep their sums, and
        leaves without characters go."""
        own = np.concatenate([self.chars[self.size : self.size + first], chars, self.chars[self.size + last + 1 :]])
        counts = np.concatenate([self.tokens[self.size : self.size + first], tokens, self.tokens[self.size + last + 1 :]])
        return Tree(grow(own[own > 0]), grow(counts[own > 0]))


def plant(texts: pa.Array, count) -> list[Tree]:
    """The trees of the texts."""
    words, offsets = arrays.split_words(texts)
    index, distinct = arrays.encoded(words)
    tokens = np.array(count(distinct.to_pylist()), np.int32)[index] if len(distinct) else np.zeros(0, np.int32)
    data, at = arrays.text_bytes(texts)
    lead = (data & 0xC0) != 0x80
    place = np.concatenate([[0], np.cumsum(lead)])  # code points before each byte
    space = (data == 0x20) | ((data >= 9) & (data <= 13))
    begins = ~space
    begins[1:] &= space[:-1]
    begins[at[:-1][at[:-1] < len(data)]] = ~space[at[:-1][at[:-1] < len(data)]]
    starts = place[np.flatnonzero(begins)]
    out = []
    for i in range(len(texts)):
        s, e = offsets[i], offsets[i + 1]
        edges = np.concatenate([[place[at[i]]], starts[s + 1 : e], [place[at[i + 1]]]])
        out.append(Tree(grow(np.diff(edges)), grow(tokens[s:e] if e > s else np.zeros(1, np.int32))))
    return out


def build(df: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text, n_tokens and the trees (chars_tree, tokens_tree: binary heaps of 32-bit sums) of every row. Null texts count as
    empty; null keys and repeated rows stay; other columns are dropped."""
    common.need(df, key, text)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = word_counter(tokenizer_path)
        for batch in batches:
            for part in arrays.slices(batch, "text", 1 << 20):
                texts = arrays.plain(part.column("text"))
                trees = plant(texts, count)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), texts, pa.array([int(t.tokens[1]) for t in trees], pa.int64()), pa.array([t.chars.tobytes() for t in trees], pa.binary()), pa.array([t.tokens.tobytes() for t in trees], pa.binary())],
                    names=["key", "text", "n_tokens", "chars_tree", "tokens_tree"],
                )

    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(each, f"key {rows.schema['key'].dataType.simpleString()}, text string, n_tokens long, chars_tree binary, tokens_tree binary").withColumnRenamed("key", key)


def edit(tree: Tree, text: str, edits: list[dict], count) -> tuple[Tree, str, int]:
    """The tree and text after the edits, and how many words were encoded again.

    An edit drops `drop` characters at `at` and puts `put` there; places beyond the text's ends mean its ends. The leaf of the
    character before and that of the character after are encoded with it, as their words may join. No other word is encoded: a long
    insertion gets leaves of its own among the others'."""
    again = 0
    for e in edits:
        at = min(max(e["at"] or 0, 0), len(text))
        after = min(at + max(e["drop"] or 0, 0), len(text))
        first, lo = tree.leaf_at(max(at - 1, 0)) if text else (0, 0)
        last, hi = tree.leaf_at(min(after, len(text) - 1)) if text else (0, 0)
        hi += int(tree.chars[last + tree.size])
        region = text[lo:at] + (e["put"] or "") + text[after:hi]
        words = WORDS(region)
        again += len(words)
        if len(region) > LEAF_CHARS and len(words) > 1:
            tree = tree.split(first, last, [len(x) for x in PIECES(region)], count(words))
        else:
            tree.put(first, last, len(region), sum(count(words)))
        text = text[:lo] + region + text[hi:]
    return tree, text, again


def apply_edits(trees: DataFrame, tokenizer_path: str, key: str = "doc_id", edits: str = "edits") -> DataFrame:
    """The rows of build() after the edits in column `edits`: array of (at, drop, put) in the order in which they are made, each in
    places of the text that the edits before it left. Adds tokens_before, n_edits and words_encoded; a null array means no edits, a
    null place or number 0, a null `put` nothing. Null keys and repeated rows stay; columns that build() doesn't give are dropped."""
    common.need(trees, key, edits, "text", "chars_tree", "tokens_tree")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = word_counter(tokenizer_path)
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            out: list[list] = [[] for _ in range(7)]
            for text, chars, tokens, log in zip(*(batch.column(c).to_pylist() for c in ("text", "chars_tree", "tokens_tree", "edits")), strict=True):
                tree = Tree(np.frombuffer(chars, np.int32).copy(), np.frombuffer(tokens, np.int32).copy())
                before = int(tree.tokens[1])
                tree, text, again = edit(tree, text, log or [], count)
                for column, value in zip(out, (text, int(tree.tokens[1]), tree.chars.tobytes(), tree.tokens.tobytes(), before, len(log or []), again), strict=True):
                    column.append(value)
            types = (pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key"), *map(pa.array, out, types)], names=["key", "text", "n_tokens", "chars_tree", "tokens_tree", "tokens_before", "n_edits", "words_encoded"])

    rows = trees.select(F.col(key).alias("key"), "text", "chars_tree", "tokens_tree", F.col(edits).alias("edits"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(each, f"key {kind}, text string, n_tokens long, chars_tree binary, tokens_tree binary, tokens_before long, n_edits long, words_encoded long").withColumnRenamed("key", key)


def with_log(trees: DataFrame, log: DataFrame, key: str = "doc_id") -> DataFrame:
    """Add the edits of a log (key, seq, at, drop, put) to the trees, in the order of seq; equal ones by place, number and text.

    Edits of unknown or null keys are ignored, repeated rows of the log are made each; every row of a repeated key gets all edits of
    the key. The trees' other columns stay, but for one named `edits`; further columns of the log are dropped."""
    own = log.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "at", "drop", "put"))), lambda e: F.struct(e["at"].cast("long").alias("at"), e["drop"].cast("long").alias("drop"), e["put"].alias("put"))).alias("edits"))
    return trees.drop("edits").join(own, key, "left")


def revision(key: Column, text: Column) -> Column:
    """The edits of a revision: a note in front, a cut of 40 characters, and 12 characters replaced by a date, at places that the key's CRC gives."""
    size = F.char_length(text) + 1
    place = lambda salt: F.pmod(F.crc32(F.concat_ws(":", F.lit(salt), key)), size).cast("long")
    one = lambda at, drop, put: F.struct(at.cast("long").alias("at"), F.lit(drop).cast("long").alias("drop"), F.lit(put).alias("put"))
    return F.array(one(F.lit(0), 0, "Revised edition. "), one(place("cut"), 40, ""), one(place("date"), 12, "on 2024-05-01"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is counted, revised, and counted again from its tree."""
    trees = build(common.documents(spark, sf_dir), default_tokenizer())
    revised = apply_edits(trees.withColumn("edits", revision(F.col("doc_id"), F.col("text"))), default_tokenizer())
    return revised.select("doc_id", "tokens_before", F.col("n_tokens").alias("tokens_after"), "n_edits", "words_encoded", F.char_length("text").cast("long").alias("chars_after"), common.text_crc32(F.col("text")).alias("text_after_crc32"))


QUERIES = {"op3_token_counts": op3_token_counts}
ORACLES: dict[str, str] = {}
