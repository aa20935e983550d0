"""Quality rules: counts within a document, and lines that many documents of a host share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import arrays, common

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A line is boilerplate if more documents of its host have it than this.
LINE_LIMIT = 20
#: A document is depleted if fewer words than MIN_WORDS, or less than this share of its words, are left without boilerplate.
MIN_LEFT_PERCENT = 30

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def split_lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The \\n-split lines of all rows that hold a word, and the offsets of each row's."""
    lists = pc.split_pattern(texts, "\n")
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    data, at = arrays.text_bytes(flat)
    full = arrays.row_sums(~_SPACE[data], at) > 0
    before = np.concatenate([[0], np.cumsum(full)])
    return flat.filter(pa.array(full)), before[offsets - (offsets[0] if len(offsets) else 0)]


def repeats(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value whether its row has it before, and whether its row has it twice or more."""
    order = np.lexsort((values, rows))
    same = np.zeros(len(values), bool)
    same[1:] = (values[order][1:] == values[order][:-1]) & (rows[order][1:] == rows[order][:-1])
    twice = same.copy()
    twice[:-1] |= same[1:]
    earlier, often = np.empty(len(values), bool), np.empty(len(values), bool)
    earlier[order], often[order] = same, twice  # lexsort is stable: the first of equals comes first
    return earlier, often


def counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each row."""
    data, at = arrays.text_bytes(texts)
    words, offsets = arrays.split_words(texts)
    index, distinct = arrays.encoded(words)
    grams, grams_at = arrays.grams(arrays.hash_strings(distinct)[index], offsets, WINDOW)
    rows = arrays.row_of(grams_at)
    _, often = repeats(grams, rows)
    first = (np.arange(len(grams)) - grams_at[rows] + offsets[rows])[often]
    covered = np.zeros(len(words) + 1, np.int32)
    np.add.at(covered, first, 1)
    np.add.at(covered, first + WINDOW, -1)
    lines, lines_at = split_lines(texts)
    earlier, _ = repeats(arrays.encoded(lines)[0], arrays.row_of(lines_at))
    return {
        "n_words": np.diff(offsets),
        "word_chars": arrays.row_sums(((data & 0xC0) != 0x80) & ~_SPACE[data], at),
        "n_symbols": arrays.row_sums(_SYMBOL[data], at),
        "n_dup_lines": arrays.row_sums(earlier, lines_at),
        "n_repeat_words": arrays.row_sums(np.cumsum(covered[:-1]) > 0, offsets),
    }


def normalised_lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each row's lines (lower case, digits as 0, white space squeezed, no edges), with their numbers of words and the offsets of each row's."""
    lines, offsets = split_lines(texts)
    index, distinct = arrays.encoded(lines)
    plain = pc.ascii_trim_whitespace(pc.replace_substring_regex(pc.replace_substring_regex(pc.utf8_lower(distinct), r"[\t-\r ]+", " "), "[0-9]", "0"))
    _, at = arrays.split_words(distinct)
    return arrays.hash_strings(plain)[index].view(np.int64), np.diff(at)[index].astype(np.int32), offsets


def measure(df: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """key, host, the five counts, and arrays of the distinct lines' hashes and of the words on all of each line's copies."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrays.slices(batch, "text"):
                texts = arrays.plain(part.column("text"))
                found = counts(texts)
                lines, words, at = normalised_lines(texts)
                rows = arrays.row_of(at)
                order = np.lexsort((lines, rows))
                lines, words, rows = lines[order], words[order], rows[order]
                new = np.ones(len(lines), bool)
                new[1:] = (lines[1:] != lines[:-1]) | (rows[1:] != rows[:-1])
                starts = np.flatnonzero(new)
                sums = np.add.reduceat(words, starts).astype(np.int32) if len(starts) else np.zeros(0, np.int32)
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(rows[new], minlength=len(texts)))]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("host"), *map(pa.array, found.values()), pa.ListArray.from_arrays(ends, pa.array(lines[new])), pa.ListArray.from_arrays(ends, pa.array(sums))],
                    names=["key", "host", *found, "lines", "line_words"],
                )

    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(each, f"key {kind}, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<long>, line_words array<int>")


def shared_lines(lines: DataFrame, line_limit: int) -> DataFrame:
    """host, line and rows of the lines that more than line_limit documents of a host have. lines: (row, key, host, line), a line once a row."""
    document = F.struct("key", F.when(F.col("key").isNull(), F.col("row")).alias("row"))
    each = lines.groupBy("host", "line", document.alias("document")).agg(F.count(F.lit(1)).alias("rows"))
    return each.groupBy("host", "line").agg(F.count(F.lit(1)).alias("docs"), F.sum("rows").alias("rows")).filter(F.col("docs") > line_limit).drop("docs")


def judge(df: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", line_limit: int = LINE_LIMIT, min_left_percent: int = MIN_LEFT_PERCENT) -> DataFrame:
    """key, the counts, base_failed, n_boilerplate_words and kept of every row.

    base_failed: fewer than 10 words, or over 20 of 100 words in repeated 5-word windows. A line counts once for a document, and its
    documents are counted for each host; lines that more than line_limit of them have are removed. A document that thereby has fewer
    than 10 words left, or less than min_left_percent of its words, is depleted and not kept. Null texts have no words and fail; null
    hosts are one host, the empty name; rows with one key are one document there, however many they are, and those with a null key a
    document each; every row is judged. Other columns are dropped. Texts are read once; line hashes are shuffled by line and
    document and then pre-aggregated by line, so neither a large host nor a common line makes a large task.
    """
    common.need(df, key, text, host)
    rows = common.table(measure(df, key, text, host).withColumn("row", F.monotonically_increasing_id()), "measured")
    lines = rows.select("row", "key", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("l")).select("row", "key", "host", F.col("l.lines").alias("line"), F.col("l.line_words").alias("words"))
    common_lines = shared_lines(lines, line_limit)
    lines = lines.drop("key")
    total = rows.agg(F.sum(F.size("lines"))).first()[0] or 0
    hit = common.join_counted(lines, common_lines, ["host", "line"], "rows", total, "inner")
    lost = hit.groupBy("row").agg(F.sum("words").cast("long").alias("n_boilerplate_words"))
    out = rows.drop("lines", "line_words", "host").join(lost, "row", "left").withColumn("n_boilerplate_words", F.coalesce("n_boilerplate_words", F.lit(0)).cast("long"))
    left = F.col("n_words") - F.col("n_boilerplate_words")
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    depleted = (F.col("n_boilerplate_words") > 0) & ((left < MIN_WORDS) | (100 * left < min_left_percent * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted).drop("row").withColumnRenamed("key", key)


def clean(df: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", line_limit: int = LINE_LIMIT) -> DataFrame:
    """The rows without the lines that more than line_limit documents of their host have; the other lines and their order stay.

    A row all of whose lines go has an empty text; null stays null; repeated rows and other columns stay. Common lines are found as
    in judge() and joined as one array for each row, on a running row number."""
    names = list(df.columns)
    mark = next(n for i in range(len(names) + 1) if (n := f"__row{i}") not in names)
    numbered = common.table(df.withColumn(mark, F.monotonically_increasing_id()), "numbered")
    keyed = numbered.withColumn(key, F.struct(F.col(key).alias("key"), F.col(mark).alias("row")))
    measured = measure(keyed, key, text, host).select(F.col("key.row").alias("row"), F.col("key.key").alias("key"), "host", F.explode("lines").alias("line"))
    total = numbered.count()
    hit = common.join_counted(measured.drop("key"), shared_lines(measured, line_limit), ["host", "line"], "rows", total, "inner").groupBy(F.col("row").alias(mark)).agg(F.collect_set("line").alias("__lines"))
    joined = numbered.join(hit, mark, "left").drop(mark)
    place = names.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, gone = batch.column(place).to_pylist(), batch.column(len(names)).to_pylist()
            for i, bad in enumerate(gone):
                if bad and texts[i] is not None:
                    pieces = pa.array(texts[i].split("\n"), pa.string())
                    hashes, _, at = normalised_lines(pieces)
                    drop = [bool(e > s and int(hashes[s]) in set(bad)) for s, e in zip(at[:-1], at[1:], strict=True)]
                    texts[i] = "\n".join(p for p, d in zip(pieces.to_pylist(), drop, strict=True) if not d)
            columns = list(batch.columns[: len(names)])
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(cut, df.schema)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.documents(spark, sf_dir))


QUERIES = {"op8_quality_rules": op8_quality_rules}
ORACLES: dict[str, str] = {}
