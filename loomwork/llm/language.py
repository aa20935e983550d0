"""Language identification: interpolated Kneser-Ney character models, one per language, in sorted hash arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import arrays, common

ORDER = 4
#: Expected number of training documents of each language; a language with fewer gives all of its own.
SAMPLE = 600
#: The most common languages of the labels are learned, this many at most.
MAX_LANGUAGES = 256
#: One in this many documents of the sample isn't counted but calibrates the rejection; languages with fewer in the sample give none.
CALIBRATE = 4
#: Of a learned language's documents this share may be rejected.
FALSE_REJECTION = 1e-5
UNKNOWN = "und"
#: Longer words are cut into overlapping runs before their n-grams are counted, so that the work stays in proportion to the text.
SPAN = 256
#: Words whose scores a task keeps: this many words, together this many bytes, and this many scores, at most, beside those of one slice.
CACHE_WORDS = 200_000
CACHE_BYTES = 8 << 20
CACHE_CELLS = 2_000_000
#: Bytes of text that are judged at once, and code points of distinct words that are scored at once.
SLICE_BYTES = 1 << 20
BLOCK = 250_000
_PRIME = np.uint64(0x100000001B3)
_BOUNDARY = 32
_letters: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    """For every code point, whether it is a letter (category L); made once in each Python worker."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def chains(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of each text between boundaries, with every character that isn't a letter as a boundary."""
    codes = np.frombuffer("".join(f" {t} " for t in texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    return np.where(is_letter()[codes], codes, np.uint32(_BOUNDARY)), np.concatenate([[0], np.cumsum(sizes)])


def with_char(context: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return arrays.mix(context * np.uint64(0x9E3779B97F4A7C15) + codes)


@dataclass
class Level:
    """One order of a model: sorted hashes of context and character with log2 probabilities, and sorted hashes of contexts with log2 of the weight that they leave to the next lower order."""

    grams: np.ndarray
    log_p: np.ndarray
    contexts: np.ndarray
    log_left: np.ndarray


def look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of the wanted keys in a sorted array, and which are there."""
    if not len(keys):
        return np.zeros(len(wanted), values.dtype), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return values[at], keys[at] == wanted


def fit(grams: list[str], counts: np.ndarray, order: int, alphabet: int) -> list[Level]:
    """Levels 1 .. order from the counts of distinct order-grams. Lower orders count distinct characters to the left."""
    codes = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(grams), order).astype(np.uint64)
    counts = counts.astype(np.float64)
    tables = []
    for n in range(order, 0, -1):
        tables.append((codes, counts))
        _, first, inverse = np.unique(codes[:, 1:], axis=0, return_index=True, return_inverse=True)
        counts = np.bincount(inverse.ravel()).astype(np.float64)
        codes = codes[first][:, 1:]
    levels: list[Level] = []
    for n, (codes, counts) in enumerate(reversed(tables), 1):
        ones, twos = (counts == 1).sum(), (counts == 2).sum()
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        context = np.zeros(len(codes), np.uint64)
        for i in range(n - 2, -1, -1):  # nearest first, as score_words() does
            context = context * _PRIME + codes[:, i] + np.uint64(1)
        keys, inverse = np.unique(context, return_inverse=True)
        total, kinds = np.bincount(inverse, counts), np.bincount(inverse)
        left = discount * kinds / total
        lower = 2.0 ** score(levels, codes, n - 1, alphabet)
        p = np.maximum(counts - discount, 0) / total[inverse] + left[inverse] * lower
        gram = with_char(context, codes[:, -1])
        order_by = np.argsort(gram)
        levels.append(Level(gram[order_by], np.log2(p[order_by]).astype(np.float32), keys, np.log2(left).astype(np.float32)))
    return levels


def backed_off(levels: list[Level], contexts: list[np.ndarray], codes: np.ndarray, alphabet: int) -> np.ndarray:
    """log2 probability of each character after its context, from the highest order that has the n-gram."""
    out = np.zeros(len(codes), np.float64)
    left = np.arange(len(codes))
    for n in range(len(levels), 0, -1):
        level, context = levels[n - 1], contexts[n - 1][left]
        p, found = look_up(level.grams, level.log_p, with_char(context, codes[left]))
        out[left[found]] += p[found]
        left, context = left[~found], context[~found]
        weight, known = look_up(level.contexts, level.log_left, context)
        out[left[known]] += weight[known]
    out[left] -= np.log2(alphabet)
    return out


def score(levels: list[Level], codes: np.ndarray, n: int, alphabet: int) -> np.ndarray:
    """As backed_off(), of the last of each row of n + 1 or more characters, with n - 1 before it as context."""
    contexts, h = [np.zeros(len(codes), np.uint64)], np.zeros(len(codes), np.uint64)
    for i in range(1, n):
        h = h * _PRIME + codes[:, -1 - i] + np.uint64(1)
        contexts.append(h)
    return backed_off(levels[:n], contexts, codes[:, -1], alphabet)


@dataclass
class Model:
    languages: list[str]
    levels: list[list[Level]]
    order: int
    alphabet: int
    mean: np.ndarray
    spread: np.ndarray  # variance between documents and variance of a letter, by language
    limit: float = 0.0  # standard deviations above the mean beyond which a document is rejected


def score_words(model: Model, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each word under each language (words x languages), and its number of letters. Contexts don't reach over the boundary
    before a word: a word opens with order - 1 boundaries. BLOCK code points are scored at a time, whatever the length of a word."""
    codes, starts = chains(words)
    bits, letters = np.zeros((len(words), len(model.languages))), np.zeros(len(words), np.int64)
    at, end = 0, 0
    while len(words) and at < len(codes):
        last = int(np.searchsorted(starts, at + BLOCK, side="right")) - 1
        end = int(starts[last]) if starts[last] > at else min(at + BLOCK, len(codes))  # a word that is longer than a block is cut
        own = slice(int(np.searchsorted(starts, at, side="right")) - 1, int(np.searchsorted(starts, end, side="left")))
        begins = np.maximum(starts[own], at)
        inner = np.arange(at, end) - np.repeat(starts[own], np.diff(np.append(begins, end)))
        here = codes[at:end].astype(np.uint64)
        letter = here != _BOUNDARY
        after = np.concatenate([[at > 0 and codes[at - 1] != _BOUNDARY], letter[:-1]])
        scored = np.flatnonzero((inner > 0) & (letter | after))  # letters and the boundary after a letter
        contexts = [np.zeros(len(scored), np.uint64)]
        for n in range(1, model.order):
            near = np.where(inner[scored] >= n, codes[np.maximum(at + scored - n, 0)], _BOUNDARY).astype(np.uint64)
            contexts.append(contexts[-1] * _PRIME + near + np.uint64(1))
        for k, levels in enumerate(model.levels):
            each = np.zeros(end - at)
            each[scored] = -backed_off(levels, contexts, here[scored], model.alphabet)
            bits[own, k] += np.add.reduceat(each, begins - at)
        letters[own] += np.add.reduceat(letter.astype(np.int64), begins - at)
        at = end
    return bits, letters


class WordScores:
    """score_words() of distinct words, kept for one model and one task, so that a worker doesn't take them along to its next stage."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.bytes, self.bits, self.letters = 0, np.zeros((1024, len(self.model.languages))), np.zeros(1024, np.int64)

    def __call__(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        known = words.to_pylist()
        together = len(self.place) + len(known)
        if self.bytes > CACHE_BYTES or together > CACHE_WORDS or together * len(self.model.languages) > CACHE_CELLS:
            self.clear()
        if fresh := [w for w in known if w not in self.place]:
            start, end = len(self.place), len(self.place) + len(fresh)
            if end > len(self.letters):
                grown = max(end, 2 * len(self.letters))
                self.bits, self.letters = np.resize(self.bits, (grown, self.bits.shape[1])), np.resize(self.letters, grown)
            own = pa.array(fresh, pa.string())
            self.bits[start:end], self.letters[start:end] = score_words(self.model, own)
            self.place.update(zip(fresh, range(start, end), strict=True))
            self.bytes += own.nbytes
        at = np.fromiter(map(self.place.__getitem__, known), np.int64, len(known))
        return self.bits[at], self.letters[at]


def entropies(model: Model, texts: pa.Array, scores: WordScores | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bits per letter of each text under each language (rows x languages), and the number of letters. Distinct words are scored once."""
    words, offsets = arrays.split_words(pc.utf8_lower(texts))
    index, distinct = arrays.encoded(words)
    word_bits, letters = (scores or WordScores(model))(distinct)
    n_letters = arrays.row_sums(letters[index], offsets)
    bits = np.zeros((len(texts), len(model.languages)))
    for k in range(len(model.languages)):
        total = np.concatenate([[0.0], np.cumsum(word_bits[index, k])])
        bits[:, k] = total[offsets[1:]] - total[offsets[:-1]]
    return bits / np.maximum(n_letters, 1)[:, None], n_letters


def spans(words: pa.Array, counts: pa.Array, langs: pa.Array, order: int) -> pa.RecordBatch:
    """lang, span, n: the words between order - 1 spaces and one, those that are longer than SPAN in runs that share order - 1 characters."""
    padded = pc.binary_join_element_wise(" " * (order - 1), words, " ", "")
    long = pc.greater(pc.utf8_length(padded), SPAN)
    short = pc.invert(long)
    out = [langs.filter(short).to_pylist(), padded.filter(short).to_pylist(), counts.filter(short).to_pylist()]
    for lang, word, n in zip(langs.filter(long).to_pylist(), padded.filter(long).to_pylist(), counts.filter(long).to_pylist(), strict=True):
        runs = [word[i : i + SPAN] for i in range(0, len(word) - order + 1, SPAN - order + 1)]
        for column, value in zip(out, ([lang] * len(runs), runs, [n] * len(runs)), strict=True):
            column.extend(value)
    return pa.record_batch([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], names=["lang", "span", "n"])


def order_grams(df: DataFrame, order: int) -> DataFrame:
    """lang, gram, n: how often each order-gram occurs in the words of each language's texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrays.slices(batch, "text"):
                words, offsets = arrays.split_words(pc.utf8_lower(arrays.plain(part.column("text"))))
                langs = part.column("lang").take(pa.array(arrays.row_of(offsets)))
                seen = pa.table({"lang": langs, "word": words}).group_by(["lang", "word"]).aggregate([([], "count_all")]).combine_chunks()
                if seen.num_rows:
                    yield spans(*(seen.column(c).chunk(0) for c in ("word", "count_all", "lang")), order)

    found = df.select("lang", "text").mapInArrow(count, "lang string, span string, n long").groupBy("lang", "span").agg(F.sum("n").alias("n"))
    plain = F.regexp_replace("span", r"[^\p{L}]", " ")
    grams = found.select("lang", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("span") - order + 1), lambda i: F.substr(plain, i, F.lit(order)))).alias("gram"))
    return grams.filter(F.length(F.trim("gram")) > 0).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", order: int = ORDER, sample: int = SAMPLE) -> Model:
    """Fit a model of each language in `lang` (the MAX_LANGUAGES most common, at equal counts the names that sort first), on about
    `sample` documents of each language, and calibrate the rejection on a CALIBRATE-th of them, which isn't counted.

    The documents are those whose hash of `key` falls under sample / (number of that language's documents): a bounded sample that
    depends on keys alone. Rows with a null language, null text or null key take no part. Repeated rows count as often as they
    occur. The driver gets the finished arrays and the cross-entropies of the calibrating documents, whose sizes the sample bounds.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).filter("lang is not null and text is not null and key is not null")
    common_first = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES)
    sizes = {r["lang"]: r["n"] for r in common_first.collect()}
    if not sizes:
        return Model([], [], order, 2, np.zeros(0), np.zeros((0, 2)))
    share = F.create_map(*(F.lit(x) for l, n in sizes.items() for x in (l, min(1.0, sample / n))))
    spare = F.create_map(*(F.lit(x) for l, n in sizes.items() for x in (l, min(n, sample) >= 2 * CALIBRATE)))
    unit = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    apart = spare[F.col("lang")] & (F.pmod(F.xxhash64(F.lit("calibrate"), "key"), F.lit(CALIBRATE)) == 0)
    picked = common.table(rows.filter(unit < share[F.col("lang")]).select("lang", "text", apart.alias("apart")), "language_sample")
    grams = common.table(order_grams(picked.filter("not apart"), order), "language_grams")
    alphabet = grams.select(F.explode(F.split("gram", "")).alias("c")).agg(F.countDistinct("c")).first()[0] + 1

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("gram")
        levels = fit(group["gram"].tolist(), group["n"].to_numpy(), order, alphabet)
        return pd.DataFrame([{"lang": group["lang"].iloc[0], "n": n, "grams": x.grams.tobytes(), "log_p": x.log_p.tobytes(), "contexts": x.contexts.tobytes(), "log_left": x.log_left.tobytes()} for n, x in enumerate(levels)])

    levels: dict[str, list[Level]] = {}
    for r in sorted(grams.groupBy("lang").applyInPandas(build, "lang string, n int, grams binary, log_p binary, contexts binary, log_left binary").collect(), key=lambda r: (r["lang"], r["n"])):
        levels.setdefault(r["lang"], []).append(Level(np.frombuffer(r["grams"], np.uint64), np.frombuffer(r["log_p"], np.float32), np.frombuffer(r["contexts"], np.uint64), np.frombuffer(r["log_left"], np.float32)))
    names = sorted(levels)
    model = Model(names, [levels[x] for x in names], order, alphabet, np.zeros(len(names)), np.zeros((len(names), 2)))
    calibrate(model, picked.filter("apart") if not picked.filter("apart").isEmpty() else picked)
    return model


def calibrate(model: Model, apart: DataFrame, false_rejection: float = FALSE_REJECTION) -> None:
    """Mean cross-entropy of each language's own documents and its variance, by a document and by a letter, and the limit that
    false_rejection of such documents exceed: by an exponential tail beyond the last tenth of all languages' documents."""
    shared = apart.sparkSession.sparkContext.broadcast(model)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        scores = WordScores(known)
        for batch in batches:
            for part in arrays.slices(batch, "text", SLICE_BYTES):
                bits, n = entropies(known, arrays.plain(part.column("text")), scores)
                at = np.array([known.languages.index(x) if x in known.languages else -1 for x in part.column("lang").to_pylist()], np.int64)
                ok = (at >= 0) & (n > 0)
                yield pa.record_batch([pa.array(at[ok]), pa.array(bits[ok, at[ok]]), pa.array(n[ok])], names=["at", "h", "n"])

    found = apart.select("lang", "text").mapInArrow(own, "at long, h double, n long").collect()
    at, h, n = (np.array([r[i] for r in found]) for i in range(3)) if found else (np.zeros(0, int), np.zeros(0), np.zeros(0))
    every = np.arange(len(found))
    for k in range(len(model.languages)):
        mine = every[at == k] if (at == k).any() else every
        if len(mine):
            # all of the variance is laid to both causes: wide for short texts as for long ones
            var = max(float(h[mine].var(ddof=1)) if len(mine) > 1 else 0.0, 0.02)
            model.mean[k], model.spread[k] = np.average(h[mine], weights=n[mine]), (var, var / max((1 / n[mine]).mean(), 1e-6))
    z = np.sort((h - model.mean[at]) / np.sqrt(model.spread[at, 0] + model.spread[at, 1] / n)) if len(found) else np.zeros(1)
    last = z[len(z) - 1 - len(z) // 10 :]
    model.limit = float(max(last[-1], last[0] + (last - last[0]).mean() * np.log(0.1 / false_rejection)))
    shared.destroy()


def predict(df: DataFrame, model: Model, text: str = "text", limit: float | None = None) -> DataFrame:
    """Add lang_pred (lowest cross-entropy per letter), score, bits_per_letter and lang_rejected to every row.

    score is the softmax share of the winner over a letter's likelihoods, from 0 to 1. A text that is null or has no letter gets
    `und`, score 0 and null bits, and is rejected; so is one whose cross-entropy lies more than `limit` standard deviations (the
    model's, unless given) above what its language's documents have at that length. Equal cross-entropies go to the name that sorts first. Repeated rows and other
    columns stay; columns with those four names are replaced. Without any learned language every text is `und`. No shuffle.
    """
    common.need(df, text)
    added = ("lang_pred", "score", "bits_per_letter", "lang_rejected")
    rest = df.drop(*added)
    names = [*rest.columns, *added]
    place = names.index(text)
    shared, most = df.sparkSession.sparkContext.broadcast(model), model.limit if limit is None else limit

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        scores = WordScores(known)
        for batch in batches:
            for part in arrays.slices(batch.rename_columns([str(i) for i in range(batch.num_columns)]), str(place), SLICE_BYTES):
                rows = part.num_rows
                if known.languages:
                    bits, n = entropies(known, arrays.plain(part.column(place)), scores)
                    best = bits.argmin(axis=1)
                    low = bits[np.arange(rows), best]
                    share = 1 / np.exp2(np.maximum(low[:, None] - bits, -60)).sum(axis=1)
                    sd = np.sqrt(known.spread[best, 0] + known.spread[best, 1] / np.maximum(n, 1))
                    some, reject = n > 0, (n == 0) | (low > known.mean[best] + most * sd)
                else:
                    best, low, share, some, reject = np.zeros(rows, int), np.zeros(rows), np.zeros(rows), np.zeros(rows, bool), np.ones(rows, bool)
                pred = np.where(some, np.array([*known.languages, UNKNOWN], object)[best], UNKNOWN)
                more = [pa.array(pred, pa.string()), pa.array(np.where(some, share, 0.0)), pa.array(low, mask=~some), pa.array(reject)]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    return rest.mapInArrow(label, f"{schema}, lang_pred string, score double, bits_per_letter double, lang_rejected boolean")


def held_out(key):
    """Rows that no model learns from. A null key isn't held out (and train() leaves it out)."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_letter", "lang_rejected")


QUERIES = {"op2_language_id": op2_language_id}
ORACLES: dict[str, str] = {}
