"""Language models: proper distributions, held-out accuracy, and rejection."""

from __future__ import annotations

import math
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from loomwork.llm import language


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    out = language.op2_language_id(spark, sf_dir)
    assert out.count() == docs.count()
    rows = out.filter("held_out").join(docs.filter("lang is not null and text rlike '[a-zA-Z]'"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_rejected for r in rows) <= 0.01 * len(rows)


def test_grams_of_long_words(spark):
    """As many of each as in the whole word, however it is cut."""
    word = "".join("abcde"[(i * i + i // 7) % 5] for i in range(1500))
    rows = [("en", f"ab {word} ab"), ("en", "x'y"), ("fr", None)]
    want: dict[str, int] = {}
    for w in ("ab", word, "ab", "x y"):
        padded = "   " + w + " "
        for i in range(len(padded) - 3):
            if padded[i : i + 4].strip():
                want[padded[i : i + 4]] = want.get(padded[i : i + 4], 0) + 1
    got = {r.gram: r.n for r in language.order_grams(spark.createDataFrame(rows, "lang string, text string"), 4).collect()}
    assert got == want


def test_probabilities_sum_to_one():
    """Over the alphabet, after any context, seen or not; the alphabet counts one letter that was never seen."""
    texts = ["abab", "abba", "baba", "cab"]
    counts: dict[str, int] = {}
    for t in texts:
        for i in range(len(t) + 1):
            gram = ("   " + t + " ")[i : i + 4]
            counts[gram] = counts.get(gram, 0) + 1
    grams = sorted(counts)
    alphabet = " abcz"
    levels = language.fit(grams, np.array([counts[g] for g in grams]), 4, len(alphabet))
    for context in ("   ", "  a", "cab", "zzz", "bab"):
        codes = np.array([[ord(c) for c in context + x] for x in alphabet], np.uint64)
        assert abs((2.0 ** language.score(levels, codes, 4, len(alphabet))).sum() - 1) < 1e-6


def test_rejection(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.train(docs)
    odd = spark.createDataFrame([(1, "ѮѮѮ жжжж щщщщщ ъъъ ыыыы " * 20), (2, None), (3, "12345 ?!"), (4, "")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score, r.lang_rejected) for r in language.predict(odd, model).collect()}
    assert got[1][2] and got[2] == got[3] == got[4] == ("und", 0.0, True)
    assert language.predict(docs.filter("text rlike '[a-zA-Z]'"), model).filter("lang_rejected").count() <= 0.01 * docs.count()


def test_scores_by_blocks(spark, monkeypatch):
    """Words in blocks, and a word cut in many, score as in one block; memory doesn't follow the number or the length of words."""
    import pyarrow as pa

    rows = [(i, "kala mala kana lamak", "aa") for i in range(8)] + [(i + 10, "bibo bobi tibo obit", "bb") for i in range(8)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    words = pa.array(["kala", "b", "", "lamak'bibo" * 40, "1", "obit", "ka" * 17, "-", "x"] * 3)
    want = language.score_words(model, words)
    for block in (1, 2, 7, 30):
        monkeypatch.setattr(language, "BLOCK", block)
        got = language.score_words(model, words)
        assert np.allclose(got[0], want[0], rtol=1e-12) and (got[1] == want[1]).all()
    monkeypatch.undo()
    for texts in (["kalamab" * 300_000], [" ".join(f"w{'abcdefghij'[i % 10]}{chr(97 + i % 23) * 3}{chr(97 + i // 23 % 26)}{chr(97 + i // 598 % 26)}" for i in range(260_000))]):
        tracemalloc.start()
        language.entropies(model, pa.array(texts))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 200 << 20


def test_cases(cases, clashing, empty):
    for df in (cases, clashing, empty):
        out = language.predict(df, language.train(df))
        assert out.count() == df.count()
    model = language.train(cases)
    as_rows = lambda df: sorted((repr((r.doc_id, r.text, r.lang_pred, r.score, r.bits_per_letter, r.lang_rejected)) for r in df.collect()))
    assert as_rows(language.predict(clashing, language.train(clashing))) == as_rows(language.predict(cases, model))
    nothing = language.predict(cases, language.train(empty))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}


def plain_model(texts: list[str], order: int, alphabet: int):
    """log2 probability of a character after a context, by the definition of interpolated Kneser-Ney over dictionaries."""
    counts: list[dict[str, float]] = [{} for _ in range(order + 1)]
    for text in texts:
        for word in text.lower().split():
            padded = " " * (order - 1) + "".join(c if c.isalpha() else " " for c in word) + " "
            for i in range(len(padded) - order + 1):
                gram = padded[i : i + order]
                if gram.strip():
                    counts[order][gram] = counts[order].get(gram, 0) + 1
    for n in range(order - 1, 0, -1):
        for gram in counts[n + 1]:
            counts[n][gram[1:]] = counts[n].get(gram[1:], 0) + 1

    def p(n: int, gram: str) -> float:
        if not n:
            return 1 / alphabet
        own = {g: k for g, k in counts[n].items() if g[:-1] == gram[:-1]}
        lower = p(n - 1, gram[1:])
        if not own:
            return lower
        ones, twos = (sum(k == x for k in counts[n].values()) for x in (1, 2))
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        return (max(own.get(gram, 0) - discount, 0) + discount * len(own) * lower) / sum(own.values())

    return lambda gram: math.log2(p(order, gram))


def test_predictions_by_a_plain_scorer(spark):
    rows = [(i, t, lang) for lang, words in (("aa", "kala mala kana lamak nakal'k"), ("bb", "bibo bobi tibo obit Übib"), ("cc", "kalo bima lobi")) for i, t in enumerate([words] * 3 + [words[::-1]] * 2, 10 * ord(lang[0]))]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    letters = {c for _, t, _ in rows for c in t.lower() if c.isalpha()}
    assert model.languages == ["aa", "bb", "cc"] and model.alphabet == len(letters) + 2  # a boundary, and any other
    plain = {x: plain_model([t for _, t, lang in rows if lang == x], model.order, model.alphabet) for x in model.languages}
    asked = ["kala lobi", "Bibo-tibo, 12 obit!", "zzz kal", "a", "lamak\tnakal'k " * 50, "éü b"]
    got = language.predict(spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "doc_id long, text string"), model).collect()
    for r in got:
        bits = dict.fromkeys(model.languages, 0.0)
        for word in r.text.lower().split():
            padded = "   " + "".join(c if c.isalpha() else " " for c in word) + " "
            for i in range(3, len(padded)):
                if padded[i] != " " or padded[i - 1] != " ":
                    for x in bits:
                        bits[x] -= plain[x](padded[i - 3 : i + 1])
        best = min(bits, key=lambda x: (bits[x], x))
        assert r.lang_pred == best
        assert abs(r.bits_per_letter - bits[best] / sum(c.isalpha() for c in r.text)) < 1e-5


def test_most_common_languages_and_null_keys(spark, monkeypatch):
    monkeypatch.setattr(language, "MAX_LANGUAGES", 2)
    rows = [(i, "some words of text", f"l{i % 3}") for i in range(30)] + [(100, "more", "l1"), (101, "more", "l2"), (None, "more", "l0"), (None, "more", "l0"), (None, "more", "l0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language.train(df).languages == ["l1", "l2"]
    assert [r[0] for r in spark.createDataFrame([(None,)], "doc_id long").select(language.held_out(F.col("doc_id"))).collect()] == [False]
