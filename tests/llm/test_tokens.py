"""Token counts after edits against counting the edited text anew."""

from __future__ import annotations

import random

from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomwork.llm import tokens
from loomwork.llm.packing import default_tokenizer

TOKENIZER = Tokenizer.from_file(default_tokenizer())


def size(text: str | None) -> int:
    return len(TOKENIZER.encode(text or "", add_special_tokens=False).ids)


def after(text: str, edits) -> str:
    for e in edits:
        at = min(max(e[0], 0), len(text))
        text = text[:at] + e[2] + text[min(at + max(e[1], 0), len(text)) :]
    return text


def test_random_edits(spark):
    rng = random.Random(11)
    pieces = ["", " ", "x", "Hello, ", "don't ", "\n\n", "中文", "é", "end.Start", "a" * 60, " 12.5% ", "<|endoftext|>"]
    rows = []
    for i in range(120):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(60)))
        edits = [(rng.randrange(-3, len(text) + 5), rng.randrange(0, 12), rng.choice(pieces)) for _ in range(rng.randrange(8))]
        rows.append((i, text, edits))
    df = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<at: long, drop: long, put: string>>")
    trees = tokens.build(df, default_tokenizer()).join(df.select("doc_id", "edits"), "doc_id")
    got = {r.doc_id: r for r in tokens.apply_edits(trees, default_tokenizer()).collect()}
    for i, text, edits in rows:
        want = after(text, edits)
        assert got[i].text == want
        assert (got[i].tokens_before, got[i].n_tokens) == (size(text), size(want)), (text, edits)


def test_little_is_encoded_again(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = tokens.op3_token_counts(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        assert r.tokens_before == size(docs[r.doc_id])
        assert r.words_encoded < 80 or r.words_encoded <= len(docs[r.doc_id].split())


def test_log_of_edits(spark):
    df = spark.createDataFrame([(1, "one two three"), (2, "four")], "doc_id long, text string")
    log = spark.createDataFrame([(1, 2, 0, 0, "zero "), (1, 1, 4, 3, "2"), (9, 1, 0, 1, "")], "doc_id long, seq int, at int, drop int, put string")
    got = {r.doc_id: (r.text, r.n_edits, r.n_tokens) for r in tokens.apply_edits(tokens.with_log(tokens.build(df, default_tokenizer()), log), default_tokenizer()).collect()}
    assert got == {1: ("zero one 2 three", 2, size("zero one 2 three")), 2: ("four", 0, size("four"))}


def test_cases(cases, clashing, empty):
    for df in (cases, clashing, empty):
        trees = tokens.build(df, default_tokenizer())
        out = tokens.apply_edits(trees.withColumn("edits", tokens.revision(F.col("doc_id"), F.col("text"))), default_tokenizer()).collect()
        assert len(out) == df.count()
        for r in out:
            assert r.n_tokens == size(r.text)


def test_long_insertions_and_long_words(spark):
    """Texts put in get leaves of their own; what stands before and after isn't encoded again, nor is a word that can't be split."""
    body, more = " ".join(f"word{i}" for i in range(3000)), " ".join(f"new{i}" for i in range(900))
    rows = [
        (1, body, [(9000, 3, more), (9500, 2, "x"), (0, 0, "Start "), (20000, 10, ""), (9100, 4000, " gone ")]),
        (2, "y" * 50_000 + " end", [(50_002, 1, "a"), (0, 0, "b ")]),
        (3, "", [(0, 0, more), (0, 3, "")]),
        (None, None, [(0, 5, " " * 3000), (1, 1, None)]),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<at: long, drop: long, put: string>>")
    trees = tokens.build(df, default_tokenizer())
    joined = trees.join(df.select(F.col("doc_id").alias("own"), "edits"), F.expr("doc_id <=> own"))
    got = {r.doc_id: r for r in tokens.apply_edits(joined, default_tokenizer()).collect()}
    for i, text, edits in rows:
        want = after(text or "", [(a, d, p or "") for a, d, p in edits])
        assert got[i].text == want and got[i].n_tokens == size(want)
    assert got[1].words_encoded < 900 + 40 and got[2].words_encoded < 6 and got[3].words_encoded < 903


def test_log_with_ties_and_repeated_keys(spark):
    df = spark.createDataFrame([(1, "one two"), (1, "three"), (None, "x")], "doc_id long, text string").withColumn("other", F.lit(0))
    log = spark.createDataFrame([(1, 1, 3, 0, "B"), (1, 1, 0, 0, "A"), (None, 1, 0, 1, "")], "doc_id long, seq int, at int, drop int, put string").withColumn("edits", F.lit(1))
    got = sorted((r.text, r.n_edits) for r in tokens.apply_edits(tokens.with_log(tokens.build(df, default_tokenizer()).withColumn("edits", F.lit(2)), log), default_tokenizer()).collect())
    assert got == [("AonB e two".replace(" e", "e"), 2), ("AthBree", 2), ("x", 0)]
