"""The pipeline's stages, one after another, each against a plain statement of what it decides."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from test_jaccard import brute
from test_secrets import base
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomwork.llm import common, mixing, packing


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_duplicates", "secret_scan", "mixing", "packing"]

    known = common.table(stages["language_id"](spark, docs, sf_dir), "known")
    assert known.columns == docs.columns
    with_letters = docs.filter("text rlike '[a-zA-Z]'").count()
    assert 0.99 * with_letters <= known.count() <= with_letters
    assert known.exceptAll(docs).count() == 0

    single = common.table(stages["near_duplicates"](spark, known, sf_dir), "single")
    want = {d for d, _, c in brute([(r.doc_id, r.text) for r in known.collect()]) if d == c}
    assert sorted(r.doc_id for r in single.collect()) == sorted(want)

    clean = common.table(stages["secret_scan"](spark, single, sf_dir), "clean")
    before, after = {r.doc_id: r for r in single.collect()}, {r.doc_id: r for r in clean.collect()}
    assert before.keys() == after.keys()
    changed = [d for d in before if before[d].text != after[d].text]
    assert all("[SECRET]" in after[d].text and after[d].n_chars == len(after[d].text) for d in changed)
    assert {d for d in before if base(before[d].text)} <= set(changed)
    assert len(changed) < 0.5 * len(before)

    mixed = common.table(stages["mixing"](spark, clean, sf_dir), "mixed")
    copies = {r.doc_id: r["__copies"] for r in mixing.mix(clean).collect()}
    assert Counter(r.doc_id for r in mixed.collect()) == copies

    packed = stages["packing"](spark, mixed, sf_dir).collect()
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    tokens = {d: len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for d, r in after.items()}
    assert sum(p.length for p in packed) == sum(tokens[d] * n for d, n in copies.items())


def test_clashing_columns(spark, cases, clashing, tmp_path):
    """Columns with the names that operators use within: each stage decides as without them, and leaves their values alone."""
    more = clashing.select("*", *(F.lit("mine").alias(c) for c in ("lang_rejected", "bits_per_letter", "c0", "a.b", "__row0", "times", "text_")))
    extra = [c for c in more.columns if c not in cases.columns]
    plain, wide = cases, more
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, wide = (common.table(stage(spark, df, str(tmp_path)), name) for df in (plain, wide))
        assert wide.columns == more.columns
        own = wide.select(*(f"`{c}`" for c in cases.columns))
        assert Counter(tuple(r) for r in own.collect()) == Counter(tuple(r) for r in plain.collect())
        assert all(set(r) <= {"clash", "mine"} for r in wide.select(*(f"`{c}`" for c in extra)).distinct().collect())


def test_cases(spark, cases, empty, tmp_path):
    for df in (cases, empty):
        docs = df
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = common.table(stage(spark, docs, str(tmp_path)), name)
            assert docs.columns == df.columns
        corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count()
