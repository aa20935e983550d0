"""Packing against the tokenizer itself, and pieces put together again."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from loomwork.llm import packing

TOKENIZER = Tokenizer.from_file(packing.default_tokenizer())


def check(df) -> None:
    want = defaultdict(list)
    for r in df.select("doc_id", "text").collect():
        want[r.doc_id].append([*TOKENIZER.encode(r.text or "", add_special_tokens=False).ids, 2])
    pieces = packing.pack(df, packing.default_tokenizer()).collect()
    by = defaultdict(list)
    for p in pieces:
        assert p.length == len(p.ids) and p.length & (p.length - 1) == 0 and p.length <= 4096 and p.offset == 0
        by[p.doc_id].append(p)
    assert by.keys() == want.keys()
    assert len({p.sequence_id for p in pieces}) == len(pieces)
    for doc, texts in want.items():
        cut = sorted(by[doc], key=lambda p: p.start)
        assert all(p.doc_tokens == len(texts[0]) for p in cut)
        whole = defaultdict(list)
        for p in cut:
            whole[p.start].append(p.ids)
        assert all(len(x) == len(texts) and all(y == x[0] for y in x) for x in whole.values())  # repeated rows are packed each
        assert [i for s in sorted(whole) for i in whole[s][0]] == texts[0]


def test_cases(cases, clashing, empty):
    check(cases)
    check(clashing)
    assert packing.pack(empty, packing.default_tokenizer()).count() == 0


def test_words_that_the_cache_shortens(spark):
    texts = ["Hello, World! DON'T stop-it now.", "naïve Éclair ÉCLAIR ŒUVRE ǅ İstanbul ẞ", "a.b.c,d;e:f!g?h", "x<|endoftext|>y <|ENDOFTEXT|> Z", "12.5% of £3,000 … — “quoted”", "tab\tnew\nline\x0bvt\x0cff\rcr", " nbsp em ​zero", "ﬁ ligature K ﬃ", "中文 字符 日本語テキスト", "é combining ä", "''s 're 'LL it's"]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(docs)
    for r in packing.op10_packing(spark, sf_dir).filter("start = 0").limit(50).collect():  # the digest of some
        text = docs.filter(f"doc_id = {r.doc_id}").first().text
        ids = [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2][: r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        break


def test_cuts():
    for n in [*range(1, 70), 4095, 4096, 4097, 12345]:
        x = packing.cuts(n, 4096)
        assert sum(x) == n and all(y & (y - 1) == 0 for y in x) and x == sorted(x, reverse=True)
