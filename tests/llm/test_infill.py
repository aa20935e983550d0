"""The transformation against its SQL, a plain statement of it, and an exact round trip."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from compare import same
from pyspark.sql import functions as F

from loomwork.llm import infill

MARKS = (b"<P>", b"<S>", b"<M>")


def plainly(text: str, key: str, unit: str = "char") -> tuple:
    digest = hashlib.sha256(f"1:{key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    pieces = {"char": lambda: list(text), "word": lambda: re.findall(r"^[ \t\n\v\f\r]+[^ \t\n\v\f\r]*[ \t\n\v\f\r]*|[^ \t\n\v\f\r]+[ \t\n\v\f\r]*", text), "line": lambda: re.findall(r"[^\n]*\n|[^\n]+", text)}[unit]()
    assert "".join(pieces) == text
    n = len(pieces)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(pieces[:a]), "".join(pieces[a:b]), "".join(pieces[b:])
    spm = h[3] % 100 < 20
    return n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_documents(spark, sf_dir):
    same(infill.op11_infill(spark, sf_dir), sf_dir, infill.ORACLES["op11_infill"])


def test_select():
    rng = random.Random(1)
    for _ in range(300):
        width = rng.randrange(1, 200)
        bits = rng.getrandbits(width) & rng.getrandbits(width)
        at = [i for i in range(width) if bits >> i & 1]
        assert [infill.select(bits, k, width) for k in range(len(at) + 2)] == [*at, width, width]


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_units(spark, unit):
    rng = random.Random(2)
    alphabet = ["a", "b", "é", "中", "\U0001f600", " ", "  ", "\n", "\t", "́", "<", "P>", "<S", ">", "\x00", "\r\n", " ", "\x85"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 40))) for _ in range(600)] + ["", " ", "\n", "x", "é" * 100_000, "a\n" * 30_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    done = infill.transform(df, unit=unit).withColumn("back", infill.restore(F.col("fim_text"), F.col("form")))
    forms = set()
    for r in done.collect():
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.fim_text) == plainly(texts[r.doc_id], str(r.doc_id), unit)
        assert r.back == texts[r.doc_id] == r.text
        forms.add(r.form)
    assert forms == {"psm", "spm", "plain"}


def test_cases(spark, cases, clashing, empty):
    want = {(r.doc_id, r.text): plainly(r.text or "", "" if r.doc_id is None else str(r.doc_id)) for r in cases.collect()}
    null_key = spark.createDataFrame([(None, "some text here", None, None, None)], cases.schema)
    want[None, "some text here"] = plainly("some text here", "")
    got = infill.transform(cases.unionByName(null_key)).collect()
    assert len(got) == cases.count() + 1
    assert all(want[r.doc_id, r.text] == (r.n, r.form, r.prefix_chars, r.middle_chars, r.fim_text) for r in got)
    other = infill.transform(clashing.withColumn("form", F.lit("mine")).withColumn("bytes", F.lit("b")).withColumn("c0", F.lit(1)).withColumn("a.b", F.lit(2)))
    assert sorted((r.doc_id, r.fim_text) for r in other.collect()) == sorted((r.doc_id, r.fim_text) for r in got if r.doc_id is not None)
    assert set(clashing.columns) - {"n"} | {"bytes", "c0", "a.b", *infill.OUT} == set(other.columns)
    assert infill.transform(empty).count() == 0
    with pytest.raises(ValueError, match="overlap"):
        infill.transform(cases, marks=("aba", "<S>", "<M>"))


def test_broken_bytes():
    """Bytes that aren't UTF-8 are cut at what looks like the start of a code point, and nothing is lost."""
    for data in (b"\x80\x80abc", b"\xff\xfe", b"a\xc3"):
        n, form, _, _, out = infill.rearrange(data, (1, 2, 0, 99), MARKS)
        assert form == "psm" and sorted(out) == sorted(b"<P><S><M>" + data) and n == infill.starts(data, "char")[0].bit_count()
