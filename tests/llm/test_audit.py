"""The audit against its SQL and against filters applied one after another."""

from __future__ import annotations

import re
from collections import Counter
from itertools import permutations

import pytest
from compare import same
from pyspark.sql import functions as F

from loomwork.llm import audit, common

FIELDS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def failing(docs: list[tuple]) -> list[set[str]]:
    """The letters that each (id, text) fails."""
    first: dict[str, int] = {}
    for i, t in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    out = []
    for i, t in docs:
        t = t or ""
        w = re.findall(r"[^ \t\n\x0b\f\r]+", t)
        tests = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and i > first[t])
        out.append({c for c, x in zip("ABCDE", tests, strict=True) if x})
    return out


def plainly(docs: list[tuple], labels: list[tuple]) -> dict[tuple, tuple]:
    """docs: (id, text, part). Every order applied to every document, one filter after another."""
    good, toxic = ({i for i, *x in labels if x[k] == 1} for k in (0, 1))
    fails = failing([(i, t) for i, t, _ in docs])
    parts = {p or "" for *_, p in docs}
    count: Counter = Counter()
    orders = ["".join(o) for o in permutations("ABCDE")]
    for (i, _, p), bad in zip(docs, fails, strict=True):
        for o in orders:
            gone = False
            for k, f in enumerate(o):
                at = (p or "", o, k + 1)
                here = f in bad
                count[at, "redundant"] += gone and here
                count[at, "unique_fails"] += bad == {f}
                if here and not gone:
                    gone = True
                    count[at, "removed"] += 1
                    count[at, "good_lost"] += i in good
                    count[at, "toxic_lost"] += i in toxic
                    count[p or "", f] += 1
                count[at, "kept"] += not gone
    return {(p, o, k + 1): (*(count[(p, o, k + 1), f] for f in FIELDS[:-1]), count[p, o[k]]) for p in parts for o in orders for k in range(5)}


def of(df) -> dict[tuple, tuple]:
    rows = df.collect()
    out = {(r.part, r.filter_order, r.step): tuple(r[f] for f in FIELDS) for r in rows}
    assert len(out) == len(rows)
    return out


def test_documents(spark, sf_dir):
    same(audit.op12_filter_audit(spark, sf_dir), sf_dir, audit.ORACLES["op12_filter_audit"])


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 60, 3)] + [(45, None, 1), (46, 1, None), (46, 0, 0), (None, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_cases(spark, cases, clashing, empty, labels):
    more = [(60, "A B C", "en", None, 1), (61, "A B C", "en", "", 1), (None, "A B C", "en", "s1", 1), (62, " x " * 300, "en", "s1", 1), (63, "x $ y", None, "s2", 1), (64, "a \u2028", None, "s2", 1), (65, "\u0085 a a\u0085 \u2028\n", None, "s2", 1), (44, "é ß X", None, "s2", 1)]
    docs = cases.unionByName(spark.createDataFrame(more, cases.schema))
    want = plainly([(r.doc_id, r.text, r.source) for r in docs.collect()], [tuple(r) for r in labels.filter("doc_id is not null").collect()])
    assert of(audit.audit(docs, labels, audit.production_filters(), "E")) == want
    two = clashing.select("*", *(F.lit(1).alias(c) for c in ("mask", "digest", "part", "id", "good", "toxic", "quality", "times", "first", "applied", "next")))
    got = audit.audit(two, labels.withColumn("id", F.lit(1)), audit.production_filters(), "E")
    assert of(got) == of(audit.audit(cases, labels, audit.production_filters(), "E"))
    assert audit.audit(empty, labels, audit.production_filters(), "E").count() == 0
    none = of(audit.audit(cases, labels.filter("false"), audit.production_filters(), "E"))
    assert all(x[4] == x[5] == 0 for x in none.values())


def test_hot_text_and_key(spark, labels, monkeypatch):
    """A third of all rows are one text, another third one key."""
    monkeypatch.setattr(common, "FEW_ROWS", 10)
    rows = [(100 + i, "same text", f"p{i % 3}") for i in range(100)] + [(7, f"text {i}", "p1") for i in range(100)] + [(300 + i, f"Some Words {i % 40}", None) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = plainly(rows, [tuple(r) for r in labels.filter("doc_id is not null").collect()] + [(7, 1, 1)])
    more = labels.unionByName(spark.createDataFrame([(7, 1, 1)], labels.schema))
    assert of(audit.audit(df, more, audit.production_filters(), "E")) == want


def test_fewer_filters(spark, cases, labels):
    one = [f for f in audit.production_filters() if f.letter == "D"]
    got = audit.audit(cases, labels, one).collect()
    assert {(r.filter_order, r.step, r.filter) for r in got} == {("D", 1, "D")}
    assert sum(r.removed for r in got) == cases.filter(F.col("text").rlike("[#$%&*|]")).count()
    with pytest.raises(ValueError, match="letters"):
        audit.audit(cases, labels, one + one)
