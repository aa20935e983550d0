"""The word model against definitions stated in plain Python, its sums, its files and its scores."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomwork import registry
from loomwork.operators import ngrams

LINES = ["a b c", "a b", "a b d", "b c", "c", "a a a a", "d b c", "a b c e f", "e f g", "e f g h", "a b c", "h g", "g g f", "b b", "f e", "c a", "h", "i", "j", "k l"]


def plainly(lines: list[str], order: int) -> tuple[dict, dict]:
    """p and back-off factor of every n-gram."""
    marked = [["<s>", *x.split(), "</s>"] for x in lines if x.split()]
    raw = {k: Counter(tuple(w[i : i + k]) for w in marked for i in range(len(w) - k + 1)) for k in range(1, order + 1)}
    adjusted = {order: dict(raw[order])}
    for k in range(order - 1, 0, -1):
        before = defaultdict(set)
        for g in raw[k + 1]:
            before[g[1:]].add(g[0])
        adjusted[k] = {g: raw[k][g] if g[0] == "<s>" else len(before[g]) for g in raw[k] if k > 1 or g != ("<s>",)}
    p, back = {}, {}
    size = len(adjusted[1]) + 1
    for k in range(1, order + 1):
        t = [sum(n == i for n in adjusted[k].values()) for i in range(1, 5)]
        d = ngrams.FALLBACK
        if all(t):
            y = t[0] / (t[0] + 2 * t[1])
            found = tuple(i - (i + 1) * y * t[i] / t[i - 1] for i in range(1, 4))
            d = found if all(0 <= x <= i for i, x in enumerate(found, 1)) else d
        totals, left = Counter(), Counter()
        for g, n in adjusted[k].items():
            totals[g[:-1]] += n
            left[g[:-1]] += d[min(n, 3) - 1]
        for c in totals:
            back[c] = left[c] / totals[c]
        for g, n in adjusted[k].items():
            p[g] = (n - d[min(n, 3) - 1]) / totals[g[:-1]] + back[g[:-1]] * (p[g[1:]] if k > 1 else 1 / size)
        if k == 1:
            p["<unk>",], p["<s>",] = back[()] / size, 1.0
    return p, back


def after(p: dict, back: dict, context: tuple, word: str) -> float:
    """The probability of a word after a context, by back-off."""
    if (*context, word) in p:
        return p[*context, word]
    return back.get(context, 1.0) * after(p, back, context[1:], word) if context else p["<unk>",]


def frame(spark, lines):
    return spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "id long, t string").withColumn("w", F.when(F.col("t") == "", F.array().cast("array<string>")).otherwise(F.split("t", " "))).repartition(3)


def table(model) -> tuple[dict, dict]:
    rows = model.collect()
    names = [c for c in model.columns if c.startswith("w")]
    words = lambda r: tuple(r[c] for c in names if r[c] is not None)
    assert all(len(words(r)) == r["order"] for r in rows) and len({words(r) for r in rows}) == len(rows)
    return {words(r): r.p for r in rows}, {words(r): r.back for r in rows}


@pytest.mark.parametrize("order", [2, 3, 4])
def test_definitions(spark, order):
    p, back = table(ngrams.kneser_ney(frame(spark, [*LINES, ""]), "w", order))
    want, factors = plainly(LINES, order)
    assert p.keys() == want.keys() and all(math.isclose(p[g], want[g], rel_tol=1e-12) for g in want)
    assert all(x is None if len(g) == order else math.isclose(x, factors.get(g, 1.0), rel_tol=1e-12) for g, x in back.items())
    factors = {g: x for g, x in back.items() if len(g) < order}
    words = [g[0] for g in p if len(g) == 1 and g != ("<s>",)]
    contexts = {g[:-1] for g in p} | {("z",), ("a", "z"), ("<s>", "b")} | {("<s>", "a", "b")[-order + 1 :]}
    for c in contexts:
        assert math.isclose(sum(after(p, factors, c, w) for w in words), 1.0, rel_tol=1e-9), c


def test_fallback_and_empty(spark):
    p, _ = table(ngrams.kneser_ney(frame(spark, ["x y"]), "w", 3))
    want, _ = plainly(["x y"], 3)
    assert p.keys() == want.keys() and all(math.isclose(p[g], want[g]) for g in want)
    assert ngrams.kneser_ney(frame(spark, [""]), "w", 3).count() == 0
    nulls = spark.createDataFrame([(1, None)], "id long, w array<string>")
    assert ngrams.kneser_ney(nulls, "w", 3).count() == 0


def test_arpa(spark, tmp_path):
    model = ngrams.kneser_ney(frame(spark, LINES), "w", 3)
    ngrams.write_arpa(model, str(tmp_path / "lm"))
    text = "".join(f.read_text() for f in sorted((tmp_path / "lm").glob("part-*")))
    p, back = table(model)
    sizes = Counter(len(g) for g in p)
    heads = "\\data\\\n" + "".join(f"ngram {k}={sizes[k]}\n" for k in (1, 2, 3)) + "\n\\1-grams:\n"
    assert text.startswith(heads) and text.endswith("\n\\end\\\n")
    sections = text.split("\n\\")
    assert [s.split(":")[0] for s in sections[1:4]] == ["1-grams", "2-grams", "3-grams"]
    for k, s in enumerate(sections[1:4], 1):
        rows = [r.split("\t") for r in s.splitlines()[1:] if r]
        assert [r[1] for r in rows] == sorted(r[1] for r in rows) and len(rows) == sizes[k]
        assert all(len(r) == (3 if k < 3 else 2) and r[0] == f"{math.log10(p[tuple(r[1].split())]):.7f}" for r in rows)
    q, factors = table(ngrams.read_arpa(spark, str(tmp_path / "lm")))
    assert q.keys() == p.keys()
    assert all(math.isclose(q[g], p[g], rel_tol=1e-6) and (back[g] is None if factors[g] is None else math.isclose(factors[g], back[g], rel_tol=1e-6)) for g in p)


@pytest.mark.parametrize("order", [2, 3])
def test_score(spark, order):
    model = ngrams.kneser_ney(frame(spark, LINES), "w", order)
    p, back = table(model)
    back = {g: x for g, x in back.items() if x is not None}
    asked = ["a b c", "z", "a z b c", "k a l", "a a a a a a", "", "h h h", "<s>"]
    got = {r.id: r for r in ngrams.score(frame(spark, asked), "w", model, "id").collect()}
    assert got.keys() == {i for i, x in enumerate(asked) if x}
    for i, r in got.items():
        line = ["<s>", *asked[i].split(), "</s>"]
        known = [(w,) in p and w != "<s>" for w in line[1:]]
        words = [w if k else "?" for w, k in zip(line[1:], known, strict=True)]
        logs = [math.log10(after(p, back, tuple(line[max(0, j - order + 2) : j + 1]), w)) for j, w in enumerate(words)]
        assert r.n_words == len(words) and r.n_unknown == known.count(False)
        assert math.isclose(r.log10_p, sum(logs), rel_tol=1e-9)


def written(tmp_path, read: dict):
    """A cut that writes tables, and notes which files each is made from."""

    def cut(df, name):
        read[name] = df.inputFiles()
        df.write.parquet(str(tmp_path / name))
        return df.sparkSession.read.schema(df.schema).parquet(str(tmp_path / name))

    return cut


@pytest.mark.parametrize("order", [3, 4])
def test_lines_are_read_once_and_words_without_codes(spark, tmp_path, monkeypatch, order):
    """Lines are counted for the highest order alone (and lines shorter than it), and words that are spelt out are what they were."""
    monkeypatch.setattr(ngrams, "CODES", 3)
    lines = [x.replace("h", "~h").replace("g", "%20").replace("f", "1") for x in LINES]
    frame(spark, lines).write.parquet(str(tmp_path / "lines"))
    table_of = spark.read.parquet(str(tmp_path / "lines"))
    read = {}
    book = ngrams.codes(table_of.select(F.explode("w").alias("word")))
    p, back = table(ngrams.kneser_ney(table_of, "w", order, written(tmp_path, read), book))
    want, factors = plainly(lines, order)
    assert p.keys() == want.keys() and all(math.isclose(p[g], want[g], rel_tol=1e-12) for g in want)
    assert all(x is None if len(g) == order else math.isclose(x, factors.get(g, 1.0), rel_tol=1e-12) for g, x in back.items())
    assert sorted(name for name, files in read.items() if any("/lines/" in f for f in files)) == ["codes", f"keys{order - 1}"]


@pytest.mark.parametrize(("order", "n_codes", "bits"), [(2, 1 << 19, 20), (3, 1 << 19, 20), (3, 3, 20), (3, 1 << 19, 3), (4, 5, 20)])
def test_score_by_needs_no_model(spark, tmp_path, monkeypatch, order, n_codes, bits):
    """Definitions and back-off; what is written is n-grams of the lines that are asked for, and counts."""
    monkeypatch.setattr(ngrams, "CODES", n_codes)
    monkeypatch.setattr(ngrams, "BITS", bits)
    lines = [x.replace("h", "~h").replace("g", "%20").replace("f", "1") for x in LINES]
    p, back = plainly(lines, order)
    asked = ["a b c", "z", "a z b c", "k a l", "a a a a a a", "", "~h ~h ~h", "<s>", "1 e", "%20 %20 1 ~z", "e 1 %20 ~h a", "a b c"]
    wrote = {}
    got = {r.id: r for r in ngrams.score_by(frame(spark, asked), "w", "id", frame(spark, [*lines, ""]), "w", order, written(tmp_path, wrote)).collect()}
    assert got.keys() == {i for i, x in enumerate(asked) if x}
    for i, r in got.items():
        line = ["<s>", *asked[i].split(), "</s>"]
        known = [(w,) in p and w != "<s>" for w in line[1:]]
        words = [w if k else "?" for w, k in zip(line[1:], known, strict=True)]
        logs = [math.log10(after(p, back, tuple(line[max(0, j - order + 2) : j + 1]), w)) for j, w in enumerate(words)]
        assert r.n_words == len(words) and r.n_unknown == known.count(False)
        assert math.isclose(r.log10_p, sum(logs), rel_tol=1e-9)
    assert sorted(wrote) == sorted(["codes", "found", *(f"counts{k}" for k in range(1, order + 1))])


@pytest.mark.parametrize(("lines", "asked"), [("", "a b"), ("a b", "")])
def test_score_by_without_lines(spark, tmp_path, lines, asked):
    cut = written(tmp_path, {})
    assert ngrams.score_by(frame(spark, [asked]), "w", "id", frame(spark, [lines]), "w", 3, cut).count() == 0


def test_perplexity_makes_no_model(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(ngrams, "kneser_ney", None)
    assert registry.QUERIES["word_model_perplexity"](spark, sf_dir).count() > 0
