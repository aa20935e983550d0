"""N-gram Jaccard join against all pairs by brute force."""

from __future__ import annotations

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from loomwork.llm import jaccard


def shingles(text: str | None) -> set[tuple]:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(rows: list[tuple]) -> list[tuple]:
    """(doc_id, n_shingles, component_id) of (doc_id, text)."""
    sets = [(d, shingles(t)) for d, t in rows]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, x) in enumerate(sets):
        for j in range(i):
            y = sets[j][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(x), least[find(i)]) for i, (d, x) in enumerate(sets))


def found(df) -> list[tuple]:
    return sorted(tuple(r) for r in jaccard.jaccard_components(df).select("doc_id", "n_shingles", "component_id").collect())


def test_cases(cases, clashing, empty):
    want = brute([(r.doc_id, r.text) for r in cases.collect()])
    assert found(cases) == want
    assert found(clashing) == want
    assert found(empty) == []


@pytest.mark.parametrize("paired", [32, 2])
def test_near_copies_around_the_threshold(spark, monkeypatch, paired):
    """Chains and a crowd of variants of one text, most pairs just above or below 75 of 100, compared by pairs and by blocks."""
    monkeypatch.setattr(jaccard, "PAIRED", paired)
    monkeypatch.setattr(jaccard, "BLOCK_GRAMS", 700)
    rng, rows = random.Random(7), []
    for base in range(4):
        words = [f"w{rng.randrange(10**6)}" for _ in range((12, 30, 70, 150)[base])]
        for _ in range(40):
            own = list(words)
            for _ in range(rng.randrange(max(2, len(own) // 14))):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
    line = " ".join(f"c{i}" for i in range(25))
    for i in range(60):
        rows.append((len(rows), line + " " + " ".join(f"y{rng.randrange(10**6)}" for _ in range(rng.randrange(4, 40)))))
    rng.shuffle(rows)
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_many_short_sets_take_little_memory():
    """6000 sets of 8 n-grams, 5 of them in all sets and not linked by these, but for one pair: no matrix of sets by sets is held."""
    sets = [sorted([*range(1, 6), *(100 + 3 * i + j for j in range(3))]) for i in range(5999)]
    sets.append([*sets[17][:7], 10**6])
    hashes, offsets = np.array(sets, np.uint64).ravel(), np.arange(0, 8 * len(sets) + 1, 8)
    ids = jaccard.set_ids(hashes, offsets)
    tracemalloc.start()
    got = jaccard.forest(ids, hashes, offsets, 75)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [(ids[17], ids[5999])]
    assert peak < 250e6


def test_short_texts_with_a_passage_in_blocks_of_few_sets(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PAIRED", 2)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 30)
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(9))
    rows = [(i, passage + " " + " ".join(f"z{rng.randrange(12)}" for _ in range(3))) for i in range(200)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert found(docs) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])

def test_hot_entries_are_dealt_apart(spark, monkeypatch):
    """Sets that share a passage with all others, with their entries dealt apart from the buckets."""
    monkeypatch.setattr(jaccard, "HOT_ENTRIES", 20)
    monkeypatch.setattr(jaccard, "HOT_SAMPLE", 2)
    monkeypatch.setattr(jaccard.common, "FEW_ROWS", 0)
    monkeypatch.setattr(jaccard, "BUCKET_BYTES", 4000)
    monkeypatch.setattr(jaccard, "PAIRED", 8)
    rng = random.Random(11)
    passage = " ".join(f"p{i}" for i in range(12))
    rows = [(i, passage + " " + " ".join(f"z{rng.randrange(9)}" for _ in range(rng.randrange(1, 6)))) for i in range(150)]
    rows += [(200 + i, " ".join(f"q{rng.randrange(10**6)}" for _ in range(30)) + " " + passage) for i in range(50)]
    rows += [(300 + i, t) for i, (_, t) in enumerate(rows[:60])]
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)


def test_sets_that_share_a_number(spark, monkeypatch):
    """With numbers of 5 bits nearly every set shares its own with another: they are told apart all the same."""
    monkeypatch.setattr(jaccard, "ID_BITS", 5)
    rng = random.Random(15)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(15))) for i in range(60)]
    rows += [(100 + i, t + " end") for i, (_, t) in enumerate(rows[:20])] + [(200 + i, t) for i, (_, t) in enumerate(rows[10:30])]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_repeated_and_null_keys(spark):
    """One key with two texts, null keys with and without other keys beside them."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(20)) for x in "abc")
    rows = [(1, a), (1, b), (2, a + " end"), (3, b), (None, c), (None, c + " end"), (None, a), (4, "x"), (None, ""), (4, "x")]
    got = Counter(tuple(r) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter([(1, 16, 1), (1, 16, 1), (2, 17, 1), (3, 16, 1), (None, 16, None), (None, 17, None), (None, 16, 1), (4, 1, 4), (None, 0, None), (4, 1, 4)])


def test_many_short_texts_with_a_passage(spark):
    """12000 texts of twelve words, nine of them shared by all: a candidate group of all, of which few are linked."""
    rng = random.Random(13)
    passage = " ".join(f"p{i}" for i in range(9))
    rows = [(i, f"{passage} a{i} b{i} c{i}") for i in range(12_000)]
    rows += [(20_000 + k, f"{passage} a{i} b{i} d{k}") for k, i in enumerate(rng.sample(range(12_000), 50))]
    want = {20_000 + k: int(t.split()[9][1:]) for k, (_, t) in enumerate(rows[12_000:])}
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id != r.component_id} == want
