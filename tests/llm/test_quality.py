"""Quality rules against counting in plain Python."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

from loomwork.llm import quality


def base(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}
    lines, seen, again = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(covered)


def normal(line: str) -> str:
    return re.sub("[0-9]", "0", re.sub(r"[\t-\r ]+", " ", line.lower())).strip(" ")


def brute(rows: list[tuple], limit: int) -> list[tuple]:
    """(doc_id, counts, base_failed, n_boilerplate_words, kept) of (doc_id, text, host)."""
    docs: dict[tuple, set] = defaultdict(set)
    split = []
    for place, (doc, text, host) in enumerate(rows):
        own: dict[str, int] = defaultdict(int)
        for line in (text or "").split("\n"):
            if n := len(re.findall(r"[^\x20\x09-\x0D]+", line)):
                own[normal(line)] += n
        split.append(own)
        for line in own:
            docs[host or "", line].add((doc, place if doc is None else None))
    out = []
    for (doc, text, host), own in zip(rows, split, strict=True):
        counts = base(text)
        n = counts[0]
        failed = n < 10 or 100 * counts[4] > 20 * n
        lost = sum(k for line, k in own.items() if len(docs[host or "", line]) > limit)
        left = n - lost
        out.append((doc, *counts, failed, lost, not failed and not (lost > 0 and (left < 10 or 100 * left < 30 * n))))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_boilerplate_words", "kept"]


def found(df, **more) -> list[tuple]:
    return sorted((tuple(r) for r in quality.judge(df, **more).select(*COLUMNS).collect()), key=repr)


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted((tuple(r) for r in quality.op8_quality_rules(spark, sf_dir).select(*COLUMNS).collect()), key=repr)
    assert got == brute([(r.doc_id, r.text, r.source) for r in docs.collect()], quality.LINE_LIMIT)


def test_cases(cases, clashing, empty):
    want = brute([(r.doc_id, r.text, r.source) for r in cases.collect()], 2)
    assert found(cases, line_limit=2) == want
    assert found(clashing, line_limit=2) == want
    assert found(empty) == []


def test_common_lines(spark):
    rows = [(i, f"Share  THIS page {i % 10}\n" + "\n".join(f"own line number {i}x{k} of it all" for k in range(i % 4)), "h" if i % 2 else None) for i in range(60)]
    rows += [(100, "Share this page 3\r\nshare this page 7", "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert found(df, line_limit=5) == brute(rows, 5)
    left = {r.doc_id: r.text for r in quality.clean(df, line_limit=5).collect()}
    assert left[100] == rows[-1][1] and left[4] == "" and left[3] == rows[3][1].split("\n", 1)[1]


def test_documents_are_counted_not_rows(spark):
    """A line of six rows with one key is one document's; six rows without a key are six documents; null hosts are one host."""
    own = lambda i: "".join(f" word{'abcdefgh'[i]}{'klmnopqrst'[k % 10]}" for k in range(20))
    rows = [(1, "same line of one document\n" + own(i), "h") for i in range(6)]
    rows += [(None, "line of many documents\n" + own(i), None) for i in range(6)] + [(7, "line of many documents\n" + own(7), "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert found(df, line_limit=3) == brute(rows, 3)
    left = sorted(r.text for r in quality.clean(df, line_limit=3).collect())
    assert left == sorted([t for d, t, _ in rows if d] + [own(i) for i in range(6)])
