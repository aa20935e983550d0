"""Secret scans against the patterns applied one by one, and planted credentials without a pattern."""

from __future__ import annotations

import hashlib
import math
import random
import re
import string

import pytest

from loomwork.llm import secrets

ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text: str | None) -> list[tuple[int, int, int]]:
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_documents(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = secrets.op1_secret_scan(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        spans = base(texts[r.doc_id])
        said = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in spans) for i in range(3))
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert set(filter(None, said.split(","))) <= set(r.spans.split(",") if r.spans else ())


def test_edges_of_patterns(spark):
    texts = ["é password = 'abc12' token:abcdef", "\U0001f511 ApI_KeY=\"a.b-c=/+_\"", "AKIA" + "A" * 15 + " AKIA" + "B" * 16 + "c", "f" * 23 + " " + "0" * 24 + "G", "passwordtoken=zzzzzz", "paſſword=abcdef secreT  :  \t abcdefg", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secrets.scan(df, secrets.train(df)).collect():
        assert [(x.start, x.kind, x.end) for x in r.secrets if x.kind != secrets.GRAMMAR] == [(s, secrets.KINDS[k], e) for s, k, e in base(r.text)]


def test_formats_are_learned(spark):
    """Keys of a format that labelled ones show are found without a label; words and paths aren't."""
    rng = random.Random(3)
    key = lambda: "sk_" + "".join(rng.choice(string.ascii_uppercase[:6] + string.digits) for _ in range(20))
    rows = [f"see token={key()} there" for _ in range(80)] + [f"path /usr/lib/module{i}/share-{i}ab and some-ordinary-words-{i}" for i in range(80)]
    planted = [f"left here {key()} by mistake" for _ in range(20)]
    clean = [f"look at /usr/lib/module{i}/share-{i}ab now" for i in range(200, 220)]
    df = spark.createDataFrame(list(enumerate(rows + planted + clean)), "doc_id long, text string")
    out = {r.doc_id: [x.kind for x in r.secrets] for r in secrets.scan(df, secrets.train(df)).collect()}
    assert sum(out[160 + i] == [secrets.GRAMMAR] for i in range(20)) >= 15
    assert all(out[180 + i] == [] for i in range(20))


def test_all_candidates_are_secrets(spark):
    """Candidates of a labelled format are found however many they are, and with nothing else beside them."""
    rng = random.Random(4)
    key = lambda: "sk_" + "".join(rng.choice(string.ascii_uppercase[:6] + string.digits) for _ in range(20))
    rows = [f"see token={key()} there" for _ in range(80)] + [f"left here {key()} by mistake" for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    out = {r.doc_id: [x.kind for x in r.secrets] for r in secrets.scan(df, secrets.train(df)).collect()}
    assert sum(out[80 + i] == [secrets.GRAMMAR] for i in range(300)) >= 255


def test_cases(cases, clashing, empty):
    for df in (cases, clashing, empty):
        model = secrets.train(df)
        found, cleaned = secrets.scan(df, model), secrets.redact(df, model)
        assert found.count() == cleaned.count() == df.count()
        assert cleaned.columns == df.columns
    as_rows = lambda df: sorted(((r.doc_id, r.text, str(r.secrets)) for r in df.collect()), key=repr)
    model = secrets.train(cases)
    assert secrets.train(clashing) == model and as_rows(secrets.scan(clashing, model)) == as_rows(secrets.scan(cases, model))
    assert all(r.secrets == [] for r in secrets.scan(cases.filter("text is null or text = ''"), model).collect())
    clean = secrets.redact(cases, secrets.train(cases)).select("doc_id", "text")
    assert clean.filter("text is null").count() == 1
    assert clean.exceptAll(cases.select("doc_id", "text")).count() <= 2  # long runs of letters and digits alone may be taken for keys


def test_redaction(spark):
    df = spark.createDataFrame([(1, "a password=hunter22 b"), (2, "clean"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in secrets.redact(df, secrets.train(df)).collect()}
    assert got == {1: "a [SECRET] b", 2: "clean", 3: None}


def plain_score(automaton: list, text: str) -> float:
    """Log probability by the automaton's counts, one step after another."""
    state, p = 0, 0.0
    for c in text:
        moves, ends = automaton[state]
        seen = ends + sum(k for _, k in moves.values()) + secrets.SMOOTHING * secrets.ALPHABET
        p += math.log(((moves[c][1] if c in moves else 0) + secrets.SMOOTHING) / seen)
        state = moves[c][0] if c in moves else state
    moves, ends = automaton[state]
    return p + math.log((ends + secrets.SMOOTHING) / (ends + sum(k for _, k in moves.values()) + secrets.SMOOTHING * secrets.ALPHABET))


def test_added_spans_by_a_plain_scorer(spark):
    """Every candidate of every text is scored whole, whatever its length, letters and dots; those within a base span are left out."""
    rng = random.Random(8)
    key = lambda n: "k." + "".join(rng.choice("XYZ789") for _ in range(n))
    words = [f"{a}{b}{c}" for a in ("spring", "river", "stone") for b in ("time", "side", "field") for c in ("", "s", "less", "-bound.")]
    texts = [f"set token={key(rng.choice((20, 30, rng.randrange(10, 120))))} for the {rng.choice(words)} of {rng.choice(words)}" for _ in range(160)]
    texts += [f"left {key(rng.choice((20, 30)))}, {''.join(rng.choice('XYZ') for _ in range(30))} {rng.choice(words)} 2024-01-{i:02} \n{key(30)}.é{rng.choice(words)}" for i in range(60)]
    texts += [f"password={key(9)}/{key(30)} token: {key(8)}", f"{key(3)}/token={key(30)}", "+" + "0123456789abcdef" * 2 + "+/", " ".join(words), None, "x" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = secrets.train(df)
    shape = lambda x: (len(x), frozenset("a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c for c in x))
    forms = {secrets.shape(key(n)): shape(key(n)) for n in (20, 30)}
    assert {f["form"] for f in model["formats"]} == {0, *forms}
    added = 0
    for r in secrets.scan(df, model).collect():
        taken = [(s, e) for s, _, e in base(r.text)]
        want = []
        for m in re.finditer(r"[A-Za-z0-9+/_.=-]{6,}", r.text or ""):
            run = m[0].rstrip(".")
            back, even = max(plain_score(b, run) for b in model["backgrounds"]), -math.log(secrets.ALPHABET) * (len(run) + 1)
            fits = [f for f in model["formats"] if not f["form"] or forms[f["form"]] == shape(run)]
            gains = [(plain_score(f["automaton"], run) - (max(back, even) if f["even"] else back), f) for f in fits]
            within = any(s <= m.start() and m.start() + len(run) <= e for s, e in taken)
            if len(run) >= 6 and not within and any(g >= f["least"] and g / (len(run) + 1) >= f["cutoff"] for g, f in gains):
                want.append((m.start(), m.start() + len(run)))
        assert [(x.start, x.end) for x in r.secrets if x.kind == secrets.GRAMMAR] == want
        added += len(want)
    assert added >= 100


FORMATS = {
    "lower and digits": lambda r: "".join(r.choice(string.ascii_lowercase + string.digits) for _ in range(32)),
    "base62": lambda r: "".join(r.choice(string.ascii_letters + string.digits) for _ in range(32)),
    "prefix": lambda r: "ghp_" + "".join(r.choice(string.ascii_letters + string.digits) for _ in range(36)),
    "two prefixes": lambda r: "sk-live-" + "".join(r.choice(string.ascii_letters + string.digits) for _ in range(24)),
    "base32": lambda r: "".join(r.choice(string.ascii_uppercase + "234567") for _ in range(26)),
    "upper and digits": lambda r: "".join(r.choice(string.ascii_uppercase + string.digits) for _ in range(20)),
    "hex": lambda r: "".join(r.choice("0123456789abcdef") for _ in range(20)),
    "uuid": lambda r: "-".join("".join(r.choice("0123456789abcdef") for _ in range(n)) for n in (8, 4, 4, 4, 12)),
}


@pytest.mark.parametrize("labels", [500, 25])
def test_common_formats(spark, sf_dir, labels):
    """Of each format fresh strings without a label are found, even with many more of them than labelled ones, and prose is left alone."""
    rng = random.Random(21)
    docs = [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    rows = list(docs)
    for make in FORMATS.values():
        rows += [f'{rng.choice(docs)[:300]} token: "{make(rng)}" and {rng.choice(docs)[:200]}' for _ in range(labels)]
    planted = {}
    for name, make in FORMATS.items():
        for _ in range(100):
            key = make(rng)
            planted[len(rows)] = (name, key)
            rows.append(f"some words before {key}. And some after")
    found = secrets.scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4), secrets.train(spark.createDataFrame([(x,) for x in rows], "text string").repartition(4)))
    hits, words, wrong = dict.fromkeys(FORMATS, 0), 0, 0
    for r in found.collect():
        added = [r.text[x.start : x.end] for x in r.secrets if x.kind == secrets.GRAMMAR]
        if r.doc_id in planted:
            name, key = planted[r.doc_id]
            hits[name] += added == [key]
        elif r.doc_id < len(docs):
            words += len(r.text.split())
            wrong += len(added)
    assert all(n >= 90 for n in hits.values()), hits
    assert wrong <= 1e-5 * words
