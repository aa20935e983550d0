"""Functions that SQL can't state, against plain Python; readers and sinks on files written by the tests."""

from __future__ import annotations

import hashlib
import hmac
import json
import math
import random
import re
import wave

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from loomwork import registry
from loomwork.functions import metrics, speech, vectors
from loomwork.operators import chunks
from loomwork.plans import numbers
from loomwork.sources import jsonl
from pyspark.sql import functions as F


def spark_hash(*values) -> int:
    """Spark's xxhash64 of 64-bit numbers, 32-bit ones (tuples of one) and strings."""
    h = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else v[0].to_bytes(4, "little", signed=True) if isinstance(v, tuple) else v.to_bytes(8, "little", signed=True)
        h = xxhash.xxh64_intdigest(raw, h)
    return h - (1 << 64) if h >> 63 else h


def test_signed_payloads(spark, sf_dir):
    props = {r.event_id: r.props for r in spark.read.parquet(f"{sf_dir}/events.parquet").collect()}
    for r in registry.QUERIES["signed_payloads"](spark, sf_dir).collect():
        assert r.signature == hmac.new(numbers.SECRET.encode(), props[r.event_id].encode(), hashlib.sha512).hexdigest()
    long = "k" * 200
    row = spark.range(1).select(metrics.hmac_sha512(long, F.lit("é")).alias("s"), metrics.hmac_sha512("x", F.lit(None).cast("string")).alias("none")).first()
    assert row.s == hmac.new(long.encode(), "é".encode(), hashlib.sha512).hexdigest() and row.none is None


def plain_features(samples: list[float]) -> list[float] | None:
    frames = [samples[i : i + 400] for i in range(0, max(len(samples) - 400, 0), 160)]
    frames = [f for f in frames if math.sqrt(sum(x * x for x in f) / 400) >= 0.005]
    if len(frames) < 5:
        return None
    mean = lambda xs: sum(xs) / len(xs)
    bands = [mean([math.log1p(sum(x * x for x in f[b * 33 : b * 33 + 33])) for f in frames]) for b in range(12)]
    crossings = mean([sum((a >= 0) != (b >= 0) for a, b in zip(f, f[1:], strict=False)) / 400 for f in frames])
    loud = mean([math.sqrt(sum(x * x for x in f) / 400) for f in frames])
    tilt = mean([math.log1p(sum(x * x for x in f[200:])) - math.log1p(sum(x * x for x in f[:200])) for f in frames])
    own = [*bands, crossings, loud, tilt, *(b - a for a, b in zip(bands, bands[1:], strict=False))]
    out = [own[i % len(own)] * (1 + 0.07 * math.sin(1.7 * i)) for i in range(64)]
    size = math.sqrt(sum(x * x for x in out)) or 1.0
    return [x / size for x in out]


def test_speaker_features(spark):
    loud = [math.sin(i / 7) * (0.5 + 0.4 * math.sin(i / 900)) for i in range(4000)]
    rows = [(1, loud), (2, [0.0] * 4000), (3, loud[:500]), (4, None), (5, []), (6, [0.001] * 2000 + loud)]
    got = {r.i: r.f for r in spark.createDataFrame(rows, "i int, v array<double>").select("i", vectors.speaker_features("v").alias("f")).collect()}
    for i, v in rows:
        want = None if v is None else plain_features(v)
        assert (got[i] is None) == (want is None)
        if want:
            assert got[i] == pytest.approx(want, abs=1e-9)


def plain_pack(pieces: list[str], most: int) -> list[str]:
    lines, line = [], ""
    for p in pieces:
        if line and len(line) + 1 + len(p) > most:
            lines.append(line)
            line = p
        else:
            line = f"{line} {p}" if line else p
    return lines + [line] if line else lines


def test_pack_chunks(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got: dict[int, list] = {}
    for r in registry.QUERIES["pack_chunks"](spark, sf_dir).orderBy("doc_id", "n").collect():
        got.setdefault(r.doc_id, []).append(r.chunk)
    for doc, text in texts.items():
        if len(text) <= 160:
            want = [text] if text else []
        else:
            lines = plain_pack([s for s in (s.strip() for s in re.sub(r"([.!?])\s+", "\\1\0", text).split("\0")) if s], 160)
            want = [y for x in lines for y in ([x] if len(x) <= 160 else plain_pack(x.split(), 160))]
        assert got.get(doc, []) == want


def test_reply_chunks(spark):
    reply = "Yes. I can help you with that order, it is ready!  Come  by tomorrow morning, or later"
    got = spark.createDataFrame([(reply,), ("",), (None,), ("a b",)], "t string").select(chunks.live(F.col("t")).alias("c")).collect()
    assert [r.c for r in got] == [["Yes. ", "I can help you with that order, ", "it is ready!  ", "Come  by tomorrow morning, or ", "later"], [], [], ["a b"]]


def plain_live(reply: str) -> list[str]:
    out, held = [], ""
    for part in re.findall(r"\S+\s*", reply):
        held += part
        if len(held) >= 28 or re.search(r"[.!?]\s*\Z", held):
            out.append(held)
            held = ""
    return out + [held] if held else out


def test_folds_in_runs(spark, monkeypatch):
    """Texts of many lines, in short runs; sentences of one mark, marks within words, and spaces of all kinds."""
    monkeypatch.setattr(chunks, "RUN", 3)
    rng = random.Random(8)
    words = ["a", "Yes.", "?", "3.5", "no!", "x" * 30, "e.g.", "word", "ɛyɛ.", "b" * 200]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\t ", ".", ""]) for _ in range(rng.randrange(0, 90))) for _ in range(150)] + [" lead. ", "."]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    for r in df.select("i", "t", chunks.live(F.col("t")).alias("live"), chunks.sentences(F.col("t")).alias("lines")).collect():
        assert r.live == plain_live(r.t)
        if len(r.t) > 160:
            lines = plain_pack([s for s in (s.strip() for s in re.sub(r"([.!?])\s+", "\\1\0", r.t).split("\0")) if s], 160)
            assert r.lines == [y for x in lines for y in ([x] if len(x) <= 160 else plain_pack(x.split(), 160))]
        else:
            assert r.lines == ([r.t] if r.t else [])


def test_masked(spark):
    """Cells are kept or become 0, in whole blocks of time and of bands, the same on every run."""
    grid = [[float(100 * b + i + 1) for i in range(40)] for b in range(20)]
    rows = [(k, grid) for k in range(60)] + [(100, [[1.0, 2.0]]), (101, []), (102, None), (103, [[]])]
    df = spark.createDataFrame(rows, "k int, f array<array<double>>").repartition(3)
    how = {"time_share": 0.5, "time_most": 8, "band_share": 0.3, "band_most": 4}
    got = {r.k: r.m for r in df.select("k", vectors.masked(F.col("f"), F.col("k"), **how).alias("m")).collect()}
    assert got == {r.k: r.m for r in df.coalesce(1).select("k", vectors.masked(F.col("f"), F.col("k"), **how).alias("m")).collect()}
    assert got[101] == [] and got[102] is None and got[103] == [[]]
    draw = lambda k, kind, n, i: int(hashlib.md5(f"mask:{k}:{kind}:{n}".encode()).hexdigest()[8 * i : 8 * i + 8], 16)
    for k in range(60):
        times = [(draw(k, "t", n, 1) % (40 - length + 1), length) for n in range(2) for length in [draw(k, "t", n, 0) % 8 + 1]]
        bands = [(draw(k, "b", n, 1) % (20 - length + 1), length) for n in range(1) for length in [draw(k, "b", n, 0) % 4 + 1]]
        gone = lambda i, blocks: any(s <= i < s + n for s, n in blocks)
        assert got[k] == [[0.0 if gone(b, bands) or gone(i, times) else x for i, x in enumerate(row)] for b, row in enumerate(grid)]
    assert len({str(got[k]) for k in range(60)}) > 50


def plain_words(n: int, language: str) -> str:
    """By thousands, hundreds and tens, one after another."""
    twi = language == "tw"
    ones, tens = (speech.ONES_TW, speech.TENS_TW) if twi else (speech.ONES_EN, speech.TENS_EN)
    if n < 20:
        return ones[n]
    parts, thousand = [], n // 1000
    if thousand:
        parts += [plain_words(thousand, language), "apem" if twi else "thousand"]
    if hundred := n % 1000 // 100:
        parts.append(("ɔha" if hundred == 1 else f"{ones[hundred]} ɔha") if twi else f"{ones[hundred]} hundred")
    if rest := n % 100:
        parts += [ones[rest]] if rest < 20 else [tens[rest // 10]] + ([ones[rest % 10]] if rest % 10 else [])
    return " ".join(parts)


def plain_number(token: str, language: str) -> str:
    if not re.fullmatch(r"[0-9]+(\.[0-9]+)?", token):
        return token
    whole, _, part = token.partition(".")
    said = plain_words(int(whole), language) if int(whole) <= 999_999 else str(int(whole)) if part else whole
    if not part or part == "00":
        return said
    return f"{said} point " + (plain_words(int(part), language) if len(part) == 2 else " ".join(plain_words(int(d), language) for d in part))


@pytest.mark.parametrize("language", ["en", "tw"])
def test_numbers_in_words(spark, language):
    rng = random.Random(5)
    tokens = [str(n) for n in [*range(130), 199, 200, 1000, 1001, 1100, 20_019, 100_000, 999_999, 1_000_000]] + [str(rng.randrange(10 ** rng.randrange(1, 8))) for _ in range(300)]
    tokens += ["007", "0000000", "12.5", "12.50", "0.05", "1.00", "3.125", "1234567.25", "001234567.1", "x", "", "1.", ".5", "1.2.3", "1" * 50, "-4"]
    df = spark.createDataFrame([(t,) for t in [*tokens, None]], "t string")
    for r in df.select("t", speech.number_words(F.col("t"), language).alias("w")).collect():
        assert r.w == (None if r.t is None else plain_number(r.t, language)), r.t
    pieces = [*tokens, "GHS 5", "gh₵12.50", "₵3", "word", "v2", "3kg", "4,", "5?!", "6. ", "1,000", "2024-01-05", "\u00a07\u00a0", "\n8\n"]
    texts = [" ".join(rng.choice(pieces) for _ in range(rng.randrange(0, 12))) for _ in range(300)]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", speech.spoken_numbers(F.col("t"), language).alias("w")).collect():
        amounts = re.sub(r"(?:GH₵|GHS|₵)\s*([0-9]+(?:\.[0-9]{1,2})?)", lambda m: "Ghana cedi " + plain_number(m[1], language), r.t, flags=re.IGNORECASE | re.ASCII)
        assert r.w == re.sub(r"(?<!\S)([0-9]+(?:\.[0-9]+)?)(?=[.,;:!?]*(?:\s|$))", lambda m: plain_number(m[1], language), amounts)


def test_prepared(spark):
    cases = {
        "en": [("Take 12 mg or 3.5 ml - 250 people.", "Take twelve milligrams or three point five milliliters - two hundred fifty people."), ("The CHW said: *WHO* pays GHS 5", None), (None, ""), ("a–b  c", "a, b c"), ("1000001 kg", "1000001 kilograms")],
        "tw": [("21 kg", "aduonu baako kilograms"), ("100", "ɔha")],
    }
    for language, pairs in cases.items():
        got = [r.s for r in spark.createDataFrame([(t,) for t, _ in pairs], "t string").select(speech.prepared(F.col("t"), language).alias("s")).collect()]
        for said, (_, want) in zip(got, pairs, strict=True):
            assert want is None or said == want
    long = spark.createDataFrame([("word " * 300,)], "t string").select(speech.prepared(F.col("t"), "en").alias("s")).first().s
    assert len(long) <= 600 and long == " ".join(["word"] * 119 + ["word"])[: len(long)]


def plain_noise(key: int, text: str) -> str:
    for i in range(1, spark_hash(key, "edits") % 3 + 2):
        words = text.split(" ")
        sound = speech.SOUNDS[spark_hash(key, "sound") % 3]
        made = []
        for pairs in speech.SPELLINGS:
            t = text
            for a, b in pairs:
                t = t.replace(a, b)
            made.append(t)
        made += [
            text.lower(),
            re.sub(r"([aeiouɛɔ])\1+", r"\1", text),
            re.sub(r"[ \t\n\x0b\f\r]+", " ", text),
            "".join(w + ("" if spark_hash(key, (k,)) % 100 < 8 else " ") for k, w in enumerate(words)),
            " ".join(words[:-1]) if len(words) > 3 else text,
            f"{text} {sound}" if spark_hash(key, "sounds") % 100 < 15 else text,
        ]
        text = made[spark_hash(key, (i,)) % len(made)]
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", text).strip(" ")


def test_noised(spark):
    said = ["Me yɛ Nyinsen na mogya  wɔ clinic hɔ", "Aane", "mepɛ sɛ  metɔɔ mako wɔ Makola ɛnnɛ ara", "a b c d"]
    rows = [(i, said[i % 4]) for i in range(200)]
    changed = set()
    for r in spark.createDataFrame(rows, "i long, t string").select("i", "t", speech.noised(F.col("i"), F.col("t")).alias("n")).collect():
        want = plain_noise(r.i, r.t)
        assert r.n == (r.t.lower().replace("ɛ", "e") if want in ("", r.t) else want)
        changed.add(r.n)
    assert len(changed) > 30


def test_white_space_of_any_kind(spark):
    from loomwork.functions import checks

    df = spark.createDataFrame([("\n\t",), ("\u00a0 \u3000",), ("a\u00a0b\u2003c a b c a b c",), ("a b",)], "t string")
    assert [r.r for r in df.select(checks.repeats(F.col("t")).alias("r")).collect()][:2] == [True, True]
    assert [r.l for r in df.select(checks.light(F.col("t")).alias("l")).collect()] == ["", "", "a b c a b c a b c", "a b"]


def test_word_edits(spark):
    rows = [("a b c", "a x c d"), ("", "a"), ("a", ""), ("", ""), ("ɛ ɔ ɛ", "ɔ ɛ"), ("w " * 300, "w " * 299)]
    got = spark.createDataFrame(rows, "r string, h string").select(metrics.word_edits(metrics.words(F.col("r")), metrics.words(F.col("h"))).alias("e"), F.levenshtein("r", "h").alias("c")).collect()
    assert [r.e for r in got] == [2, 1, 1, 0, 1, 1]


def test_readers(spark, tmp_path):
    (tmp_path / "good.jsonl").write_text('{"id": 1, "t": "a"}\n{"id": 2, "t": null}\n')
    (tmp_path / "bad.jsonl").write_text('{"id": 1}\n{"id": \n')
    assert [(r.id, r.t) for r in jsonl.read_strict(spark, str(tmp_path / "good.jsonl"), "id int, t string").collect()] == [(1, "a"), (2, None)]
    with pytest.raises(Exception, match="(?i)malformed"):
        jsonl.read_strict(spark, str(tmp_path / "bad.jsonl"), "id int, t string").collect()
    folder = tmp_path / "results"
    folder.mkdir()
    for i in range(3):
        (folder / f"r{i}.json").write_text(json.dumps({"model_id": f"m{i}", "wer": i / 10}, indent=2))
    got = jsonl.read_results(spark, str(folder), "model_id string, wer double").orderBy("wer").collect()
    assert [(r.model_id, r.wer, r.file.rsplit("/", 1)[1]) for r in got] == [(f"m{i}", i / 10, f"r{i}.json") for i in range(3)]
    (tmp_path / "t.tsv").write_text("path\tsentence\na.mp3\tme kɔ\nb.mp3\t\n")
    tsv = jsonl.read_tsv(spark, str(tmp_path / "t.tsv"))
    assert [tuple(r) for r in tsv.collect()] == [("a.mp3", "me kɔ"), ("b.mp3", None)]
    assert jsonl.first_column(tsv, ["text", "sentence", "path"]) == "sentence" and jsonl.first_column(tsv, ["x"]) is None
    (tmp_path / "prompts.txt").write_text("# head\n\n  one \n\t# no\ntwo\n")
    assert [r.value for r in jsonl.prompt_lines(spark, str(tmp_path / "prompts.txt")).collect()] == ["one", "two"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1.5), (None, None)], "model string, wer double").coalesce(1)
    path = jsonl.write_results(df, str(tmp_path), "wer", "org/model 1", None, 100)
    assert path.endswith("/wer_org-model-1_100")
    assert {tuple(r) for r in jsonl.read_strict(spark, path, "model string, wer double").collect()} == {("a|b", 1.5), (None, None)}
    assert [r.line for r in jsonl.pipe_table(df).collect()] == ["| a\\|b | 1.5 |", "| - | - |"]
    assert jsonl.pipe_head(df) == ["| model | wer |", "| --- | --- |"]


def test_wave_files(spark, tmp_path):
    for name, rate, n in (("a.wav", 16000, 8000), ("b.wav", 8000, 12345)):
        with wave.open(str(tmp_path / name), "wb") as w:
            w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate), w.writeframes(b"\0\0" * n)
    (tmp_path / "c.wav").write_bytes(b"no wave file")
    got = {r.path.rsplit("/", 1)[1]: r.s for r in jsonl.read_files(spark, str(tmp_path), "*.wav").select("path", vectors.wav_seconds(F.col("content")).alias("s")).collect()}
    assert got == {"a.wav": 0.5, "b.wav": 12345 / 8000, "c.wav": None}


def test_prepared_by_its_head(spark, monkeypatch):
    """What the head of a text decides is what the whole decides: with amounts, numbers, addresses and marks where the head ends."""
    rng = random.Random(5)
    bits = ["₵", "GHS", "xGHS", "5", "12.50", "7,", "mg", "3", "https://a.b/c", "*x*", "–", "word", "CHWs", " ", "\n", " ", "1000000", "a" * 300, "`" * 40]
    rows = [(i, rng.choice(["", " "]).join([""] + [rng.choice(bits) + rng.choice([" ", "  ", "\n", ""]) for _ in range(rng.randrange(900))])) for i in range(150)]
    rows += [(200 + n, "w" * n + " pad" * 300 + " ₵" + " 5" * 9) for n in range(0, 12)] + [(300, None), (301, " " * 5000), (302, "*" * 5000 + "end"), (303, "x" * 5000)]
    df = spark.createDataFrame(rows, "i int, t string").repartition(4)
    of = lambda: {r.i: r.s for r in df.select("i", speech.prepared(F.col("t"), "en").alias("s")).collect()}
    short = of()
    monkeypatch.setattr(speech, "HEAD", 1 << 30)
    assert short == of()


def test_frames_of_few_rows_at_a_time(spark, monkeypatch):
    """Measures of a batch don't depend on how many rows are measured at once, and no more of them are."""
    sizes = []
    whole = vectors.frames_of
    monkeypatch.setattr(vectors, "frames_of", lambda flat, offsets: sizes.append(len(offsets) - 1) or whole(flat, offsets))
    rng = np.random.default_rng(2)
    rows = [None if i % 97 == 0 else list(rng.normal(size=rng.integers(0, 2000))) for i in range(600)]
    v = pa.array(rows, pa.list_(pa.float64()))
    for f in (vectors.frame_measures, vectors.speaker_features):
        many = f.func(v)
        assert max(sizes) <= 256 and sum(sizes) == len(rows)
        monkeypatch.setattr(vectors, "ROWS_AT_ONCE", 10_000)
        once = f.func(v)
        assert many.type == once.type and many.is_null().equals(once.is_null()) and [len(x or []) for x in many.to_pylist()] == [len(x or []) for x in once.to_pylist()]
        assert np.allclose(_numbers([x for x in many.to_pylist() if x]), _numbers([x for x in once.to_pylist() if x]), rtol=1e-6, atol=1e-9)
        monkeypatch.setattr(vectors, "ROWS_AT_ONCE", 256)
        sizes.clear()
    none = pa.array([], pa.list_(pa.float64()))
    assert len(vectors.frame_measures.func(none)) == len(vectors.speaker_features.func(none)) == 0


def _numbers(x):
    """All numbers of nested lists and rows, in order."""
    if isinstance(x, dict):
        x = list(x.values())
    return [y for part in x for y in _numbers(part)] if isinstance(x, list) else [x]


def test_wave_parts_end_with_the_content(spark):
    """Parts are followed no further than a wave file goes: those behind its end are not looked at."""
    part = lambda name, body: name + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) % 2)
    fmt = part(b"fmt ", (1).to_bytes(2, "little") + (1).to_bytes(2, "little") + (8000).to_bytes(4, "little") + (16000).to_bytes(4, "little") + b"\2\0\x10\0")
    wav = lambda *parts: b"RIFF\0\0\0\0WAVE" + b"".join(parts)
    files = [(wav(fmt, part(b"data", b"1" * 800)), 0.05), (wav(part(b"data", b"1" * 800), part(b"junk", b"abc"), fmt), 0.05), (wav(fmt), None), (wav(*[part(b"note", b"")] * 50, fmt, b"data" + (1600).to_bytes(4, "little")), 0.1), (b"RIFF", None), (None, None)]
    got = spark.createDataFrame([(i, f) for i, (f, _) in enumerate(files)], "i int, f binary").select("i", vectors.wav_seconds(F.col("f")).alias("s")).collect()
    assert {r.i: r.s for r in got} == {i: s for i, (_, s) in enumerate(files)}
    plan = spark.createDataFrame([(b"",)], "f binary").select(vectors.wav_seconds(F.col("f")).alias("s"))._jdf.queryExecution().analyzed().toString()
    assert "length(" in plan


def test_trigrams_without_functions_by_element(spark, sf_dir):
    """Words are zipped by built-ins that are compiled, not by functions that are called for each element."""
    plan = registry.QUERIES["trigram_counts"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan
