"""Secret scans: fixed patterns, and formats learned from labelled credentials by state merging in prefix trees (ALERGIA)."""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.llm import arrays, common

#: The base patterns, with the group whose length counts and its least length.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LENGTH = 6
#: Finds every text in which a base pattern can match, and some more.
MAYBE = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"""

GRAMMAR = "grammar"
WORD = "word"
#: Every run of the characters of a value, as long as one must be, is a candidate.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
#: Words of prose, for the background: runs of letters, with hyphens within and a full stop after.
PROSE = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z]+(?:-[A-Za-z]+)*\.?(?![A-Za-z0-9+/_.=-])")
#: Runs that aren't prose: with a digit or a mark other than a hyphen or a full stop.
OTHER = "other"
NOT_PROSE = r"[0-9+/_=]"
#: Distinct labelled strings of each format, words, and other unlabelled runs, from which the automata are inferred. Strings are
#: learned and scored whole.
SAMPLE = 400
WORDS = 2000
#: From fewer labelled strings than this nothing is learned.
LEAST_STRINGS = 8
#: Shares of the hash that the strings of a kind are ranked in before they are ranked together.
SALTS = 64
SMOOTHING = 0.05
#: Parts of a format's strings, each measured by an automaton of the others.
FOLDS = 4
#: A candidate must reach the mean of what labelled strings so measured gain by a character, less so many of their deviations.
DEVIATIONS = 2.0
#: What a candidate with digits or marks must gain in all over the background: odds of ten thousand to one.
EVIDENCE = math.log(1e4)
#: Of words of prose this share may pass for a credential of letters alone, or of no format.
FALSE_WORDS = 1e-7
#: The characters of a candidate, and the end.
ALPHABET = 69
CACHE_STRINGS = 400_000
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

_CLASS = np.zeros(256, bool)
_CLASS[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"]] = True


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind's number, end, start of the value), leftmost and non-overlapping within a kind, by start and then kind."""
    found = [(m.start(), 0, m.end(), m.start(1)) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= ASSIGN_LENGTH]
    found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


_BITS = {c: 1 << (0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 + "+/_.=-".index(c)) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"}
_PROSE_BITS = _BITS["a"] | _BITS["A"] | _BITS["-"] | _BITS["."]


def shape(string: str) -> int:
    """A format: which classes of characters a string has (lower case, upper case, digits, each mark), and its length."""
    classes = 0
    for c in set(string):
        classes |= _BITS[c]
    return len(string) << 9 | classes


def like_prose(form: int) -> bool:
    return not form & 511 & ~_PROSE_BITS


def core(run: str) -> str:
    """A run without the full stops that end a sentence."""
    return run.rstrip(".")


def candidates(text: str, taken: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """The places of all candidates, without full stops at their ends, but for those that lie within a base span: these come in order,
    and both are walked once."""
    out, i, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        start, end = m.start(), m.start() + len(core(m.group()))
        while i < len(taken) and taken[i][0] <= start:
            reach = max(reach, taken[i][2])
            i += 1
        if end > reach and end - start >= ASSIGN_LENGTH:
            out.append((start, end))
    return out


def runs(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The candidates of all rows, and the row of each: every other byte is taken for a space."""
    data, offsets = arrays.text_bytes(texts)
    masked = np.where(_CLASS[data], data, np.uint8(0x20))
    words, at = arrays.split_words(pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(masked.tobytes())))
    long = pc.greater_equal(pc.binary_length(words), ASSIGN_LENGTH)
    return words.filter(long), arrays.row_of(at)[long.to_numpy(zero_copy_only=False)]


def labelled(df: DataFrame, text: str, sample: int = SAMPLE) -> DataFrame:
    """kind, form, value, key: the credentials that the base patterns label; the words of the texts that have some as `word`; runs of all
    texts that are neither as `other`, of each slice and shape those `sample` with the smallest keys. form is the shape, 0 for words;
    key is a hash."""

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrays.slices(batch, "text"):
                texts = arrays.plain(part.column(0))
                seen = set()
                for row in texts.filter(pc.match_substring_regex(texts, MAYBE)).to_pylist():
                    if spans := base_spans(row):
                        seen.update((KINDS[k], core(row[v:e])) for _, k, e, v in spans)
                        seen.update((WORD, m.group()) for m in PROSE.finditer(row) if len(m.group()) >= ASSIGN_LENGTH)
                seen = {(k, v) for k, v in seen if len(v) >= ASSIGN_LENGTH}
                known = {v for _, v in seen}
                distinct = runs(texts)[0].unique()
                distinct = distinct.filter(pc.and_(pc.match_substring_regex(distinct, NOT_PROSE), pc.invert(pc.match_substring_regex(distinct, MAYBE))))
                others = [v for v in dict.fromkeys(map(core, distinct.to_pylist())) if len(v) >= ASSIGN_LENGTH and v not in known]
                rows = [(k, 0 if k == WORD else shape(v), v) for k, v in [*seen, *((OTHER, v) for v in others)]]
                kinds, forms, got = zip(*rows, strict=True) if rows else ((), (), ())
                keys = arrays.hash_strings(pa.array(got, pa.string())).view(np.int64)
                found = pa.table({"kind": pa.array(kinds, pa.string()), "form": pa.array(forms, pa.int64()), "value": pa.array(got, pa.string()), "key": pa.array(keys)})
                yield from few(found, sample).to_batches()

    return df.select(F.col(text).cast("string").alias("text")).mapInArrow(values, "kind string, form long, value string, key long")


def few(found: pa.Table, sample: int) -> pa.Table:
    """All rows but those of `other` that are beyond the `sample` smallest keys of their shape."""
    order = np.lexsort((found.column("key").to_numpy(), found.column("form").to_numpy()))
    found = found.take(pa.array(order))
    other = pc.equal(found.column("kind"), OTHER).to_numpy()
    forms = found.column("form").to_numpy()[other]
    rank = np.arange(len(forms)) - np.searchsorted(forms, forms)
    keep = ~other
    keep[np.flatnonzero(other)[rank < sample]] = True
    return found.filter(pa.array(keep))


def prefix_tree(strings: list[str]) -> tuple[list[dict[str, int]], list[dict[str, int]], list[int]]:
    """Children, their counts, and ends, of each state of the frequency prefix tree."""
    go: list[dict[str, int]] = [{}]
    n: list[dict[str, int]] = [{}]
    end = [0]
    for s in strings:
        at = 0
        for c in s:
            if c not in go[at]:
                go[at][c] = len(go)
                go.append({})
                n.append({})
                end.append(0)
            n[at][c] = n[at].get(c, 0) + 1
            at = go[at][c]
        end[at] += 1
    return go, n, end


def infer(strings: list[str], alpha: float = 0.05) -> list[list]:
    """ALERGIA over a prefix tree: a blue state joins the first red state whose end and outgoing frequencies differ by no more
    than the Hoeffding bound at alpha, recursively; else it turns red. Returns [transitions {char: [state, count]}, ends] by state."""
    go, n, end = prefix_tree(sorted(strings))
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def total(q: int) -> int:
        return end[q] + sum(n[q].values())

    def far(a: int, na: int, b: int, nb: int) -> bool:
        return na > 0 and nb > 0 and abs(a / na - b / nb) > bound * (1 / math.sqrt(na) + 1 / math.sqrt(nb))

    def compatible(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            p, q = todo.pop()
            np_, nq = total(p), total(q)
            if far(end[p], np_, end[q], nq):
                return False
            for c in n[p].keys() | n[q].keys():
                if far(n[p].get(c, 0), np_, n[q].get(c, 0), nq):
                    return False
                if c in go[p] and c in go[q] and go[p][c] != go[q][c]:
                    todo.append((go[p][c], go[q][c]))
        return True

    def fold(into: int, tree: int) -> None:
        todo = [(into, tree)]
        while todo:
            p, q = todo.pop()
            end[p] += end[q]
            for c, k in n[q].items():
                n[p][c] = n[p].get(c, 0) + k
                if c in go[p]:
                    todo.append((go[p][c], go[q][c]))
                else:
                    go[p][c] = go[q][c]

    red, known = [0], {0}
    while blue := next(((p, c) for p in red for c in sorted(go[p]) if go[p][c] not in known), None):
        parent, char = blue
        q = go[parent][char]
        if (r := next((r for r in red if compatible(r, q)), None)) is None:
            red.append(q)
            known.add(q)
        else:
            go[parent][char] = r
            fold(r, q)
    number = {q: i for i, q in enumerate(red)}
    return [[{c: [number[go[q][c]], n[q][c]] for c in sorted(go[q])}, end[q]] for q in red]


class Scorer:
    """Log probabilities of whole strings under one automaton: an unseen character keeps the state and costs a smoothed share."""

    def __init__(self, automaton: list[list]):
        self.moves, self.miss, self.ends = [], [], []
        for moves, ends in automaton:
            whole = ends + sum(k for _, k in moves.values()) + SMOOTHING * ALPHABET
            self.moves.append({c: (to, math.log((k + SMOOTHING) / whole)) for c, (to, k) in moves.items()})
            self.miss.append(math.log(SMOOTHING / whole))
            self.ends.append(math.log((ends + SMOOTHING) / whole))

    def __call__(self, string: str) -> float:
        state, total = 0, 0.0
        for c in string:
            step = self.moves[state].get(c)
            if step is None:
                total += self.miss[state]
            else:
                state = step[0]
                total += step[1]
        return total + self.ends[state]


class Judge:
    """Whether a string, without full stops at its end, is a secret by a model of train(); distinct strings are scored once while there are few."""

    def __init__(self, model: dict):
        self.backgrounds = [Scorer(a) for a in model["backgrounds"]]
        self.formats: dict[int, list[tuple]] = {}
        self.rest: list[tuple] = []
        for f in model["formats"]:
            entry = (Scorer(f["automaton"]), f["cutoff"], f["least"], f["even"])
            (self.formats.setdefault(f["form"], []) if f["form"] else self.rest).append(entry)
        self.lengths = {form >> 9 for form in self.formats}
        self.known: dict[str, bool] = {}

    def __call__(self, run: str) -> bool:
        string = core(run)
        if len(string) < ASSIGN_LENGTH or not (self.rest or len(string) in self.lengths):
            return False
        says = self.known.get(string)
        if says is None:
            if len(self.known) >= CACHE_STRINGS:
                self.known.clear()
            says = self.known[string] = self._passes(string)
        return says

    def _passes(self, string: str) -> bool:
        ways = [*self.formats.get(shape(string), ()), *self.rest]
        if not ways:
            return False
        back = max(b(string) for b in self.backgrounds)
        return any(gain >= least and gain / (len(string) + 1) >= cutoff for gain, cutoff, least in ((own(string) - (max(back, evenly(string)) if even else back), c, x) for own, c, x, even in ways))


def evenly(string: str) -> float:
    """Log probability of a string all of whose characters are as likely."""
    return -math.log(ALPHABET) * (len(string) + 1)


def train(df: DataFrame, text: str = "text", sample: int = SAMPLE, words: int = WORDS) -> dict:
    """Automata of all formats, fitted on the `sample` distinct labelled strings of each format with the smallest hashes, with limits.

    A format is a kind of label and a shape: the classes of characters and the length. Formats with fewer than LEAST_STRINGS strings
    are taken together as the rest of their kind, which fits strings of any shape; if that has too few, nothing is learned from it.
    A candidate is scored by the automata of its own shape and by those of the rests. It is a secret if its log likelihood exceeds the
    background's enough: by a character, within DEVIATIONS of what labelled strings reach under an automaton that was inferred without
    them (wider the fewer they are), and in all by EVIDENCE. The background is the likeliest of an automaton of words of prose and one of
    unlabelled runs with digits or marks, of the whole corpus, whose shape no labelled string has; so unlabelled credentials of a
    labelled shape, however many, don't count as background. For formats of letters alone, which words can have, and for the
    rests, an even distribution over the alphabet is background too, and the gain must exceed what all but FALSE_WORDS of the words of
    prose reach, read from `words` held-out words by the exponential tail of their last tenth: short strings of letters aren't found.

    Full stops at the end of a string are left out. Null texts teach nothing; repeated strings count once. The driver sees automata, of
    which there are as many as shapes with LEAST_STRINGS labelled strings, and one number for each string of the samples.
    """
    order = ["key", "value"]
    salted = labelled(df, text, sample).distinct().withColumn("group", F.col("form")).withColumn("salt", F.pmod("key", F.lit(SALTS)))
    most = F.when(F.col("kind") == WORD, words).otherwise(sample)
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("kind", "group", "salt").orderBy(*order))).filter(F.col("rank") <= most)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("kind", "group").orderBy(*order))).filter(F.col("rank") <= most)
    ranked = common.table(ranked.select("kind", "group", "key", "value"), "ranked")
    credential, columns = F.col("kind").isin(*KINDS), ["kind", "group", "key", "value"]
    sizes = ranked.filter(credential).groupBy("kind", "group").agg(F.count(F.lit(1)).alias("n"))
    formats = common.table(sizes.filter(F.col("n") >= LEAST_STRINGS).select("kind", "group"), "formats")
    own = ranked.filter(credential).join(F.broadcast(formats), ["kind", "group"], "left_semi")
    rest = ranked.filter(credential).join(F.broadcast(formats), ["kind", "group"], "left_anti")
    beside = ranked.filter(~credential).join(F.broadcast(sizes.select("group").distinct()), "group", "left_anti")  # no word has a shape
    every = own.select(*columns).unionByName(rest.unionByName(beside).withColumn("group", F.lit(0).cast("long")).select(*columns))
    placed = every.withColumn("rank", F.row_number().over(Window.partitionBy("kind", "group").orderBy(*order))).withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("kind", "group")))
    enough = ~credential | (F.col("size") >= LEAST_STRINGS)
    picked = common.table(placed.filter(enough & (F.col("rank") <= F.when(credential, sample).otherwise(words))).select("kind", "group", "value", (F.col("rank") % FOLDS).alias("fold")), "labelled")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows[["kind", "group", "left"]].iloc[:1].reset_index(drop=True)
        return first.assign(automaton=json.dumps(infer(sorted(rows["value"]))))

    parts = picked.select("kind", "group", "value", "fold", F.explode(F.array(*map(F.lit, range(-1, FOLDS)))).alias("left")).filter("fold <> left")
    fitted = {(r.kind, r.group, r.left): json.loads(r.automaton) for r in parts.groupBy("kind", "group", "left").applyInPandas(fit, "kind string, group long, left int, automaton string").collect()}
    nothing = [[{}, 0]]
    learned = sorted((k, g) for k, g, left in fitted if left == -1 and k in KINDS)
    backgrounds = [fitted.get((k, 0, -1), nothing) for k in (WORD, OTHER)]
    wordy = [x for x in learned if like_prose(x[1])]  # words can be of these formats, among them the rests

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = {x: Scorer(a) for x, a in fitted.items()}
        word, other = map(Scorer, backgrounds)
        for batch in batches:
            out = []
            for kind, form, value, fold in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == WORD:
                    back = max(scorers.get((WORD, 0, fold), word)(value), other(value), evenly(value))
                    out += [(k, g, False, scorers[k, g, -1](value) - back) for k, g in wordy]
                elif kind != OTHER:
                    back = max(word(value), other(value), *([evenly(value)] if like_prose(form) else []))
                    gain = scorers.get((kind, form, fold), scorers[kind, form, -1])(value) - back
                    out.append((kind, form, True, gain / (len(value) + 1)))
            yield pa.record_batch([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.bool_(), pa.float64()))], names=["kind", "group", "own", "gain"])

    gains: dict[tuple, list[float]] = {}
    for r in picked.mapInArrow(measure, "kind string, group long, own boolean, gain double").collect():
        gains.setdefault((r.kind, r.group, r.own), []).append(r.gain)
    model = {"backgrounds": backgrounds, "formats": []}
    for kind, form in learned:
        least = tail(sorted(gains.get((kind, form, False), [])), FALSE_WORDS) if like_prose(form) else EVIDENCE
        model["formats"].append({"kind": kind, "form": form, "automaton": fitted[kind, form, -1], "cutoff": lower(gains[kind, form, True]), "least": max(least, EVIDENCE), "even": like_prose(form)})
    return model


def lower(values: list[float]) -> float:
    """What all but a few more such values reach: DEVIATIONS below their mean, as a new value is spread about the mean of so many."""
    return float(np.mean(values) - DEVIATIONS * np.std(values, ddof=1) * math.sqrt(1 + 1 / len(values)))


def tail(values: list[float], share: float) -> float:
    """What `share` of such values (sorted) exceed, by an exponential tail beyond their last tenth; without values nothing."""
    if not values:
        return 0.0
    last = values[len(values) - 1 - len(values) // 10 :]
    return max(last[-1], last[0] + sum(x - last[0] for x in last) / len(last) * math.log(0.1 / share))


def spans_of(judge: Judge, text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base spans and of the candidates that the automata accept, by start and then kind."""
    base = base_spans(text)
    more = [(s, len(KINDS), e) for s, e in candidates(text, base) if judge(text[s:e])]
    return [([*KINDS, GRAMMAR][k], s, e) for s, k, e in sorted([*(x[:3] for x in base), *more])]


def suspects(judge: Judge, texts: pa.Array) -> np.ndarray:
    """Rows that can hold a base span or hold a candidate that passes for a secret: each distinct candidate is judged once."""
    rows = pc.match_substring_regex(texts, MAYBE).to_numpy(zero_copy_only=False).copy()
    found, row = runs(texts)
    index, distinct = arrays.encoded(found)
    passes = np.fromiter(map(judge, distinct.to_pylist()), bool, len(distinct))
    rows[row[passes[index]]] = True
    return np.flatnonzero(rows)


def scan(df: DataFrame, model: dict, text: str = "text", column: str = "secrets") -> DataFrame:
    """Add `column`: array of (kind, start, end) in code points, end exclusive, by start and then kind. Null texts have none.

    One pass over the whole texts, no shuffle. Other columns, repeated rows and row order stay as they are; a column named
    `column` is replaced.
    """
    common.need(df, text)
    rest = df.drop(column)
    names = [*rest.columns, column]
    place = names.index(text)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(model)
        for batch in batches:
            for part in arrays.slices(batch.rename_columns([str(i) for i in range(batch.num_columns)]), str(place)):
                texts = arrays.plain(part.column(place))
                rows = suspects(judge, texts)
                spans: list[list] = [[] for _ in range(len(texts))]
                for i, row in zip(rows, texts.take(pa.array(rows)).to_pylist(), strict=True):
                    spans[i] = [{"kind": k, "start": s, "end": e} for k, s, e in spans_of(judge, row)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(spans, SPAN_TYPE)], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    return rest.mapInArrow(find, f"{schema}, `{column}` array<struct<kind: string, start: long, end: long>>")


def redact(df: DataFrame, model: dict, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Replace every secret in `text` by `mark`; overlapping spans become one. Clean texts stay as they are, null stays null.

    One pass, no shuffle; other columns and repeated rows stay as they are.
    """
    common.need(df, text)
    names = list(df.columns)
    place = names.index(text)

    def cut(judge: Judge, whole: str) -> str:
        at, pieces = 0, []
        for _, start, end in spans_of(judge, whole):
            if start >= at:
                pieces += [whole[at:start], mark]
            at = max(at, end)
        return "".join(pieces) + whole[at:]

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(model)
        for batch in batches:
            for part in arrays.slices(batch.rename_columns([str(i) for i in range(batch.num_columns)]), str(place)):
                texts, columns = arrays.plain(part.column(place)), list(part.columns)
                rows = suspects(judge, texts)
                if len(rows):
                    mask = np.zeros(len(texts), bool)
                    mask[rows] = part.column(place).is_valid().to_numpy(zero_copy_only=False)[rows]
                    cleaned = pa.array([cut(judge, x) for x in texts.filter(pa.array(mask)).to_pylist()], pa.string())
                    columns[place] = pc.replace_with_mask(columns[place].cast(pa.string()), pa.array(mask), cleaned)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.mapInArrow(clean, df.schema)


def digest(spans: list, kinds: tuple[str, ...] | None = None) -> str:
    return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans if kinds is None or s["kind"] in kinds)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    found = scan(docs.select("doc_id", "text"), train(docs), column="found").drop("text")

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            spans = batch.column("found").to_pylist()
            counts = [pa.array([sum(s["kind"] == k for s in x) for x in spans], pa.int64()) for k in (*KINDS, GRAMMAR)]
            shas = pa.array([hashlib.sha256(digest(x, KINDS).encode()).hexdigest() if x else empty for x in spans], pa.string())
            names = ["doc_id", "n_assign", "n_access", "n_hex", "n_grammar", "base_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, shas, pa.array([digest(x) for x in spans], pa.string())], names=names)

    key = docs.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(summary, f"doc_id {key}, n_assign long, n_access long, n_hex long, n_grammar long, base_sha256 string, spans string")


QUERIES = {"op1_secret_scan": op1_secret_scan}
ORACLES: dict[str, str] = {}
