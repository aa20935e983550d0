"""Error rates of pairs, decisions and gates over results, and gates over corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.core import Tables, query
from loomwork.functions import metrics as m
from loomwork.functions.edits import operations_of
from loomwork.functions.text import ACCENTED, metric_normal

_NORMAL = r"trim(regexp_replace(regexp_replace(lower(nfc_normalize(coalesce({}, ''))), '[^\p{{L}}\p{{N}}_\s" + ACCENTED + r"]', ' ', 'g'), '\s+', ' ', 'g'))"
#: The oracle's character distance counts bytes, so letters beyond ASCII become capitals and marks, which normal texts don't have.
_BEYOND = ACCENTED + "ßçñæœ"
_LETTERS = "translate({}, '" + _BEYOND + "', '" + "ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&"[: len(_BEYOND)] + "')"
_BUCKET_NAMES = tuple(m.TRAINING_LEAST)
#: Word distance by the rows of its table: each reference word makes the next row from the one before.
_PAIRS = f"""
WITH turns AS (SELECT conv_id, turn, role, {_NORMAL.format('text')} AS said, lead(role) OVER w AS next_role, {_NORMAL.format('lead(text) OVER w')} AS next_said FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
pairs AS (SELECT conv_id, turn, said AS r, next_said AS h, list_filter(string_split(said, ' '), lambda x: x <> '') AS a, list_filter(string_split(next_said, ' '), lambda x: x <> '') AS b
  FROM turns WHERE role = 'user' AND next_role = 'assistant'),
edits AS (SELECT conv_id, turn, r, h, len(a) AS n_words, len(b) AS n_other, length(r) AS n_chars, levenshtein({_LETTERS.format('r')}, {_LETTERS.format('h')}) AS char_edits,
  list_last(list_reduce(list_transform(range(1, len(a) + 1), lambda i: [i]), lambda row, i:
    list_reduce(list_transform(range(1, len(b) + 1), lambda j: [j]), lambda done, j:
      list_append(done, least(row[j[1] + 1] + 1, list_last(done) + 1, row[j[1]] + CASE WHEN a[i[1]] = b[j[1]] THEN 0 ELSE 1 END)), i),
    range(0, len(b) + 1))) AS word_edits FROM pairs)"""
_SUMS = "CAST(count(*) AS BIGINT) AS n, round(sum(word_edits) * 100.0::DOUBLE / sum(n_words), 2) AS wer_pct, round(sum(char_edits) * 100.0::DOUBLE / sum(n_chars), 2) AS cer_pct FROM edits"


def pairs(t: Tables) -> DataFrame:
    """A user's turn as the reference and the assistant's answer as the recognised text, joined by conversation and place, both
    normalised for metrics: accented letters stay letters of their own."""
    own = Window.partitionBy("conv_id").orderBy("turn")
    said = t.conversations.select("conv_id", "turn", "role", metric_normal(F.col("text")).alias("r"))
    rows = said.select("*", F.lead("role").over(own).alias("next"), F.lead("r").over(own).alias("h"))
    return rows.filter("role = 'user' and next = 'assistant'").select("conv_id", "turn", "r", "h")


def edits(t: Tables) -> DataFrame:
    a, b = m.words(F.col("r")), m.words(F.col("h"))
    return pairs(t).select("conv_id", "turn", F.size(a).cast("long").alias("n_words"), F.length("r").cast("long").alias("n_chars"), m.word_edits(a, b).alias("word_edits"), m.char_edits(F.col("r"), F.col("h")).alias("char_edits"))


def _rates() -> list:
    rate = lambda e, n: F.round(F.sum(e) * 100.0 / F.sum(n), 2)
    return [F.count("*").alias("n"), rate("word_edits", "n_words").alias("wer_pct"), rate("char_edits", "n_chars").alias("cer_pct")]


@query("edit_distance", _PAIRS + " SELECT conv_id, turn, CAST(word_edits AS BIGINT) AS word_edits, CAST(char_edits AS BIGINT) AS char_edits FROM edits")
def edit_distance(t: Tables) -> DataFrame:
    return edits(t).select("conv_id", "turn", "word_edits", "char_edits")


@query("edit_operations", _PAIRS + " SELECT conv_id, turn, CAST(word_edits AS BIGINT) AS word_edits, CAST(n_words - n_other AS BIGINT) AS more_deleted FROM edits")
def edit_operations(t: Tables) -> DataFrame:
    """Edits by kind, of one alignment with the fewest of them: their sum, and deletions less insertions."""
    found = pairs(t).select("conv_id", "turn", operations_of(m.words(F.col("r")), m.words(F.col("h"))).alias("o"))
    return found.select("conv_id", "turn", (F.col("o.substitutions") + F.col("o.deletions") + F.col("o.insertions")).alias("word_edits"), (F.col("o.deletions") - F.col("o.insertions")).alias("more_deleted"))


@query("wer_overall", _PAIRS + " SELECT " + _SUMS)
def wer_overall(t: Tables) -> DataFrame:
    """Edits of the whole corpus over its words, not the mean of the rows' rates."""
    return edits(t).agg(*_rates())


@query("wer_by_bucket", _PAIRS + f" SELECT {list(_BUCKET_NAMES)}[CAST(conv_id % 5 AS INTEGER) + 1] AS bucket, {_SUMS} GROUP BY bucket ORDER BY bucket")
def wer_by_bucket(t: Tables) -> DataFrame:
    """Conversations fall into the buckets by their number."""
    bucket = F.get(F.array(*map(F.lit, _BUCKET_NAMES)), (F.col("conv_id") % 5).cast("int"))
    return edits(t).groupBy(bucket.alias("bucket")).agg(*_rates()).orderBy("bucket")


SLICES = ("twi", "english", "health", "code_switch", "noise")
_RUNS = f"""
WITH runs AS (SELECT l_orderkey * 8 + l_linenumber AS run, l_suppkey AS model, {list(SLICES)}[CAST((l_orderkey + l_linenumber) % 5 AS INTEGER) + 1] AS slice,
  CASE WHEN (l_orderkey * 8 + l_linenumber) % 5 <> 0 THEN round((l_discount + l_tax) * 200 + l_linenumber, 2) END AS wer_pct,
  CASE WHEN (l_orderkey * 8 + l_linenumber) % 10 <> 0 THEN round(l_discount * 4, 3) END AS val_wer, CAST(l_quantity * 4 AS BIGINT) AS n FROM lineitem),
rated AS (SELECT *, COALESCE(wer_pct, floor(val_wer * 10000 + 0.5) / 100) AS wer FROM runs)"""


def runs(t: Tables) -> DataFrame:
    """Result documents made from line items: supplier as model; every fifth lacks the percentage, every tenth the share too."""
    number = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    slice_ = F.get(F.array(*map(F.lit, SLICES)), ((F.col("l_orderkey") + F.col("l_linenumber")) % 5).cast("int"))
    rows = t.lineitem.select(
        number.alias("run"),
        F.col("l_suppkey").alias("model"),
        slice_.alias("slice"),
        F.when(number % 5 != 0, F.round((F.col("l_discount") + F.col("l_tax")) * 200 + F.col("l_linenumber"), 2)).alias("wer_pct"),
        F.when(number % 10 != 0, F.round(F.col("l_discount") * 4, 3)).alias("val_wer"),
        (F.col("l_quantity") * 4).cast("long").alias("n"),
    )
    return rows.withColumn("wer", m.percent(F.col("wer_pct"), F.col("val_wer")))


@query("metric_percent", _RUNS + " SELECT run, wer FROM rated")
def metric_percent(t: Tables) -> DataFrame:
    return runs(t).select("run", "wer")


@query("evidence_string", _RUNS + " SELECT run, concat_ws(', ', slice, CASE WHEN n <> 100 THEN 'n=' || n END, CASE WHEN wer IS NOT NULL THEN 'WER=' || printf('%.2f', wer) || '%' END) AS evidence FROM rated")
def evidence_string(t: Tables) -> DataFrame:
    """The known parts only; a sample of 100 stands for an unknown one."""
    parts = F.concat_ws(", ", "slice", F.when(F.col("n") != 100, F.concat(F.lit("n="), "n")), F.concat(F.lit("WER="), F.when(F.col("wer").isNotNull(), F.format_string("%.2f", "wer")), F.lit("%")))
    return runs(t).select("run", parts.alias("evidence"))


@query(
    "decision_class",
    _RUNS
    + f""" SELECT run, CASE WHEN wer IS NULL THEN 'UNKNOWN' WHEN run % 2 = 0 THEN CASE WHEN run % 3 = 0 AND wer <= {m.PROMOTE} THEN 'TRAIN_PROMOTE_CANDIDATE' WHEN run % 3 = 0 AND wer <= {m.HOLD} THEN 'TRAIN_HOLD_AND_VALIDATE' ELSE 'TRAIN_DO_NOT_PROMOTE' END
 WHEN slice = 'english' THEN 'ENGLISH_RETENTION_CHECK' WHEN wer <= {m.PROMOTE} THEN 'PROMOTE_CANDIDATE' WHEN wer <= {m.HOLD} THEN 'HOLD_AND_VALIDATE' ELSE 'DO_NOT_PROMOTE' END AS decision FROM rated""",
)
def decision_class(t: Tables) -> DataFrame:
    """Even runs are training runs, every third asks to be promoted."""
    number = F.col("run")
    return runs(t).select("run", m.decision(F.col("wer"), number % 2 == 0, number % 3 == 0, F.col("slice") == "english").alias("decision"))


GATES = ("twi", "english", "health", "code_switch", "noise", "card")
_GATES = (
    _RUNS
    + f""", best AS (SELECT model, slice, min(wer) AS wer, arg_min(n, {{'w': wer, 'r': run}}) AS n FROM rated WHERE wer IS NOT NULL GROUP BY model, slice),
base AS (SELECT wer AS base FROM best WHERE model = 1 AND slice = 'english'), models AS (SELECT model, bool_or(run % 7 = 0) AS card FROM runs GROUP BY model),
audited AS (SELECT o.model, o.card, t.wer AS twi, t.n AS twi_n, e.wer AS english, (SELECT base FROM base) AS base, h.wer AS health, c.wer AS code_switch, p.wer AS noise FROM models o
 LEFT JOIN best t ON t.model = o.model AND t.slice = 'twi' LEFT JOIN best e ON e.model = o.model AND e.slice = 'english' LEFT JOIN best h ON h.model = o.model AND h.slice = 'health'
 LEFT JOIN best c ON c.model = o.model AND c.slice = 'code_switch' LEFT JOIN best p ON p.model = o.model AND p.slice = 'noise'),
gates AS (SELECT model, CASE WHEN twi IS NULL THEN 'MISSING' WHEN twi <= {m.PROMOTE} AND twi_n >= {m.LEAST_SAMPLES} THEN 'PASS' ELSE 'FAIL' END AS twi,
 CASE WHEN english IS NULL THEN 'MISSING' WHEN english <= {m.ENGLISH_MOST} AND english - base <= {m.ENGLISH_DELTA} THEN 'PASS' ELSE 'FAIL' END AS english,
 CASE WHEN health IS NULL THEN 'MISSING' WHEN health <= {m.HEALTH_MOST} THEN 'PASS' ELSE 'FAIL' END AS health,
 CASE WHEN code_switch IS NULL THEN 'MISSING' WHEN code_switch <= {m.SWITCH_MOST} THEN 'PASS' ELSE 'FAIL' END AS code_switch,
 CASE WHEN noise IS NULL THEN 'MISSING' WHEN noise <= {m.NOISE_MOST} THEN 'PASS' ELSE 'FAIL' END AS noise, CASE WHEN card THEN 'PASS' ELSE 'MISSING' END AS card FROM audited)"""
)


def gates(t: Tables) -> DataFrame:
    """Six gates of each model, each from the run with the lowest rate of its slice alone; every seventh run shows a card."""
    rows = runs(t)
    best = {s: F.min_by(F.struct("wer", "n"), F.when(F.col("wer").isNotNull() & (F.col("slice") == s), F.struct("wer", "run"))) for s in SLICES}
    audited = rows.groupBy("model").agg(*(c.alias(s) for s, c in best.items()), F.bool_or(F.col("run") % 7 == 0).alias("card"))
    base = rows.filter("model = 1 and slice = 'english'").agg(F.min("wer")).scalar()
    wer = {s: F.col(f"{s}.wer") for s in SLICES}
    return audited.select(
        "model",
        m.gate(wer["twi"], (wer["twi"] <= m.PROMOTE) & (F.col("twi.n") >= m.LEAST_SAMPLES)).alias("twi"),
        m.gate(wer["english"], (wer["english"] <= m.ENGLISH_MOST) & (wer["english"] - base <= m.ENGLISH_DELTA)).alias("english"),
        m.gate(wer["health"], wer["health"] <= m.HEALTH_MOST).alias("health"),
        m.gate(wer["code_switch"], wer["code_switch"] <= m.SWITCH_MOST).alias("code_switch"),
        m.gate(wer["noise"], wer["noise"] <= m.NOISE_MOST).alias("noise"),
        F.when(F.col("card"), "PASS").otherwise("MISSING").alias("card"),
    )


@query("promotion_gates", _GATES + " SELECT * FROM gates")
def promotion_gates(t: Tables) -> DataFrame:
    return gates(t)


@query("gate_summary", _GATES + " SELECT model, concat_ws(',', " + ", ".join(f"CASE WHEN {g} <> 'PASS' THEN '{g}:' || {g} END" for g in GATES) + ") AS blockers, CASE WHEN " + " AND ".join(f"{g} = 'PASS'" for g in GATES) + " THEN 'YES' ELSE 'NO' END AS promote FROM gates")
def gate_summary(t: Tables) -> DataFrame:
    blockers = F.filter(F.array(*(F.when(F.col(g) != "PASS", F.concat(F.lit(g + ":"), g)) for g in GATES)), lambda x: x.isNotNull())
    return gates(t).select("model", F.array_join(blockers, ",").alias("blockers"), F.when(F.size(blockers) == 0, "YES").otherwise("NO").alias("promote"))


LANGUAGE_BUCKETS = {"en": "health_twi", "fr": "commerce_twi", "de": "codeswitch_tw_en", "es": "health_en"}
_CASES = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LANGUAGE_BUCKETS.items()) + " ELSE 'phone_noise' END"
_CORPUS = f"WITH c AS (SELECT d.doc_id, {_CASES} AS bucket, d.source, d.doc_id % 3 = 0 AS holdout, COALESCE(l.toxic = 1, FALSE) AS synthetic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id), counts AS (SELECT bucket, count(*) AS n FROM c GROUP BY bucket)"


def corpus(t: Tables) -> DataFrame:
    """Documents as rows of a corpus: languages as buckets, sources as speakers, every third held out, toxic ones as synthetic."""
    bucket = F.coalesce(F.create_map(*(F.lit(x) for p in LANGUAGE_BUCKETS.items() for x in p))[F.col("lang")], F.lit("phone_noise"))
    rows = t.documents.select("doc_id", bucket.alias("bucket"), "source", (F.col("doc_id") % 3 == 0).alias("holdout"))
    return rows.join(t.labels.select("doc_id", "toxic"), "doc_id", "left").withColumn("synthetic", F.coalesce(F.col("toxic") == 1, F.lit(False)))


def bucket_counts(t: Tables, least: dict[str, int]) -> DataFrame:
    wanted = t.spark.createDataFrame(list(least.items()), "bucket string, minimum int")
    counts = corpus(t).groupBy("bucket").agg(F.count("*").alias("n"))
    return wanted.join(counts, "bucket", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("ready", F.col("n") >= F.col("minimum"))


def _least(values: dict[str, int]) -> str:
    return "(VALUES " + ", ".join(f"('{k}', {v})" for k, v in values.items()) + ") b(bucket, minimum)"


@query("manifest_gate", _CORPUS + f" SELECT b.bucket, b.minimum, CAST(COALESCE(c.n, 0) AS BIGINT) AS n, COALESCE(c.n, 0) >= b.minimum AS ready FROM {_least(m.EVALUATION_LEAST)} LEFT JOIN counts c ON b.bucket = c.bucket")
def manifest_gate(t: Tables) -> DataFrame:
    return bucket_counts(t, m.EVALUATION_LEAST).select("bucket", "minimum", "n", "ready")


@query(
    "corpus_gate",
    _CORPUS
    + f""" SELECT (SELECT bool_and(COALESCE(c.n, 0) >= b.minimum) FROM {_least(m.TRAINING_LEAST)} LEFT JOIN counts c ON b.bucket = c.bucket) AS buckets_ready,
 count(DISTINCT source) >= {m.LEAST_SPEAKERS} AS speakers_ready, count(*) FILTER (WHERE holdout) >= {m.LEAST_HOLDOUT} AS holdout_ready, NOT bool_or(holdout AND synthetic) AS no_synthetic_holdout FROM c""",
)
def corpus_gate(t: Tables) -> DataFrame:
    """A corpus is ready if all four hold."""
    buckets = bucket_counts(t, m.TRAINING_LEAST).agg(F.bool_and("ready")).scalar()
    facts = corpus(t).agg(
        (F.countDistinct("source") >= m.LEAST_SPEAKERS).alias("speakers_ready"),
        (F.count_if("holdout") >= m.LEAST_HOLDOUT).alias("holdout_ready"),
        (~F.bool_or(F.col("holdout") & F.col("synthetic"))).alias("no_synthetic_holdout"),
    )
    return facts.select(buckets.alias("buckets_ready"), "speakers_ready", "holdout_ready", "no_synthetic_holdout")


@query(
    "row_problems",
    """
WITH p AS (SELECT doc_id, 'problem' AS kind, 'id is too short' AS message FROM documents WHERE length(CAST(doc_id AS VARCHAR)) < 3
UNION ALL SELECT doc_id, 'problem', 'language isn''t known' FROM documents WHERE lang IS NULL OR lang NOT IN ('en', 'fr', 'de')
UNION ALL SELECT doc_id, 'problem', 'duration is out of range' FROM documents WHERE n_chars / 1000.0 NOT BETWEEN 0.5 AND 28
UNION ALL SELECT d.doc_id, 'warning', 'no label' FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL)
SELECT doc_id, kind, message FROM p
""",
)
def row_problems(t: Tables) -> DataFrame:
    """Every reason against a row: problems stop it, warnings don't."""
    rows = t.documents.select("doc_id", "lang", "n_chars").join(t.labels.select("doc_id", F.lit(True).alias("labelled")), "doc_id", "left")
    found = lambda kind, message, bad: F.when(bad, F.struct(F.lit(kind).alias("kind"), F.lit(message).alias("message")))
    reasons = F.array(
        found("problem", "id is too short", F.length(F.col("doc_id").cast("string")) < 3),
        found("problem", "language isn't known", ~F.coalesce(F.col("lang").isin("en", "fr", "de"), F.lit(False))),
        found("problem", "duration is out of range", ~(F.col("n_chars") / 1000).between(0.5, 28.0)),
        found("warning", "no label", F.col("labelled").isNull()),
    )
    return rows.select("doc_id", F.explode(F.filter(reasons, lambda r: r.isNotNull())).alias("r")).select("doc_id", "r.kind", "r.message")
