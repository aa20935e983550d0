"""A word model of the documents' lines, and how well it predicts other lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.core import Tables, query
from loomwork.functions.text import corpus_words
from loomwork.operators import ngrams

_NORMAL = r"trim(regexp_replace(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def _discounts(name: str) -> str:
    """SQL for a table's three discounts, as a one-row table d_<name>."""
    ts = ", ".join(f"count(*) FILTER (n = {k})::DOUBLE AS t{k}" for k in range(1, 5))
    ds = [f"{k} - {k + 1} * (t1 / (t1 + 2 * t2)) * t{k + 1} / t{k}" for k in range(1, 4)]
    fits = "t1 > 0 AND t2 > 0 AND t3 > 0 AND t4 > 0 AND " + " AND ".join(f"{d} BETWEEN 0 AND {k}" for k, d in enumerate(ds, 1))
    return f"d_{name} AS (SELECT " + ", ".join(f"CASE WHEN {fits} THEN {d} ELSE {f}::DOUBLE END AS d{k}" for k, (d, f) in enumerate(zip(ds, ngrams.FALLBACK, strict=True), 1)) + f" FROM (SELECT {ts} FROM {name}))"


def _model(lines: str) -> str:
    """SQL for the model of the lines (column t), as a table model: ngram_order, a, b, c (the last words are null in low orders), p, back."""
    taken = "CASE n WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END"
    left = "(d1 * count(*) FILTER (n = 1) + d2 * count(*) FILTER (n = 2) + d3 * count(*) FILTER (n >= 3)) / sum(n)"
    return f"""
lines AS ({lines}),
words AS (SELECT list_concat(['<s>'], string_split(t, ' '), ['</s>']) AS w FROM lines WHERE t <> ''),
runs AS (SELECT UNNEST(list_transform(range(1, len(w) - 1), lambda i: [w[i], w[i + 1], w[i + 2]])) AS g FROM words),
tri AS (SELECT g[1] AS a, g[2] AS b, g[3] AS c, count(*) AS n FROM runs GROUP BY ALL),
bi AS (SELECT b AS a, c AS b, count(*) AS n FROM tri GROUP BY b, c UNION ALL SELECT a, b, CAST(sum(n) AS BIGINT) FROM tri WHERE a = '<s>' GROUP BY a, b),
uni AS (SELECT b AS a, count(*) AS n FROM bi GROUP BY b),
{_discounts('tri')}, {_discounts('bi')}, {_discounts('uni')},
c3 AS (SELECT a, b, sum(n) AS total, {left} AS back FROM tri, d_tri GROUP BY a, b, d1, d2, d3),
c2 AS (SELECT a, sum(n) AS total, {left} AS back FROM bi, d_bi GROUP BY a, d1, d2, d3),
c1 AS (SELECT sum(n) AS total, {left} AS back, count(*) + 1 AS size FROM uni, d_uni GROUP BY d1, d2, d3),
p1 AS (SELECT a, (n - {taken}) / total + back / size AS p FROM uni, d_uni, c1 UNION ALL SELECT '<unk>', back / size FROM c1 UNION ALL SELECT '<s>', 1 FROM c1),
p2 AS (SELECT x.a, x.b, (n - {taken}) / total + back * p1.p AS p FROM bi x JOIN c2 ON x.a = c2.a JOIN p1 ON x.b = p1.a, d_bi),
p3 AS (SELECT x.a, x.b, x.c, (n - {taken}) / total + back * p2.p AS p FROM tri x JOIN c3 ON x.a = c3.a AND x.b = c3.b JOIN p2 ON x.b = p2.a AND x.c = p2.b, d_tri),
model AS (
  SELECT 1 AS ngram_order, p1.a, NULL AS b, NULL AS c, p, coalesce(back, 1) AS back FROM p1 LEFT JOIN c2 ON p1.a = c2.a
  UNION ALL SELECT 2, p2.a, p2.b, NULL, p, coalesce(back, 1) FROM p2 LEFT JOIN c3 ON p2.a = c3.a AND p2.b = c3.b
  UNION ALL SELECT 3, a, b, c, p, NULL FROM p3
)"""


def _split(held_out: bool) -> str:
    which = "=" if held_out else "<>"
    return f"SELECT DISTINCT {_NORMAL.format('line')} AS t FROM (SELECT UNNEST(string_split(text, chr(10))) AS line FROM documents WHERE doc_id % 20 {which} 0)"


def _lines(documents: DataFrame) -> DataFrame:
    """w: the words of each different line, normalised; without words none."""
    lines = documents.select(F.explode(F.split("text", "\n")).alias("line")).select(corpus_words(F.col("line")).alias("t")).filter("t <> ''")
    return lines.distinct().select("t", F.split("t", " ").alias("w"))


def _codes(documents: DataFrame) -> DataFrame:
    """Codes of all words: without repeated lines texts would be shuffled twice."""
    return ngrams.codes(documents.select(F.explode(F.split(corpus_words(F.col("text")), " ")).alias("word")).filter("word <> ''"))


_EVERY = f"SELECT DISTINCT {_NORMAL.format('line')} AS t FROM (SELECT UNNEST(string_split(text, chr(10))) AS line FROM documents)"


@query("word_model", f"WITH {_model(_EVERY)} SELECT ngram_order, concat_ws(' ', a, b, c) AS gram, round(log10(p), 6) AS log10_p, round(log10(back), 6) AS log10_back FROM model")
def word_model(t: Tables) -> DataFrame:
    """The trigram model with modified Kneser-Ney smoothing, as ARPA files state it."""
    documents = t.spread(t.documents.select("text"))
    model = ngrams.kneser_ney(_lines(documents), "w", 3, t.cut, _codes(documents))
    return model.select(F.col("order").alias("ngram_order"), ngrams.gram(model).alias("gram"), F.round(F.log10("p"), 6).alias("log10_p"), F.round(F.log10("back"), 6).alias("log10_back"))


@query(
    "word_model_perplexity",
    f"""
WITH {_model(_split(False))},
held AS ({_split(True)}),
held_words AS (SELECT t, list_concat(['', '<s>'], string_split(t, ' '), ['</s>']) AS w FROM held WHERE t <> ''),
held_runs AS (SELECT t, UNNEST(list_transform(range(1, len(w) - 1), lambda i: [w[i], w[i + 1], w[i + 2]])) AS g FROM held_words),
looked AS (
  SELECT r.t, u.a IS NOT NULL AS is_known,
         coalesce(m3.p, coalesce(x3.back, 1) * coalesce(m2.p, coalesce(x2.back, 1) * coalesce(u.p, k.p))) AS p
  FROM held_runs r LEFT JOIN model m3 ON m3.ngram_order = 3 AND m3.a = g[1] AND m3.b = g[2] AND m3.c = g[3]
  LEFT JOIN model x3 ON x3.ngram_order = 2 AND x3.a = g[1] AND x3.b = g[2]
  LEFT JOIN model m2 ON m2.ngram_order = 2 AND m2.a = g[2] AND m2.b = g[3]
  LEFT JOIN model x2 ON x2.ngram_order = 1 AND x2.a = g[2]
  LEFT JOIN model u ON u.ngram_order = 1 AND u.a = g[3] AND g[3] <> '<s>'
  JOIN model k ON k.ngram_order = 1 AND k.a = '<unk>'
)
SELECT md5(t) AS line, CAST(count(*) AS BIGINT) AS n_words, CAST(count(*) FILTER (NOT is_known) AS BIGINT) AS n_unknown, round(pow(10, -sum(log10(p)) / count(*)), 3) AS perplexity FROM looked GROUP BY t
""",
)
def word_model_perplexity(t: Tables) -> DataFrame:
    """Perplexity of the lines of every twentieth document, by the model of all others."""
    taught = t.spread(t.documents.filter("doc_id % 20 <> 0").select("text"))
    held = _lines(t.spread(t.documents.filter("doc_id % 20 = 0").select("text"))).select(F.unhex(F.md5("t")).alias("id"), "w")
    scored = ngrams.score_by(held, "w", "id", _lines(taught), "w", 3, t.cut, _codes(taught))
    return scored.select(F.lower(F.hex("id")).alias("line"), "n_words", "n_unknown", F.round(F.pow(F.lit(10.0), -F.col("log10_p") / F.col("n_words")), 3).alias("perplexity"))
