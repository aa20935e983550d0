"""Dates, amounts, vectors, digests and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.core import Tables, query
from loomwork.functions import metrics, vectors
from loomwork.plans.filters import CLOCK

SECRET = "pepper"


@query(
    "deadline",
    f"SELECT event_id, ts + INTERVAL 10 MINUTE AS code_until, ts + INTERVAL 24 HOUR AS quota_until, ts + INTERVAL 24 HOUR <= TIMESTAMP '{CLOCK}' AS quota_reset, ts + INTERVAL 10 MINUTE > TIMESTAMP '{CLOCK}' AS code_valid FROM events",
)
def deadline(t: Tables) -> DataFrame:
    """A quota ends at its deadline, a code is valid before it."""
    clock = F.lit(CLOCK).cast("timestamp_ntz")
    code, quota = F.col("ts") + F.expr("INTERVAL 10 MINUTES"), F.col("ts") + F.expr("INTERVAL 24 HOURS")
    return t.events.select("event_id", code.alias("code_until"), quota.alias("quota_until"), (quota <= clock).alias("quota_reset"), (code > clock).alias("code_valid"))


@query("stage_latency", "SELECT event_id, epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS elapsed_ms FROM events")
def stage_latency(t: Tables) -> DataFrame:
    """Milliseconds since the user's event before."""
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    return t.events.select("event_id", (at - F.lag(at).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).alias("elapsed_ms"))


@query("minutes_format", "SELECT l_orderkey, printf('%.1f', floor(sum(l_quantity) / 60 * 10 + 0.5) / 10) || ' min' AS minutes FROM lineitem GROUP BY l_orderkey")
def minutes_format(t: Tables) -> DataFrame:
    """Quantities as seconds; halves go up."""
    minutes = F.floor(F.sum("l_quantity") / 60 * 10 + 0.5) / 10
    return t.lineitem.groupBy("l_orderkey").agg(F.concat(F.format_string("%.1f", minutes), F.lit(" min")).alias("minutes"))


@query("minor_units", "SELECT o_orderkey, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS minor FROM orders")
def minor_units(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.floor(F.col("o_totalprice") * 100 + 0.5).alias("minor"))


_PAIRS = "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT a.vec_id, list_cosine_similarity(a.v, b.v) AS score FROM v a JOIN v b ON b.vec_id = a.vec_id + 1)"


def _next_scores(t: Tables) -> DataFrame:
    """Every vector with the one of the next key."""
    rows = t.embeddings.select("vec_id", vectors.doubles(F.col("embedding")).alias("v"))
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return rows.join(after, "vec_id").select("vec_id", vectors.cosine(F.col("v"), F.col("w")).alias("score"))


@query("cosine_pairs", _PAIRS + " SELECT vec_id, round(score, 6) AS score FROM p")
def cosine_pairs(t: Tables) -> DataFrame:
    return _next_scores(t).select("vec_id", F.round("score", 6).alias("score"))


@query("verify_threshold", _PAIRS + " SELECT vec_id, round(score, 4) AS score, score >= CASE WHEN vec_id % 2 = 0 THEN 0.7 ELSE 0.82 END AS accepted FROM p")
def verify_threshold(t: Tables) -> DataFrame:
    """Odd keys have a threshold of their own, the others that by default."""
    stored = F.when(F.col("vec_id") % 2 == 1, 0.82)
    return _next_scores(t).select("vec_id", F.round("score", 4).alias("score"), (F.col("score") >= F.coalesce(stored, F.lit(0.7))).alias("accepted"))


_FLAT = "WITH f AS (SELECT vec_id, label, CAST(UNNEST(embedding) AS DOUBLE) AS x, UNNEST(range(len(embedding))) AS i FROM embeddings)"


def _flat(df: DataFrame, v, *keep: str) -> DataFrame:
    return df.select(*keep, F.posexplode(v).alias("i", "x")).select(*keep, F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("l2_normalize", _FLAT + " SELECT vec_id, i, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 6) AS x FROM f")
def l2_normalize(t: Tables) -> DataFrame:
    return _flat(t.embeddings, vectors.unit(vectors.doubles(F.col("embedding"))), "vec_id")


@query("mean_pool_by_label", _FLAT + ", m AS (SELECT label, i, avg(x) AS x FROM f GROUP BY label, i) SELECT label, i, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM m")
def mean_pool_by_label(t: Tables) -> DataFrame:
    """The mean of each label's vectors, by component, as a vector of length 1."""
    parts = t.embeddings.select("label", F.posexplode(vectors.doubles(F.col("embedding"))).alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg("x").alias("x"))
    whole = means.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))  # as many as a vector has components
    return _flat(whole, vectors.unit(F.col("v")), "label")


@query(
    "resample_linear",
    _FLAT
    + """, n AS (SELECT vec_id, CAST(greatest(floor(count(*) / 1.5), 1) AS BIGINT) AS n, count(*) AS size FROM f GROUP BY vec_id),
g AS (SELECT vec_id, size, UNNEST(range(n)) AS i FROM n), p AS (SELECT vec_id, i, CAST(floor(i * 1.5) AS BIGINT) AS low, i * 1.5::DOUBLE - floor(i * 1.5) AS part, size FROM g)
SELECT p.vec_id, p.i, round(a.x * (1 - part) + b.x * part, 6) AS x FROM p JOIN f a ON a.vec_id = p.vec_id AND a.i = p.low JOIN f b ON b.vec_id = p.vec_id AND b.i = least(p.low + 1, p.size - 1)""",
)
def resample_linear(t: Tables) -> DataFrame:
    return _flat(t.embeddings, vectors.resampled(vectors.doubles(F.col("embedding")), 1.5), "vec_id")


@query("peak_normalize", _FLAT + " SELECT vec_id, i, round(x * least(0.95 / max(abs(x)) OVER (PARTITION BY vec_id), 1.5::DOUBLE), 6) AS x FROM f")
def peak_normalize(t: Tables) -> DataFrame:
    return _flat(t.embeddings, vectors.peak_normal(vectors.doubles(F.col("embedding"))), "vec_id")


@query("vector_codec_roundtrip", "SELECT vec_id, CAST(4 * ceil(4 * len(embedding) / 3.0) AS INTEGER) AS n_chars, TRUE AS same FROM embeddings")
def vector_codec_roundtrip(t: Tables) -> DataFrame:
    coded = t.embeddings.select("vec_id", "embedding", vectors.to_base64(F.col("embedding")).alias("b64"))
    return coded.select("vec_id", F.length("b64").alias("n_chars"), (vectors.from_base64(F.col("b64")) == F.col("embedding")).alias("same"))


@query("content_hash", f"SELECT doc_id, sha256(text) AS sha256, sha256(lower(source) || ':' || doc_id || ':{SECRET}') AS code_hash FROM documents")
def content_hash(t: Tables) -> DataFrame:
    keyed = F.sha2(F.concat_ws(":", F.lower("source"), "doc_id", F.lit(SECRET)), 256)
    return t.documents.select("doc_id", F.sha2("text", 256).alias("sha256"), keyed.alias("code_hash"))


@query("signed_payloads")
def signed_payloads(t: Tables) -> DataFrame:
    """Rows only: the oracle has no HMAC. The function is tested against the standard library."""
    return t.events.select("event_id", metrics.hmac_sha512(SECRET, F.col("props")).alias("signature"))


@query("wav_duration", "SELECT p_partkey, p_size * 320 / 32000.0::DOUBLE AS seconds FROM part")
def wav_duration(t: Tables) -> DataFrame:
    """Headers of wave files made from parts, with a part of odd length before the samples: the size gives the samples' bytes."""
    little = lambda n: F.concat(*(F.substring(F.lpad(F.hex(n), 8, "0"), i, 2) for i in (7, 5, 3, 1)))
    raw = lambda s: F.lit(s.encode().hex())
    odd = F.col("p_partkey") % 7
    note = F.concat(raw("LIST"), little(odd), F.repeat(F.lit("00"), (odd + odd % 2).cast("int")))
    form = F.concat(raw("fmt "), little(F.lit(16)), F.lit("01000100"), little(F.lit(16000)), little(F.lit(32000)), F.lit("02001000"))
    header = F.unhex(F.concat(raw("RIFF"), little(F.lit(36)), raw("WAVE"), note, form, raw("data"), little(F.col("p_size") * 320)))
    return t.spread(t.part.select("p_partkey", "p_size")).select("p_partkey", vectors.wav_seconds(header).alias("seconds"))


@query("speaker_features")
def speaker_features(t: Tables) -> DataFrame:
    """Rows only: vectors, repeated twenty times, as samples. The function is tested against a plain loop."""
    samples = F.flatten(F.array_repeat("embedding", 20))
    return t.embeddings.select("vec_id", vectors.speaker_features(samples).alias("features")).select("vec_id", F.posexplode("features").alias("i", "x"))


_SAMPLES = "SELECT vec_id, list_transform(range(0, 20 * len(embedding)), lambda i: CAST(embedding[i % len(embedding) + 1] AS DOUBLE)) AS v FROM embeddings"


@query(
    "frame_energy",
    f"""
WITH s AS ({_SAMPLES}),
f AS (SELECT vec_id, CAST(UNNEST(range(0, (len(v) - 400 + 159) // 160)) AS INTEGER) AS frame, v FROM s WHERE len(v) > 400),
g AS (SELECT vec_id, frame, list_slice(v, frame * 160 + 1, frame * 160 + 400) AS x FROM f),
b AS (SELECT *, UNNEST(range(0, 12)) AS band FROM g)
SELECT vec_id, frame, CAST(band AS INTEGER) AS band, round(sqrt(list_sum(list_transform(x, lambda y: y * y)) / 400), 6) AS rms,
       CAST(len(list_filter(range(2, 401), lambda i: (x[i] >= 0) <> (x[i - 1] >= 0))) AS BIGINT) AS crossings,
       round(list_sum(list_transform(list_slice(x, band * 33 + 1, band * 33 + 33), lambda y: y * y)), 6) AS energy FROM b
""",
)
def frame_energy(t: Tables) -> DataFrame:
    """Vectors, repeated twenty times, as samples: each frame's loudness and crossings of zero beside the energy of each of its bands."""
    samples = F.flatten(F.array_repeat("embedding", 20))
    frames = t.embeddings.select("vec_id", F.posexplode(vectors.frame_measures(samples)).alias("frame", "m"))
    return frames.select("vec_id", "frame", F.round("m.rms", 6).alias("rms"), "m.crossings", F.posexplode("m.bands").alias("band", "e")).select("vec_id", "frame", "band", "rms", "crossings", F.round("e", 6).alias("energy"))


def _draw(kind: str, k: str, i: int) -> str:
    return f"('0x' || substr(md5('mask:' || vec_id || ':{kind}:' || {k}), {1 + 8 * i}, 8))::BIGINT"


@query(
    "masked_blocks",
    f"""
WITH s AS ({_SAMPLES}),
cells AS (SELECT vec_id, UNNEST(range(0, len(v))) AS i, UNNEST(v) AS x FROM s),
grid AS (SELECT vec_id, i // 80 AS band, i % 80 AS at, x FROM cells),
size AS (SELECT vec_id, len(v) // 80 AS bands FROM s),
ts AS (SELECT vec_id, {_draw('t', 'k', 0)} % 10 + 1 AS n, {_draw('t', 'k', 1)} AS h FROM (SELECT vec_id, UNNEST(range(0, greatest(1, CAST(floor(0.05 * 80 / 10) AS BIGINT)))) AS k FROM size)),
bs AS (SELECT vec_id, bands, {_draw('b', 'k', 0)} % 16 + 1 AS n, {_draw('b', 'k', 1)} AS h FROM (SELECT vec_id, bands, UNNEST(range(0, greatest(1, CAST(floor(0.05 * bands / 16) AS BIGINT)))) AS k FROM size)),
gone AS (
  SELECT g.*, EXISTS (SELECT 1 FROM ts WHERE ts.vec_id = g.vec_id AND n < 80 AND g.at >= h % (80 - n + 1) AND g.at < h % (80 - n + 1) + n)
    OR EXISTS (SELECT 1 FROM bs WHERE bs.vec_id = g.vec_id AND n < bands AND g.band >= h % (bands - n + 1) AND g.band < h % (bands - n + 1) + n) AS masked FROM grid g
)
SELECT vec_id, CAST(band AS INTEGER) AS band, CAST(count(*) FILTER (masked) AS BIGINT) AS zeros, round(sum(CASE WHEN masked THEN 0 ELSE x END), 6) AS rest FROM gone GROUP BY vec_id, band
""",
)
def masked_blocks(t: Tables) -> DataFrame:
    """Vectors, repeated twenty times and laid out in bands of 80 values, with blocks of time and of bands masked. A cell counts as
    zero if masking made it so."""
    samples = F.flatten(F.array_repeat(vectors.doubles(F.col("embedding")), 20))
    grid = F.transform(F.sequence(F.lit(0), F.floor(F.size("v") / 80).cast("int") - 1), lambda i: F.slice("v", i * 80 + 1, F.lit(80)))
    rows = t.embeddings.select("vec_id", samples.alias("v")).select("vec_id", grid.alias("g"))
    both = rows.select("vec_id", "g", vectors.masked(F.col("g"), F.col("vec_id")).alias("m"))
    each = both.select("vec_id", F.posexplode(F.arrays_zip("g", "m")).alias("band", "r"))
    zeros = F.size(F.filter(F.zip_with("r.g", "r.m", lambda x, y: x != y), lambda z: z))
    return each.select("vec_id", "band", zeros.cast("long").alias("zeros"), F.round(F.aggregate("r.m", F.lit(0.0), lambda a, x: a + x), 6).alias("rest"))


@query("json_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, COALESCE(json_extract_string(props, '$.focus'), 'health') AS focus, json_type(props) = 'OBJECT' AS is_object FROM events")
def json_extract(t: Tables) -> DataFrame:
    """A property, another with a default, and whether the whole is an object."""
    return t.events.select(
        "event_id",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.coalesce(F.get_json_object("props", "$.focus"), F.lit("health")).alias("focus"),
        F.coalesce(F.schema_of_variant(F.try_parse_json("props")).startswith("OBJECT"), F.lit(False)).alias("is_object"),
    )


@query(
    "cache_usable",
    "SELECT doc_id, doc_id % 7 <> 0 AND lang IN ('en', 'fr') AND CASE WHEN lang = 'en' THEN source = 'src1' OR contains(source, '2') ELSE source = 'src1' END AS usable FROM documents WHERE lang IN ('en', 'fr') OR lang IS NOT NULL",
)
def cache_usable(t: Tables) -> DataFrame:
    """Languages stand for engines (en and fr are wanted), sources for models: src1 is wanted, and English takes its relatives (with a 2) too."""
    cached, engine, model = F.col("doc_id") % 7 != 0, F.col("lang"), F.col("source")
    fits = (model == "src1") | ((engine == "en") & model.contains("2"))
    return t.documents.filter("lang is not null").select("doc_id", (cached & engine.isin("en", "fr") & fits).alias("usable"))


@query("unique_key_check", "SELECT p_name, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def unique_key_check(t: Tables) -> DataFrame:
    """Names that aren't unique."""
    return t.part.groupBy("p_name").agg(F.count("*").alias("n")).filter("n > 1")
