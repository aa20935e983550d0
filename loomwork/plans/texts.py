"""Normalisation, tokens, labels, identifiers and routes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.core import Tables, query
from loomwork.functions import checks, speech, text
from loomwork.functions.checks import EDGE
from loomwork.operators import chunks
from loomwork.operators.retrieval import lexical_score

_DECOMPOSED = "replace(text, 'é', 'e' || chr(769))"


def _documents(t: Tables) -> DataFrame:
    """Documents with é spelt as e and an accent, so that composing has work to do."""
    return t.documents.select("doc_id", F.replace("text", F.lit("é"), F.lit("é")).alias("text"))


@query("normalize_corpus", rf"SELECT doc_id, md5(trim(regexp_replace(lower(nfc_normalize({_DECOMPOSED})), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))) AS h FROM documents")
def normalize_corpus(t: Tables) -> DataFrame:
    return _documents(t).select("doc_id", F.md5(text.corpus_normal(F.col("text"))).alias("h"))


def _metric_sql(keep: str) -> str:
    return rf"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(nfc_normalize({_DECOMPOSED})), '[^\p{{L}}\p{{N}}_\s{text.ACCENTED}{keep}]', ' ', 'g'), '\s+', ' ', 'g'))) AS h FROM documents"


@query("normalize_metric", _metric_sql(""))
def normalize_metric(t: Tables) -> DataFrame:
    return _documents(t).select("doc_id", F.md5(text.metric_normal(F.col("text"))).alias("h"))


@query("normalize_ctc", _metric_sql("''"))
def normalize_ctc(t: Tables) -> DataFrame:
    return _documents(t).select("doc_id", F.md5(text.metric_normal(F.col("text"), keep="'")).alias("h"))


@query("normalize_light", r"SELECT doc_id, md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS h FROM documents")
def normalize_light(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(checks.light(F.col("text"))).alias("h"))


@query(
    "language_route",
    "SELECT doc_id, CASE WHEN (doc_id % 100) / 100.0 > 0 AND (doc_id % 100) / 100.0 < 0.55 THEN 'tw' WHEN lang = 'en' THEN 'en' WHEN lang IN ('fr') THEN 'ga' ELSE 'tw' END AS route FROM documents",
)
def language_route(t: Tables) -> DataFrame:
    """Languages stand for tags such as en-GB; French for ga. An unsure one goes to the fallback."""
    tag = F.concat(F.when(F.col("lang") == "fr", "ga").otherwise(F.col("lang")), F.lit("-XX"))
    return t.documents.select("doc_id", speech.language_from_tag(tag, (F.col("doc_id") % 100) / 100.0, "tw").alias("route"))


_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


@query(
    "tokenize",
    rf"""
WITH w AS (SELECT p_partkey, list_filter(string_split_regex(regexp_replace(lower('the ' || p_name || ' of salts, ' || p_type || '!'), '[^a-z0-9_ɛɔŋ\s-]', ' ', 'g'), '\s+'), lambda x: length(x) > 1 AND NOT list_contains([{_STOP}], x)) AS w FROM part)
SELECT p_partkey, array_to_string(list_slice(list_filter(list_append(w, 'ors'), lambda x, i: list_position(list_append(w, 'ors'), x) = i), 1, 8), ',') AS tokens FROM w
""",
)
def tokenize(t: Tables) -> DataFrame:
    whole = F.concat(F.lit("the "), "p_name", F.lit(" of salts, "), "p_type", F.lit("!"))
    return t.part.select("p_partkey", F.array_join(text.tokens(whole), ",").alias("tokens"))


@query(
    "lexical_score",
    """
WITH q AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[ \\n\\t,.;!?]+'), lambda x: length(x) > 2) AS w FROM benchmark WHERE item_id IN (SELECT min(item_id) FROM benchmark))
SELECT doc_id, round(CAST(len(list_filter(q.w, lambda x: contains(lower(d.text), x))) AS DOUBLE) / len(q.w), 6) AS score FROM documents d, q
""",
)
def lexical_score_query(t: Tables) -> DataFrame:
    """Every document scored for the first benchmark item, one row of which the driver reads."""
    request = t.benchmark.orderBy("item_id").first()["text"]
    return t.documents.select("doc_id", F.round(lexical_score(F.col("text"), request), 6).alias("score"))


@query(
    "speakable_text",
    r"""
WITH a AS (SELECT doc_id, 'CHWs at the ANC say: *MoMo* GHS 5, see https://who.int/x (WHO) ' || text AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?i)\bCHWs?\b', 'community health worker', 'g'), '\bANC\b', 'antenatal care', 'g'), '\bOTC\b', 'over the counter', 'g'), '(?i)\bMoMo\b', 'mobile money', 'g'), '\bGHS\b', 'Ghana Health Service', 'g'), '\bWHO\b', 'World Health Organization', 'g') AS t FROM a)
SELECT doc_id, substr(trim(regexp_replace(regexp_replace(regexp_replace(t, '[*_#`>~\[\]()]', ' ', 'g'), '(?i)https?://\S+', ' ', 'g'), '\s+', ' ', 'g')), 1, 500) AS spoken FROM b
""",
)
def speakable_text(t: Tables) -> DataFrame:
    """Texts with a line of jargon in front, cut at 500 characters, which is the feature."""
    jargon = F.concat(F.lit("CHWs at the ANC say: *MoMo* GHS 5, see https://who.int/x (WHO) "), "text")
    return t.spread(t.documents).select("doc_id", speech.speakable(jargon, "tw").alias("spoken"))


@query("prepare_text")
def prepare_text(t: Tables) -> DataFrame:
    """Rows only: number words have no SQL. The function is tested against expected sentences."""
    return t.spread(t.documents).select("doc_id", speech.prepared(F.concat(F.lit("Take 12 mg or 3.5 ml - 250 people. "), "text"), "en").alias("spoken"))


_NUM = "CASE WHEN n < 20 THEN ones[n + 1] ELSE tens[n // 10 + 1] || CASE WHEN n % 10 > 0 THEN ' ' || ones[n % 10 + 1] ELSE '' END END"


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query(
    "number_words",
    f"""
WITH p AS (SELECT p_partkey, p_size AS n FROM part), en AS (SELECT p_partkey, n, {_list(speech.ONES_EN)} AS ones, {_list(speech.TENS_EN)} AS tens FROM p), tw AS (SELECT p_partkey, n, {_list(speech.ONES_TW)} AS ones, {_list(speech.TENS_TW)} AS tens FROM p),
a AS (SELECT p_partkey, {_NUM} AS english FROM en), b AS (SELECT p_partkey, {_NUM} AS twi FROM tw)
SELECT a.p_partkey, english, twi FROM a JOIN b ON a.p_partkey = b.p_partkey
""",
)
def number_words(t: Tables) -> DataFrame:
    number = F.col("p_size").cast("string")
    return t.part.select("p_partkey", speech.number_words(number, "en").alias("english"), speech.number_words(number, "tw").alias("twi"))


@query("noise_variants")
def noise_variants(t: Tables) -> DataFrame:
    """Rows only: hashes of the key pick the edits. Tested against plain Python."""
    return t.spread(t.documents).select("doc_id", speech.noised(F.col("doc_id"), F.col("text")).alias("noised"), speech.pair_language(F.col("text")).alias("language"))


@query(
    "chat_triples",
    """
WITH p AS (SELECT conv_id, turn, text AS en, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS tw, ('0x' || substr(md5('en:' || conv_id || ':' || turn), 1, 8))::BIGINT % 100 AS a, ('0x' || substr(md5('mix:' || conv_id || ':' || turn), 1, 8))::BIGINT % 100 AS b FROM conversations)
SELECT conv_id, turn, CASE WHEN a < 15 THEN 'en' ELSE 'tw' END AS language, md5(CASE WHEN a < 15 OR b < 35 THEN en ELSE tw END) AS user_md5, md5(CASE WHEN a < 15 THEN en ELSE tw END) AS assistant_md5 FROM p WHERE tw IS NOT NULL
""",
)
def chat_triples(t: Tables) -> DataFrame:
    """A turn and the next stand for a parallel pair; 15 of 100 stay English, and of the others 35 of 100 ask in English."""
    return chunks.chat_triples(t.conversations)


@query(
    "mixed_language_flag",
    r"""
SELECT doc_id, starts_with(lower(lang), 'en') OR (contains(text, '[') AND contains(text, ']')) OR len(list_filter(string_split_regex(trim(text), '\s+'), lambda x: length(x) > 3 AND regexp_matches(x, '^[\x00-\x7F]+$'))) >= 2 AS mixed FROM documents
""",
)
def mixed_language_flag(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", speech.is_mixed(F.col("text"), F.col("lang")).alias("mixed"))


@query(
    "json_from_text",
    """
WITH r AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'sorry, none' ELSE 'Sure: ' || props || ' done' END AS raw FROM events)
SELECT event_id, CASE WHEN contains(raw, '{') THEN CAST(json_extract_string(regexp_extract(raw, '[{].*[}]'), '$.k') AS BIGINT) END AS k FROM r
""",
)
def json_from_text(t: Tables) -> DataFrame:
    """What lies between the first and the last brace of a noisy reply."""
    raw = F.when(F.col("event_type") == "error", "sorry, none").otherwise(F.concat(F.lit("Sure: "), "props", F.lit(" done")))
    return t.events.select("event_id", F.get_json_object(F.regexp_extract(raw, r"(?s)\{.*\}", 0), "$.k").cast("long").alias("k"))


@query("json_array_from_text", "SELECT event_id, event_type || '|x' AS items FROM events")
def json_array_from_text(t: Tables) -> DataFrame:
    """The array in a reply, its strings trimmed and empty ones dropped."""
    raw = F.concat(F.lit('Here: [" '), "event_type", F.lit(' ", "", "x"] ok'))
    items = F.filter(F.transform(F.from_json(F.regexp_extract(raw, r"(?s)\[.*\]", 0), "array<string>"), lambda x: F.trim(x)), lambda x: x != "")
    return t.events.select("event_id", F.array_join(items, "|").alias("items"))


@query("synthetic_ids", "SELECT p_partkey, 'part-' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS id FROM part")
def synthetic_ids(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.concat(F.lit("part-"), F.lpad(F.col("p_partkey").cast("string"), 6, "0")).alias("id"))


@query(
    "label_concat",
    """SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN 'user_' || substr(c_name, 1, 8) ELSE 'anonymous_user' END AS label, concat_ws('; ', 'original="' || c_mktsegment || '"', CASE WHEN c_custkey % 3 = 0 THEN 'rating=' || c_custkey % 5 END) AS notes FROM customer""",
)
def label_concat(t: Tables) -> DataFrame:
    """Some customers are anonymous, and two of three have no rating."""
    label = F.when(F.col("c_custkey") % 4 != 0, F.concat(F.lit("user_"), F.substring("c_name", 1, 8))).otherwise("anonymous_user")
    rating = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("rating="), F.col("c_custkey") % 5))
    return t.customer.select("c_custkey", label.alias("label"), F.concat_ws("; ", F.concat(F.lit('original="'), "c_mktsegment", F.lit('"')), rating).alias("notes"))


@query("id_cleanup", "SELECT p_partkey, replace(p_name, ' ', '/') AS id, TRUE AS valid FROM part")
def id_cleanup(t: Tables) -> DataFrame:
    """A dataset's name without the split after the colon."""
    name = F.substring_index(F.concat(F.replace("p_name", F.lit(" "), F.lit("/")), F.lit(":test")), ":", 1)
    return t.part.select("p_partkey", name.alias("id"), name.rlike(r"^[A-Za-z0-9._-]+/[A-Za-z0-9._-]+$").alias("valid"))


_FLAGS = (("english", r"\b(the|and|of)\b"), ("health", "health|symptom|medicine|malaria|maternal|clinical"), ("code_switch", "code[-_ ]?switch|twi[-_ ]?english|tw[-_ ]?en"), ("noise", "phone|mobile|noise|noisy|field"))


@query("multi_label_flags", "SELECT doc_id, " + ", ".join(f"regexp_matches(text, '(?i){p}') AS {n}" for n, p in _FLAGS) + " FROM documents")
def multi_label_flags(t: Tables) -> DataFrame:
    return t.spread(t.documents).select("doc_id", *(F.col("text").rlike("(?i)" + p.replace(r"\b", EDGE)).alias(n) for n, p in _FLAGS))


@query(
    "error_class",
    """SELECT event_id, CASE event_type WHEN 'error' THEN 503 WHEN 'view' THEN 504 ELSE 500 END AS status, CASE event_type WHEN 'error' THEN 'The service is still getting ready. Please try again in a moment.' WHEN 'view' THEN 'That took longer than expected. Please try again.' WHEN 'click' THEN 'I couldn’t process that recording. Please try again a little closer to the microphone.' ELSE 'I couldn’t complete that response. Please try again.' END AS message FROM events""",
)
def error_class(t: Tables) -> DataFrame:
    """Event types stand for errors: refused, timed out, of a voice turn, other."""
    detail = F.when(F.col("event_type") == "error", "connect econnrefused 127.0.0.1").when(F.col("event_type") == "view", "Request timed out").otherwise("boom")
    failure = speech.public_failure(detail, F.when(F.col("event_type") == "click", "voice").otherwise("chat"))
    return t.events.withColumn("f", failure).select("event_id", "f.status", "f.message")


@query(
    "route_resolution",
    "SELECT doc_id, CASE WHEN lang = 'en' THEN 'english' WHEN doc_id % 5 = 0 THEN 'dondo' WHEN lang = 'es' THEN NULL ELSE 'twi-default' END AS asr_route, CASE WHEN lang = 'en' THEN 'mms' WHEN doc_id % 5 = 0 THEN 'nano-twi' ELSE 'stable-twi' END AS tts_provider FROM documents",
)
def route_resolution(t: Tables) -> DataFrame:
    """English has its route; every fifth document asks for the other model; Spanish stands for no default."""
    asked = F.when(F.col("doc_id") % 5 == 0, "dondo")
    default = F.when(F.col("lang") != "es", "default-url")
    return t.documents.select("doc_id", speech.asr_route(F.col("lang"), asked, F.lit("en-url"), F.lit("dondo-url"), default).alias("asr_route"), speech.tts_provider(F.col("lang"), F.when(F.col("doc_id") % 5 == 0, "nano-twi")).alias("tts_provider"))


@query("tag_union_sorted", "SELECT p_partkey, array_to_string(list_sort(list_distinct(string_split(p_name, ' ') || ['twi', 'ring', 'asr'])), ',') AS tags, printf('%.4f', p_retailprice / 1000) AS metric FROM part")
def tag_union_sorted(t: Tables) -> DataFrame:
    tags = F.array_sort(F.array_union(F.split("p_name", " "), F.array(F.lit("twi"), F.lit("ring"), F.lit("asr"))))
    return t.part.select("p_partkey", F.array_join(tags, ",").alias("tags"), F.format_string("%.4f", F.col("p_retailprice") / 1000).alias("metric"))


@query(
    "suffix_class",
    "SELECT page_id, CASE WHEN contains(lower(url), '.html') THEN 'html' WHEN contains(lower(url), 'page=') THEN 'paged' WHEN contains(lower(url), '#') THEN 'anchor' ELSE 'webm' END AS suffix FROM pages",
)
def suffix_class(t: Tables) -> DataFrame:
    """Ordered marks in an address, with a default."""
    return t.pages.select("page_id", speech.by_marks(F.col("url"), ((".html", "html"), ("page=", "paged"), ("#", "anchor")), "webm").alias("suffix"))


@query("first_of_list", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'local' ELSE event_type END AS client FROM events")
def first_of_list(t: Tables) -> DataFrame:
    """The first address of a forwarded list; an empty one falls back."""
    forwarded = F.when(F.col("event_type") == "error", " , 10.0.0.1").otherwise(F.concat(F.lit(" "), "event_type", F.lit(", 10.0.0.1")))
    return t.events.select("event_id", F.coalesce(F.nullif(F.trim(F.get(F.split(forwarded, ","), F.lit(0))), F.lit("")), F.lit("local")).alias("client"))


@query("truncate_ellipsis", "SELECT doc_id, CASE WHEN length(text) > 40 THEN substr(text, 1, 40) || '…' ELSE text END AS label FROM documents")
def truncate_ellipsis(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.when(F.length("text") > 40, F.concat(F.substring("text", 1, 40), F.lit("…"))).otherwise(F.col("text")).alias("label"))


_JOIN = "CASE WHEN len(acc) > 0 AND length(list_last(acc)) + 1 + length(x[1]) <= 160 THEN list_append(acc[1:len(acc) - 1], list_last(acc) || ' ' || x[1]) ELSE list_append(acc, x[1]) END"
_PACKED = "list_reduce(list_transform({0}, lambda p: [p]), lambda acc, x: " + _JOIN + ")"
_TRIMMED = "list_filter(list_transform({0}, lambda p: trim(p, ' ' || chr(9) || chr(10) || chr(13))), lambda p: p <> '')"


@query(
    "pack_chunks",
    f"""
WITH s AS (SELECT doc_id, text, {_TRIMMED.format("string_split(regexp_replace(text, '([.!?])[[:space:]]+', '\\1' || chr(1), 'g'), chr(1))")} AS parts FROM documents WHERE text <> ''),
l AS (SELECT doc_id, CASE WHEN length(text) <= 160 THEN [text] ELSE {_PACKED.format("parts")} END AS lines, length(text) <= 160 AS short FROM s),
c AS (SELECT doc_id, flatten(list_transform(lines, lambda y: CASE WHEN short OR length(y) <= 160 THEN [y] ELSE {_PACKED.format(_TRIMMED.format("string_split_regex(y, '[[:space:]]+')"))} END)) AS chunks FROM l)
SELECT doc_id, CAST(UNNEST(range(0, len(chunks))) AS INTEGER) AS n, UNNEST(chunks) AS chunk FROM c
""",
)
def pack_chunks(t: Tables) -> DataFrame:
    """Sentences packed greedily into pieces of 160 characters."""
    return t.spread(t.documents).select("doc_id", F.posexplode(chunks.sentences(F.col("text"))).alias("n", "chunk"))


@query(
    "reply_chunks",
    r"""
WITH p AS (SELECT conv_id, turn, regexp_extract_all(text, '[^[:space:]]+[[:space:]]*') AS parts FROM conversations),
c AS (SELECT conv_id, turn, list_reduce(list_transform(parts, lambda y: [y]), lambda acc, x: CASE WHEN length(list_last(acc)) >= 28 OR regexp_matches(list_last(acc), '[.!?][[:space:]]*$') THEN list_append(acc, x[1])
  ELSE list_append(acc[1:len(acc) - 1], list_last(acc) || x[1]) END) AS chunks FROM p WHERE len(parts) > 0)
SELECT conv_id, turn, CAST(UNNEST(range(0, len(chunks))) AS INTEGER) AS n, UNNEST(chunks) AS chunk FROM c
""",
)
def reply_chunks(t: Tables) -> DataFrame:
    """Replies in pieces of 28 characters or whole sentences."""
    return t.conversations.select("conv_id", "turn", F.posexplode(chunks.live(F.col("text"))).alias("n", "chunk"))
