"""Scans, line-delimited JSON, and text sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork import core
from loomwork.core import Tables, query
from loomwork.operators.numbering import numbered
from loomwork.sources import jsonl
from loomwork.sources.tar import read_tar, write_tar


@query("scan_project", "SELECT p_partkey, p_name, p_retailprice FROM part")
def scan_project(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", "p_name", "p_retailprice")


@query(
    "jsonl_parse",
    """
WITH lines AS (
  SELECT event_id, trim(CASE WHEN event_type = 'error' THEN '   ' ELSE '  ' || props || ' ' END) AS line FROM events
), numbered AS (
  SELECT row_number() OVER (ORDER BY event_id) AS line_no, line FROM lines WHERE line <> ''
)
SELECT line_no, line, CAST(json_extract_string(line, '$.k') AS BIGINT) AS k FROM numbered
""",
)
def jsonl_parse(t: Tables) -> DataFrame:
    """Errors stand for blank lines; line numbers count the others."""
    raw = F.when(F.col("event_type") == "error", "   ").otherwise(F.concat(F.lit("  "), "props", F.lit(" ")))
    lines = jsonl.trimmed(t.events.select("event_id", raw.alias("line")), "line")
    return numbered(lines, "event_id", "line_no").select("line_no", "line", F.get_json_object("line", "$.k").cast("long").alias("k"))


@query(
    "json_tolerant",
    """
WITH lines AS (SELECT event_id, CASE WHEN event_type = 'signup' THEN substr(props, 2) ELSE props END AS line FROM events)
SELECT event_id, CASE WHEN json_valid(line) THEN CAST(json_extract_string(line, '$.k') AS BIGINT) END AS k, NOT json_valid(line) AS is_problem FROM lines
""",
)
def json_tolerant(t: Tables) -> DataFrame:
    """Sign-ups stand for damaged lines: they become problem rows, the others are read."""
    lines = t.events.select("event_id", F.when(F.col("event_type") == "signup", F.substring("props", 2, 1_000_000)).otherwise(F.col("props")).alias("line"))
    parsed = jsonl.tolerant(lines, "line", "k long")
    return parsed.select("event_id", F.col("row.k").alias("k"), "is_problem")


@query("text_column_scan", "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 20000")
def text_column_scan(t: Tables) -> DataFrame:
    """The text column of documents up to the cap of a corpus."""
    return t.documents.select("doc_id", "text").orderBy("doc_id").limit(20000)


@query("limit_scan", "SELECT doc_id, source, n_chars FROM documents ORDER BY doc_id LIMIT 100")
def limit_scan(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "source", "n_chars").orderBy("doc_id").limit(100)


@query(
    "to_jsonl",
    """SELECT event_id, '{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}' AS line FROM events""",
)
def to_jsonl(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.to_json(F.struct("event_id", "event_type", "user_id")).alias("line"))


@query(
    "insert_skip_duplicates",
    """
SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 <> 0
UNION ALL
SELECT c_custkey, 'new ' || c_name FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 = 0
""",
)
def insert_skip_duplicates(t: Tables) -> DataFrame:
    """Two thirds of the customers are there; of the even ones offered anew, those already there are skipped."""
    there = t.customer.filter("c_custkey % 3 <> 0").select("c_custkey", "c_name")
    offered = t.customer.filter("c_custkey % 2 = 0").select("c_custkey", F.concat(F.lit("new "), "c_name").alias("c_name"))
    return there.unionByName(offered.join(there.select("c_custkey"), "c_custkey", "left_anti"))


@query(
    "sse_parse",
    """
SELECT event_id, CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS event, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
FROM events WHERE event_type <> 'view'
""",
)
def sse_parse(t: Tables) -> DataFrame:
    """Frames of a server-sent stream; a frame without an event line (views) is skipped."""
    frame = F.concat(F.when(F.col("event_type") != "view", F.concat(F.lit("event: "), "event_type", F.lit("\n"))).otherwise(""), F.lit("data: "), "props", F.lit("\n\n"))
    return jsonl.sse_frames(t.events.select("event_id", frame.alias("frame")), "frame", "k long").select("event_id", "event", F.col("data.k").alias("k"))


@query("tar_members", "SELECT page_id, strlen(coalesce(html, '')) AS size, md5(coalesce(html, '')) AS content_md5 FROM pages")
def tar_members(t: Tables) -> DataFrame:
    """The pages written as archives, a member for each, and read back from there."""
    path = core.scratch(t.spark, "pages")
    write_tar(t.pages.select(F.concat(F.lit("pages/"), "page_id", F.lit(".html")).alias("member"), F.col("html").cast("binary").alias("content")), path)
    number = F.regexp_extract("member", r"pages/(-?\d+)\.html", 1).cast("long")
    return read_tar(t.spark, path).select(number.alias("page_id"), "size", F.md5("content").alias("content_md5"))


@query("tar_members_named", "SELECT page_id, md5(coalesce(html, '')) AS content_md5 FROM pages WHERE page_id IN (3, 14, 15, 92)")
def tar_members_named(t: Tables) -> DataFrame:
    """Members by name, which is the feature: the reader passes over all others without reading what they hold."""
    path = core.scratch(t.spark, "pages")
    write_tar(t.pages.select(F.concat(F.lit("pages/"), "page_id", F.lit(".html")).alias("member"), F.col("html").cast("binary").alias("content")), path)
    named = read_tar(t.spark, path).filter(F.col("member").isin(*(f"pages/{i}.html" for i in (3, 14, 15, 92))))
    return named.select(F.regexp_extract("member", r"pages/(-?\d+)\.html", 1).cast("long").alias("page_id"), F.md5("content").alias("content_md5"))
