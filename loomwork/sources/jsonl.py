"""Readers of line-delimited JSON, JSON results, tab-separated files and server-sent events, and their sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def trimmed(df: DataFrame, line: str) -> DataFrame:
    """Lines without edges of white space, blank ones dropped."""
    return df.withColumn(line, F.regexp_replace(line, r"^\s+|\s+$", "")).filter(F.col(line) != "")


def tolerant(df: DataFrame, line: str, schema: str) -> DataFrame:
    """Add `row` (null where a line isn't JSON) and `is_problem`: a bad line becomes a problem, the others go on."""
    parsed = F.from_json(line, f"{schema}, __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    out = df.withColumn("row", parsed).withColumn("is_problem", F.col("row").isNull() | F.col("row.__bad").isNotNull())
    return out.withColumn("row", F.when(~F.col("is_problem"), F.col("row").dropFields("__bad")))


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file of JSON lines; the first bad line ends the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_results(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A folder of JSON documents, one a file, with their file names."""
    return spark.read.schema(schema).option("multiLine", True).json(folder).withColumn("file", F.input_file_name())


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True)


def prompt_lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines of a prompt file without blanks and # comments."""
    return trimmed(spark.read.text(path), "value").filter(~F.col("value").startswith("#"))


def first_column(df: DataFrame, wanted: list[str]) -> str | None:
    """The first of the wanted names that df has."""
    return next((c for c in wanted if c in df.columns), None)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path)


def sse_frames(df: DataFrame, frame: str, schema: str) -> DataFrame:
    """Frames that have both an event and a data line, as `event` and parsed `data`."""
    event, data = F.regexp_extract(frame, r"(?m)^event: (.*)$", 1), F.regexp_extract(frame, r"(?m)^data: (.*)$", 1)
    return df.withColumns({"event": F.trim(event), "__data": F.trim(data)}).filter("event <> '' and __data <> ''").withColumn("data", F.from_json("__data", schema)).drop("__data")


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Whole files as path, length and content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "length", "content")


def result_name(*parts: str | int | None) -> str:
    """A name for a result's folder from what it describes: known parts joined by _, all but letters, digits, dots and hyphens as -."""
    import re

    return "_".join(re.sub(r"[^A-Za-z0-9.-]+", "-", str(p)) for p in parts if p is not None)


def write_results(df: DataFrame, folder: str, *parts: str | int | None) -> str:
    """Results as JSON lines in a folder of that name; returns its path."""
    path = f"{folder.rstrip('/')}/{result_name(*parts)}"
    df.write.mode("overwrite").json(path)
    return path


def pipe_table(df: DataFrame, missing: str = "-") -> DataFrame:
    """One column, `line`: each row as a line of a pipe table, in df's order; pipes and line ends within cells are escaped."""
    cell = lambda c: F.regexp_replace(F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(missing)), F.lit("|"), F.lit("\\|")), r"[\r\n]+", " ")
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, df.columns)), F.lit(" |")).alias("line"))


def pipe_head(df: DataFrame) -> list[str]:
    """The two lines above the rows of pipe_table()."""
    return ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
