"""The document pipeline: language, near duplicates, secrets, mixing and packing, each stage on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import common, jaccard, language, mixing, packing, secrets

#: Keys of removed near duplicates are broadcast only up to this many.
BROADCAST_KEYS = 500_000
#: Bytes of rows in one batch between the JVM and a Python worker, each of which holds a batch on its way in and one on its way out.
BATCH_BYTES = "4m"
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: How the C library of Python workers keeps what was freed: arrays of a megabyte go back to the system at once, in two arenas at most.
#: A worker outlives its task, so what it kept would be the next stage's burden.
ALLOCATOR = {"MALLOC_MMAP_THRESHOLD_": "1048576", "MALLOC_TRIM_THRESHOLD_": "1048576", "MALLOC_ARENA_MAX": "2"}


def _ready(spark: SparkSession) -> None:
    common.ship(spark)
    spark.conf.set(BATCH, BATCH_BYTES)
    for name, value in ALLOCATOR.items():
        spark.sparkContext.environment.setdefault(name, value)


def _by_place(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns named c0, c1, …, so that no name of a caller's column meets one of an operator's, and the new name of each."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), names


def _by_name(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*(F.col(n).alias(c) for c, n in names.items()))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language: those that the models reject, or that have no letter (null and empty texts too), go. Repeated
    rows and further columns, whatever their names, stay as they are; so they do in all stages but the last."""
    _ready(spark)
    placed, names = _by_place(docs)
    found = language.predict(placed, language.train(docs), names["text"])
    return _by_name(found.filter(~F.col("lang_rejected")), names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that n-gram similarity links, one row: that of the smallest doc_id (null before any), with several texts of one
    doc_id of one of them. Rows are told apart by doc_id and text; of repeated rows that are linked one stays. Rows without words are
    linked with nothing and all stay."""
    _ready(spark)
    placed, names = _by_place(docs)
    keyed = placed.withColumn("mark", F.struct(F.col(names["doc_id"]).alias("doc_id"), F.xxhash64(F.col(names["text"]).cast("string")).alias("text")))
    groups = common.table(jaccard.jaccard_components(keyed.select("mark", F.col(names["text"]).alias("text")), "mark"), "groups")
    rows = groups.filter("n_shingles > 0").groupBy("mark", "component_id").agg(F.count(F.lit(1)).alias("times"))
    gone = rows.filter(F.col("mark") != F.col("component_id")).select("mark")
    kept = keyed.join(F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone, "mark", "left_anti")
    again = rows.filter(F.col("mark") == F.col("component_id")).filter("times > 1").select("mark")
    if not again.isEmpty():
        kept = kept.join(again, "mark", "left_semi").dropDuplicates(["mark"]).unionByName(kept.join(again, "mark", "left_anti"))
    return _by_name(kept, names)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets replaced by a mark and n_chars as it then is. Null texts stay null and keep n_chars."""
    _ready(spark)
    placed, names = _by_place(docs)
    cleaned = secrets.redact(placed, secrets.train(docs), names["text"])
    n_chars = F.col(names["n_chars"])
    size = F.coalesce(F.char_length(names["text"]).cast(docs.schema["n_chars"].dataType), n_chars)
    return _by_name(cleaned.withColumn(names["n_chars"], size), names)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its source's target weight asks, globally shuffled. A null source is a source."""
    _ready(spark)
    placed, names = _by_place(docs)
    return _by_name(mixing.mix(placed, names["doc_id"], names["source"]), names)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of power-of-two lengths, of every row; a null text is empty. Other columns are dropped."""
    _ready(spark)
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("mixing", mixing_sources),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's own tables are deleted when its result has been written, and that when the next one's has."""
    docs, before = common.documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        with common.passing() as keep:
            docs = keep(common.table(stage(spark, docs, sf_dir), name))
        common.discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
