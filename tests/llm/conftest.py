"""Small tables with the cases that every operator must stand: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("key", "n", "cls", "row", "host", "label", "shard", "cell", "v", "lines", "kept", "rank", "score", "secrets", "lang_pred", "edits", "ids", "bucket", "listed", "rule", "__copy", "__copies", "__order", "__rate", "__source", "__row", "__key", "__host", "component_id", "link", "crc", "size", "sig", "a", "b", "began", "slot")

WORDS = "the river runs under old stone bridge while seven children watch slow barges drift past green fields every warm summer evening until night comes".split()


def sentence(seed: int, n: int = 40) -> str:
    return " ".join(WORDS[(seed * 7 + i * i + i * (seed % 5 + 1)) % len(WORDS)] + str((seed * i) % 13) for i in range(n))


def rows() -> list[tuple]:
    out = [(i, sentence(i), ("en", "fr", None)[i % 3], f"s{i % 3}" if i % 5 else None, 100 + i) for i in range(1, 40)]
    out += [(40, None, None, None, None), (41, "", "en", "s1", 0), (42, " \t\n", None, "s1", 3), (43, "word", "en", None, 4), (44, "é ß 中文 \U0001f600 a\u0000b", None, "s2", 12)]
    out += [(45, sentence(1), "en", "s1", 1), (46, sentence(1), "en", "s1", 1), (46, sentence(1), "en", "s1", 1)]
    out += [(47, " ".join(sentence(k, 50) for k in range(400)), "en", "s1", 100000), (48, "x" * 200_000, "fr", "s2", 200000)]
    return out


@pytest.fixture(scope="session")
def cases(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(cases):
    """The cases with a column of every name that an operator uses within."""
    from pyspark.sql import functions as F

    return cases.select("*", *(F.lit("clash").alias(c) for c in CLASHING))
