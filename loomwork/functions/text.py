"""Normalisers and tokenizers, as columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words that a catalog request does without, and accented letters that the metric normalisers keep.
STOP_WORDS = ("a", "an", "the", "of", "for", "me", "ma", "sɛ", "se", "kg")
ACCENTED = "ɛɔáàâäéèêëíìîïóòôöúùûüńŋ"


@F.pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: x if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: x if x is None else unicodedata.normalize("NFKC", x))


def _composed(text: Column | str, form) -> Column:
    """Texts in ASCII are composed already: only the others go to Python."""
    text = F.col(text) if isinstance(text, str) else text
    other = text.rlike(r"[^\x00-\x7F]")
    return F.when(other, form(F.when(other, text))).otherwise(text)


def nfc(text: Column | str) -> Column:
    """Composed Unicode form."""
    return _composed(text, _nfc)


def nfkc(text: Column | str) -> Column:
    """Composed compatibility form."""
    return _composed(text, _nfkc)


def once(value: Column, f) -> Column:
    """f(value), with value made once however often f names it: as the only element of an array that f works on."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def replaced(text: Column, pattern: str, f) -> Column:
    """text with every match of the pattern (never an empty one) replaced by f(its group 1)."""
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), f)
    return F.array_join(F.zip_with(F.split(text, pattern, -1), F.array_append(found, F.lit("")), lambda piece, said: F.concat(piece, said)), "")


def squeezed(text: Column) -> Column:
    """Single spaces for white space of any kind, none at the edges."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def corpus_words(text: Column) -> Column:
    """Lower case, letters, digits and _ only, single spaces: for counting words of composed text."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "))


def corpus_normal(text: Column) -> Column:
    """NFKC, lower case, every run of other than letters and digits as one space, no edges."""
    return F.trim(F.regexp_replace(F.lower(nfkc(text)), r"[^\p{L}\p{N}]+", " "))


def metric_normal(text: Column, keep: str = "") -> Column:
    """NFC, lower case, word characters and accented letters only (and those in `keep`), single spaces."""
    return squeezed(F.regexp_replace(F.lower(nfc(F.coalesce(text, F.lit("")))), rf"[^\p{{L}}\p{{N}}_\s{ACCENTED}{keep}]", " "))


def query_tokens(text: str) -> list[str]:
    """Up to eight distinct search tokens of a request, without stop words and single characters; `ors` joins its synonyms."""
    import re

    raw = [w for w in re.sub(r"[^a-z0-9_ɛɔŋ\s-]", " ", text.lower()).split() if len(w) > 1 and w not in STOP_WORDS]
    if {"oral", "rehydration"} <= set(raw) or "salts" in raw:
        raw.append("ors")
    return list(dict.fromkeys(raw))[:8]


def tokens(text: Column) -> Column:
    """query_tokens() of a column, as an array."""
    raw = F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\wɛɔƐƆŋŊ\s-]", " "), r"\s+"), lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS))
    more = (F.array_contains(raw, "oral") & F.array_contains(raw, "rehydration")) | F.array_contains(raw, "salts")
    return F.slice(F.array_distinct(F.when(more, F.array_append(raw, F.lit("ors"))).otherwise(raw)), 1, 8)
