"""Predicates over texts, signals and owners, as columns."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of telephone numbers and mail addresses, and phrases that recognisers invent on silence.
PHONE = r"\+?\d[\d\s().-]{6,}\d"
MAIL = r"[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
MARKERS = ("sɛ wopɛ sɛ wopɛ", "sɛ wopɛ mmea", "ɛfa wɔn ho", "me betumi aboa wo", "subscribe", "thank you for watching", "thanks for watching", "www.", "http")
FAILURES = ("mante nea wokae no ase", "i did not understand that clearly enough", "service is temporarily unavailable", "ntumi mmua wo seesei")

#: A word boundary as ECMAScript has it: ASCII word characters only.
EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def icontains(text: Column, part: str) -> Column:
    """Whether text has the part, literally and in any case."""
    return F.lower(text).contains(part.lower())


def light(text: Column) -> Column:
    """Lower case with single spaces and no edges; marks stay."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def has_pii(text: Column) -> Column:
    return text.rlike(PHONE) | text.rlike("(?i)" + MAIL)


def owned(df: DataFrame, **owner) -> DataFrame:
    """Rows that any of the given owner columns claims; no owner at all claims nothing."""
    claims = [F.col(k) == v for k, v in owner.items() if v is not None]
    return df.filter(reduce(or_, claims)) if claims else df.filter(F.lit(False))


def enough_votes(up: Column, down: Column) -> Column:
    """At least two for and none against, null as none; a vote that isn't a number keeps the row."""
    number = lambda c: F.coalesce(c, F.lit("0")).try_cast("int")
    return F.coalesce((number(up) >= 2) & (number(down) == 0), number(up).isNull() | number(down).isNull())


def words_changed(a: Column, b: Column) -> Column:
    """Places at which the words of two texts differ; a missing word differs from any."""
    pad = F.zip_with(F.split(a, " "), F.split(b, " "), lambda x, y: F.when(x.eqNullSafe(y), 0).otherwise(1))
    return F.aggregate(pad, F.lit(0), lambda s, x: s + x)


def meaningful_change(before: Column, after: Column) -> Column:
    """Both texts say something, and not the same. (Texts that differ differ in a word, so no least length is needed.)"""
    a, b = light(before), light(after)
    return F.coalesce((a != "") & (b != "") & (a != b), F.lit(False))


def audio_verdict(n_bytes: Column, seconds: Column, rms: Column) -> Column:
    return F.when(n_bytes < 200, "audio_too_small").when(seconds < 0.35, "too_short").when(rms < 0.008, "too_quiet").otherwise("ok")


def repeats(text: Column) -> Column:
    """Nothing said, a known marker, or the first three words found three times or more in six or more words."""
    t = F.regexp_replace(F.lower(text), r"(?U)^\s+|\s+$", "")
    words = F.filter(F.split(t, r"(?U)\s+"), lambda w: w != "")
    first = F.array_join(F.slice(words, 1, 3), " ")
    times = F.when(F.length(first) > 0, (F.length(t) - F.length(F.replace(t, first, F.lit("")))) / F.length(first)).otherwise(0)
    return (t == "") | reduce(or_, (t.contains(m) for m in MARKERS)) | ((F.size(words) >= 6) & (times >= 3))


def weak_signal(seconds: Column, rms: Column, probability: Column, text: Column) -> Column:
    """Short, quiet (but not silent), uncertain, or a filler in few words; unknown measures aren't weak."""
    low = F.lower(text)
    filler = low.rlike(f"{EDGE}(ɛɛ|hmm|mm){EDGE}") & (F.size(F.split(low, r"\s+")) <= 6)
    return reduce(or_, (F.coalesce(c, F.lit(False)) for c in (seconds < 1.4, (rms > 0) & (rms < 0.015), probability < 0.55, filler)))


def is_failure(reply: Column) -> Column:
    said = light(reply)
    return reduce(or_, (said.contains(p) for p in FAILURES))
