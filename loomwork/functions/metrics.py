"""Error rates of recognised texts, and decisions from them, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwork.functions.edits import distance_of

#: Rates in percent up to which a run is promoted or held, and the limits of the promotion gates.
PROMOTE, HOLD = 28.0, 32.0
ENGLISH_MOST, ENGLISH_DELTA, LEAST_SAMPLES, HEALTH_MOST, SWITCH_MOST, NOISE_MOST = 17.0, 5.0, 100, 25.0, 30.0, 35.0
#: Least rows of each bucket for training and for evaluation, least speakers and least rows held out.
TRAINING_LEAST = {"health_twi": 100, "commerce_twi": 70, "codeswitch_tw_en": 60, "health_en": 50, "phone_noise": 20}
EVALUATION_LEAST = {"health_twi": 100, "commerce_twi": 50, "codeswitch_tw_en": 50, "health_en": 50, "phone_noise": 50}
LEAST_SPEAKERS, LEAST_HOLDOUT = 6, 250


def words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


#: Pairs with more cells in their table of distances than this go to the bit-parallel distance, the others to the built-in one.
CELLS = 1 << 22


def _distance(a: Column, b: Column, size_a: Column, size_b: Column, built_in: Column) -> Column:
    """The built-in distance of short pairs, which costs their lengths' product; long pairs alone go to Python, as batches."""
    long = size_a.cast("long") * size_b > CELLS
    return F.when(long, distance_of(F.when(long, a), F.when(long, b))).otherwise(built_in.cast("long"))


def char_edits(reference: Column, hypothesis: Column) -> Column:
    """Fewest insertions, deletions and substitutions of characters."""
    return _distance(reference, hypothesis, F.length(reference), F.length(hypothesis), F.levenshtein(reference, hypothesis))


def word_edits(reference: Column, hypothesis: Column) -> Column:
    """Fewest insertions, deletions and substitutions of words, for arrays of words.

    For the built-in distance each distinct word of the pair becomes one character of the supplementary planes, so that it counts
    words. The pair's vocabulary is made once, as the only element of an array that a function then works on."""
    both = F.struct(reference.alias("r"), hypothesis.alias("h"), F.array_distinct(F.concat(reference, hypothesis)).alias("known"))
    spelled = lambda a, known: F.coalesce(F.decode(F.unhex(F.array_join(F.transform(a, lambda w: F.lpad(F.hex(F.array_position(known, w) + 0xFFFF), 8, "0")), "")), "UTF-32"), F.lit(""))
    built_in = F.get(F.transform(F.array(both), lambda b: F.levenshtein(spelled(b["r"], b["known"]), spelled(b["h"], b["known"]))), F.lit(0))
    return F.when(reference.isNotNull() & hypothesis.isNotNull(), _distance(reference, hypothesis, F.size(reference), F.size(hypothesis), built_in))


def percent(direct: Column, *shares: Column) -> Column:
    """The percentage, or the first share that is known as a percentage with two decimals, halves upwards."""
    return F.coalesce(direct, F.floor(F.coalesce(*shares) * 10000 + 0.5) / 100)


def decision(wer: Column, is_run: Column, promote: Column, english: Column) -> Column:
    """What to do with a result: training runs by their own flag, English ones are checked for retention, others go by the rate."""
    return (
        F.when(wer.isNull(), "UNKNOWN")
        .when(is_run & promote & (wer <= PROMOTE), "TRAIN_PROMOTE_CANDIDATE")
        .when(is_run & promote & (wer <= HOLD), "TRAIN_HOLD_AND_VALIDATE")
        .when(is_run, "TRAIN_DO_NOT_PROMOTE")
        .when(english, "ENGLISH_RETENTION_CHECK")
        .when(wer <= PROMOTE, "PROMOTE_CANDIDATE")
        .when(wer <= HOLD, "HOLD_AND_VALIDATE")
        .otherwise("DO_NOT_PROMOTE")
    )


def gate(wer: Column, passes: Column) -> Column:
    """PASS or FAIL; MISSING without a rate. A condition that isn't known fails."""
    return F.when(wer.isNull(), "MISSING").when(F.coalesce(passes, F.lit(False)), "PASS").otherwise("FAIL")


def hmac_sha512(key: str, message: Column) -> Column:
    """Hex digest, from the built-in SHA-512: keys longer than a block are hashed first."""
    import hashlib

    raw = key.encode() if len(key.encode()) <= 128 else hashlib.sha512(key.encode()).digest()
    pad = lambda b: F.lit(bytearray(x ^ b for x in raw.ljust(128, b"\0")))
    return F.sha2(F.concat(pad(0x5C), F.unhex(F.sha2(F.concat(pad(0x36), message.cast("binary")), 512))), 512)
