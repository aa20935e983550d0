"""Texts in pieces, and pairs as chats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK, LIVE = 160, 28


#: Lines of a run: a text's lines are gathered in runs, so that adding one doesn't copy all that are there.
RUN = 256


def _folded(pieces: Column, held_fits, glue: str) -> Column:
    """Lines from pieces in their order: a piece joins the line that is held if held_fits(line, piece), else that line is done."""
    none = F.array().cast("array<string>")
    start = F.struct(F.array().cast("array<array<string>>").alias("runs"), none.alias("run"), F.lit(None).cast("string").alias("held"))

    def step(s: Column, piece: Column) -> Column:
        joins = s["held"].isNotNull() & held_fits(s["held"], piece)
        done = s["held"].isNotNull() & ~joins
        over = done & (F.size(s["run"]) >= RUN)
        return F.struct(
            F.when(over, F.array_append(s["runs"], s["run"])).otherwise(s["runs"]).alias("runs"),
            F.when(over, F.array(s["held"])).when(done, F.array_append(s["run"], s["held"])).otherwise(s["run"]).alias("run"),
            F.when(joins, F.concat(s["held"], F.lit(glue), piece)).otherwise(piece).alias("held"),
        )

    last = lambda s: F.when(s["held"].isNull(), none).otherwise(F.array(s["held"]))
    return F.aggregate(pieces, start, step, lambda s: F.concat(F.flatten(s["runs"]), s["run"], last(s)))


def packed(pieces: Column, most: int) -> Column:
    """Pieces joined by spaces as long as a line takes them."""
    return _folded(pieces, lambda held, p: F.length(held) + 1 + F.length(p) <= most, " ")


def _split(text: Column, between: str) -> Column:
    return F.filter(F.transform(F.split(text, between), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def sentences(text: Column, most: int = CHUNK) -> Column:
    """Sentences packed into lines; lines that are too long are packed again by words. A short text is one line, a null or empty one none."""
    lines = packed(_split(text, r"(?U)(?<=[.!?])\s+"), most)
    fitting = F.flatten(F.transform(lines, lambda x: F.when(F.length(x) <= most, F.array(x)).otherwise(packed(_split(x, r"(?U)\s+"), most))))
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).when(F.length(text) <= most, F.array(text)).otherwise(fitting)


def live(text: Column, least: int = LIVE) -> Column:
    """Words, with the space after, until there are enough characters or a sentence ends. Sentences are folded one by one, as a line
    never goes on beyond one."""
    parts = lambda x: F.regexp_extract_all(x, F.lit(r"(?U)\S+\s*"), F.lit(0))
    whole = F.regexp_extract_all(text, F.lit(r"(?Us)\S.*?(?:(?<=[.!?])(?=\s)\s*|\z)"), F.lit(0))
    found = F.flatten(F.transform(whole, lambda x: _folded(parts(x), lambda held, _: F.length(held) < least, "")))
    return F.coalesce(found, F.array().cast("array<string>"))


def chat_triples(turns: DataFrame) -> DataFrame:
    """Each turn with the next as a parallel pair, made into a chat by hashes of its key."""
    chance = lambda salt: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(salt), "conv_id", "turn")), 1, 8), 16, 10).cast("long") % 100
    pairs = turns.withColumn("next", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("next is not null")
    english = chance("en") < 15
    user = F.when(english | (chance("mix") < 35), F.col("text")).otherwise(F.col("next"))
    reply = F.when(english, F.col("text")).otherwise(F.col("next"))
    return pairs.select("conv_id", "turn", F.when(english, "en").otherwise("tw").alias("language"), F.md5(user).alias("user_md5"), F.md5(reply).alias("assistant_md5"))
