"""Fill-in-the-middle transformation by bit-parallelism: a text's units are bits of one big integer, one bit for each byte."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import arrays, common

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents, so many are left plain, and of the others, so many of 100 begin with the suffix.
PLAIN_SHARE = 10
SPM_SHARE = 20
SEED = "1"
OUT = ("n", "form", "prefix_chars", "middle_chars", "fim_text")


def class_table(members: bytes | range) -> bytes:
    """For bytes.translate(): the digit 1 for bytes of the class, 0 for all others."""
    inside = set(members)
    return bytes(49 if b in inside else 48 for b in range(256))


#: Bytes that begin a code point of UTF-8 (all but 0x80 to 0xBF), line ends, and white space as the words of this package know it.
LEAD = class_table([*range(0x80), *range(0xC0, 0x100)])
NEWLINE = class_table(b"\n")
SPACE = class_table(b" \t\n\v\f\r")


def mask(backward: bytes, table: bytes) -> int:
    """The class's bytes as bits of an integer: bit i is byte i of the text, which is given from its end to its start. Linear, as the base is a power of two."""
    return int(backward.translate(table), 2) if backward else 0


def starts(data: bytes, unit: str) -> tuple[int, int]:
    """The bits at which units start, and those at which code points do.

    A unit is a code point (`char`), a word with the white space behind it (`word`; white space before the first word is of its unit) or
    a line with its end (`line`). Units leave no gap: the first one starts at bit 0."""
    backward = data[::-1]
    lead = mask(backward, LEAD)
    if unit == "char" or not data:
        return lead | (1 if data else 0), lead
    if unit == "word":
        space = mask(backward, SPACE)
        body = ((1 << len(data)) - 1) ^ space
        first = body & -body
        return (body & (space << 1) & ~first) | 1, lead
    if unit == "line":
        return ((mask(backward, NEWLINE) << 1) | 1) & ((1 << len(data)) - 1), lead
    raise ValueError(f"no unit {unit!r}: char, word or line")


def select(bits: int, k: int, width: int) -> int:
    """The place of the set bit of rank k (from 0) among the `width` bits; `width` if there are no more than k.

    Halves again and again: the lower half's bit_count says in which half it lies, so all steps together look at 2 x width bits."""
    if k >= bits.bit_count():
        return width
    at = 0
    while width > 1:
        half = width >> 1
        low = bits & ((1 << half) - 1)
        below = low.bit_count()
        if k < below:
            bits, width = low, half
        else:
            bits, at, k, width = bits >> half, at + half, k - below, width - half
    return at


def rearrange(data: bytes, h: tuple[int, int, int, int], marks: tuple[bytes, bytes, bytes], unit: str = "char", plain_share: int = PLAIN_SHARE, spm_share: int = SPM_SHARE) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, code points of the prefix, those of the middle, output: one text's transformation, decided by four numbers."""
    begin, lead = starts(data, unit)
    n = begin.bit_count()
    if not data or any(m in data for m in marks) or h[2] % 100 >= 100 - plain_share:
        return n, "plain", None, None, data
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    first = select(begin, a, len(data))
    second = first + select(begin >> first, b - a, len(data) - first)
    prefix, middle, suffix = data[:first], data[first:second], data[second:]
    before = (lead & ((1 << first) - 1)).bit_count()
    inside = (lead & ((1 << second) - 1)).bit_count() - before
    p, s, m = marks
    if h[3] % 100 < spm_share:
        return n, "spm", before, inside, b"".join((s, suffix, p, prefix, m, middle))
    return n, "psm", before, inside, b"".join((p, prefix, s, suffix, m, middle))


def _checked(marks: tuple[str, str, str]) -> tuple[str, str, str]:
    """Marks that can be found again whatever text stands beside them: none begins with what another ends with."""
    if len(set(marks)) < 3 or not all(marks):
        raise ValueError("three different marks are needed")
    for a in marks:
        for b in marks:
            if any(a[-i:] == b[:i] for i in range(1, min(len(a), len(b)) + (a != b))):
                raise ValueError(f"marks {a!r} and {b!r} may overlap")
    return marks


def transform(df: DataFrame, text: str = "text", key: str = "doc_id", unit: str = "char", marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE), plain_share: int = PLAIN_SHARE, spm_share: int = SPM_SHARE, seed: str = SEED) -> DataFrame:
    """df's columns with n (units of the text), form (`psm`, `spm` or `plain`), prefix_chars, middle_chars (code points; null if
    plain) and fim_text, the rearranged text.

    h1 to h4 are the first four 8-digit groups of the hex SHA-256 of seed, a colon and the key. The prefix ends after the smaller of
    h1 % (n + 1) and h2 % (n + 1) units, the middle after the larger. Empty texts, texts that hold a mark and `plain_share` of 100
    others (by h3) stay plain; `spm_share` of 100 of the rest (by h4) begin with the suffix, the others with the prefix.

    A null text counts as empty; a null key as an empty one. Repeated rows each come out alike, as nothing but key and text decides.
    Columns of df that are named as those five are dropped, all others stay as they are. No shuffle: rows go through in slices of a
    few megabytes of text, and a text costs time linear in its bytes.
    """
    common.need(df, text, key)
    marks = _checked(marks)
    raw = tuple(m.encode() for m in marks)
    own = [c for c in df.columns if c not in OUT or c in (text, key)]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    names = {c: f"c{i}" for i, c in enumerate(own)}  # names within, so that no column clashes
    hashed = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i}") for i in range(4)]
    rows = df.select(*(F.col(f"`{c}`").alias(a) for c, a in names.items()), F.col(text).cast("string").cast("binary").alias("bytes"), *hashed)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrays.slices(batch, "bytes"):
                h = zip(*(part.column(f"h{i}").to_pylist() for i in range(4)), strict=True)
                done = [rearrange(value.as_py() or b"", four, raw, unit, plain_share, spm_share) for value, four in zip(part.column("bytes"), h, strict=True)]
                n, form, before, inside, out = zip(*done, strict=True)
                new = [pa.array(n, pa.int64()), pa.array(form), pa.array(before, pa.int64()), pa.array(inside, pa.int64()), pa.array(out, pa.binary())]
                yield pa.RecordBatch.from_arrays([*(part.column(a) for a in names.values()), *new], names=[*names.values(), *("o_" + o for o in OUT)])

    fields = ", ".join(f"{names[c]} {rows.schema[names[c]].dataType.simpleString()}" for c in own)
    done = rows.mapInArrow(pieces, f"{fields}, o_n long, o_form string, o_prefix_chars long, o_middle_chars long, o_fim_text binary")
    kept = [F.col(a).alias(c) for c, a in names.items() if c not in OUT]
    return done.select(*kept, *(F.col(f"o_{o}").alias(o) for o in OUT[:-1]), F.col("o_fim_text").cast("string").alias("fim_text"))


def restore(output: Column, form: Column, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that transform() was given (empty for null), from its fim_text and form alone: found between the marks, in the JVM."""
    p, s, m = marks
    last = F.substring_index(output, m, -1)
    before = F.substring_index(output, m, 1)
    inner = lambda mark, other: F.substring_index(F.substring_index(before, other, 1), mark, -1)
    tail = lambda mark: F.substring_index(before, mark, -1)
    return F.when(form == "psm", F.concat(inner(p, s), last, tail(s))).when(form == "spm", F.concat(tail(p), last, inner(s, p))).otherwise(output)


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = transform(common.documents(spark, sf_dir).select("doc_id", "text"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    back = restore(F.col("fim_text"), F.col("form"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("fim_text")).alias("output_sha256"), sha(back).alias("restored_sha256"))


_H = ", ".join(f"('0x' || substr(sha256('{SEED}:' || doc_id), {1 + 8 * i}, 8))::BIGINT AS h{i + 1}" for i in range(4))
ORACLES = {
    "op11_infill": f"""
WITH whole AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, {_H} FROM documents),
formed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= {100 - PLAIN_SHARE} THEN 'plain'
              WHEN h4 % 100 < {SPM_SHARE} THEN 'spm' ELSE 'psm' END AS form
  FROM whole
), cut AS (
  SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1, n - b) AS s FROM formed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM cut
"""
}
QUERIES = {"op11_infill": op11_infill}
