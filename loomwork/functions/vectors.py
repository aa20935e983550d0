"""Arrays as vectors and samples, as columns; Arrow functions where bytes or frames are decoded."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Frame and hop in samples, sub-bands, dimensions, silence level and least voiced frames of speaker features.
FRAME, HOP, BANDS, DIMENSIONS, SILENCE, LEAST_FRAMES = 400, 160, 12, 64, 0.005, 5


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of the common length; a zero norm counts as a denominator of 1."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, 1, n), F.slice(b, 1, n)
    dot = _sum(F.zip_with(x, y, lambda p, q: p * q))
    size = F.sqrt(_sum(F.transform(x, lambda p: p * p))) * F.sqrt(_sum(F.transform(y, lambda q: q * q)))
    return dot / F.when(size == 0, 1.0).otherwise(size)


def unit(v: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    norm = F.sqrt(_sum(F.transform(v, lambda x: x * x)))
    return F.transform(v, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def resampled(v: Column, ratio: float) -> Column:
    """Every ratio-th sample, between samples by linear interpolation."""
    n = F.greatest(F.floor(F.size(v) / ratio).cast("int"), F.lit(1))

    def at(i: Column) -> Column:
        place = i * ratio
        low = F.floor(place).cast("int")
        high = F.least(low + 1, F.size(v) - 1)
        part = place - low
        return F.get(v, low) * (1 - part) + F.get(v, high) * part

    return F.transform(F.sequence(F.lit(0), n - 1), at)


def peak_normal(v: Column) -> Column:
    """Loud at most 0.95, and at most half again as loud as it was."""
    peak = F.array_max(F.transform(v, F.abs))
    return F.transform(v, lambda x: x * F.least(0.95 / F.when(peak == 0, 1.0).otherwise(peak), F.lit(1.5)))


#: Parts of a wave file that are looked at.
WAVE_PARTS = 64


def wav_seconds(content: Column) -> Column:
    """Length of a wave file in seconds: bytes of the `data` part over the bytes a second of the `fmt ` part. Parts begin at even
    places. Null without both, or if the file isn't one."""
    return F.get(F.transform(F.array(content), _seconds), F.lit(0))  # the content is made once, not for every part


def _seconds(content: Column) -> Column:
    text = lambda at, n: F.hex(F.substring(content, at + 1, F.lit(n)))
    number = lambda at: F.conv(F.concat(*(text(at + i, 1) for i in (3, 2, 1, 0))), 16, 10).cast("long")
    name = lambda raw: F.lit(raw.encode().hex().upper())

    def part(s: Column, _: Column) -> Column:
        """The state after the next part; behind the content's end, or with both numbers, nothing changes any more."""
        over = (s["at"] >= F.length(content)) | (s["rate"].isNotNull() & s["data"].isNotNull())
        return F.when(over, s).otherwise(after(s))

    def after(s: Column) -> Column:
        at = s["at"]
        size, kind = number(at + 4), text(at, 4)
        return F.struct(
            (at + 8 + F.coalesce(size + size % 2, F.lit(0))).cast("int").alias("at"),
            F.when(s["rate"].isNull() & (kind == name("fmt ")), number(at + 16)).otherwise(s["rate"]).alias("rate"),
            F.when(s["data"].isNull() & (kind == name("data")), size).otherwise(s["data"]).alias("data"),
        )

    none = F.lit(None).cast("long")
    fit = F.greatest(F.floor((F.length(content) - 12) / 8).cast("int"), F.lit(1))  # parts of 8 bytes at least
    found = F.aggregate(F.sequence(F.lit(1), F.least(fit, F.lit(WAVE_PARTS))), F.struct(F.lit(12).alias("at"), none.alias("rate"), none.alias("data")), part)
    is_wave = (text(F.lit(0), 4) == name("RIFF")) & (text(F.lit(8), 4) == name("WAVE"))
    return F.when(is_wave & (found["rate"] > 0), found["data"] / found["rate"])


@F.pandas_udf(T.StringType())
def to_base64(v: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats in base64."""
    import base64

    return v.map(lambda x: None if x is None else base64.b64encode(np.asarray(x, "<f4").tobytes()).decode())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_base64(text: pd.Series) -> pd.Series:
    import base64

    return text.map(lambda x: None if x is None else np.frombuffer(base64.b64decode(x), "<f4"))


def frames_of(flat: np.ndarray, offsets: np.ndarray, frame: int = FRAME, hop: int = HOP, bands: int = BANDS) -> tuple[np.ndarray, ...]:
    """Of all rows' samples at once: each frame's row and place in it, and its loudness, crossings of zero, energy of the first and of
    the second half, and of each band (frames x bands).

    A frame's sums are differences of running sums over all samples. Frames begin every `hop` samples, as long as a sample follows
    them. Samples that are null or not finite count as 0."""
    flat = np.where(np.isfinite(flat), flat, 0.0)
    energy = np.concatenate([[0.0], np.cumsum(flat * flat)])
    turns = np.concatenate([[0, 0], np.cumsum((flat[1:] >= 0) != (flat[:-1] >= 0))]) if len(flat) else np.zeros(1, np.int64)
    sizes = np.diff(offsets)
    n = np.maximum(-(-(sizes - frame) // hop), 0)
    row = np.repeat(np.arange(len(sizes)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = offsets[row] + place * hop
    between = lambda a, b: energy[at + b] - energy[at + a]
    width = frame // bands
    split = np.stack([between(i * width, (i + 1) * width) for i in range(bands)], axis=1)
    return row, place, np.sqrt(np.maximum(between(0, frame), 0) / frame), turns[at + frame] - turns[at + 1], between(0, frame // 2), between(frame // 2, frame), np.maximum(split, 0)


#: Rows whose frames are measured at once: running sums over all samples of a batch would be several times the batch.
ROWS_AT_ONCE = 256


def _slices(v: pa.Array, f, kind: pa.DataType) -> pa.Array:
    """f of so many rows at a time, as one array."""
    return pa.concat_arrays([pa.array([], kind), *(f(v.slice(i, ROWS_AT_ONCE)).cast(kind) for i in range(0, len(v), ROWS_AT_ONCE))])


def _samples(v: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All rows' samples, and where each row's begin; null rows have none."""
    sizes = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate([[0], np.cumsum(sizes)])


MEASURES = T.ArrayType(T.StructType([T.StructField("rms", T.DoubleType()), T.StructField("crossings", T.LongType()), T.StructField("bands", T.ArrayType(T.DoubleType()))]))


@F.arrow_udf(MEASURES)
def frame_measures(v: pa.Array) -> pa.Array:
    """Of each frame of FRAME samples its loudness (root of the mean square), crossings of zero, and energy in BANDS parts, for arrays of samples."""
    return _slices(v, _frame_measures, to_arrow_type(MEASURES))


def _frame_measures(v: pa.Array) -> pa.Array:
    flat, offsets = _samples(v)
    row, _, rms, crossings, _, _, bands = frames_of(flat, offsets)
    inner = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS), pa.int32()), pa.array(bands.ravel()))
    frames = pa.StructArray.from_arrays([pa.array(rms), pa.array(crossings.astype(np.int64)), inner], ["rms", "crossings", "bands"])
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(v)))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), frames, mask=pc.is_null(v))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def speaker_features(v: pa.Array) -> pa.Array:
    """Speaker features of samples at 16 kHz: means over voiced frames of sub-band energies, zero crossings, loudness and tilt, and
    differences of neighbouring bands, tiled to 64 weighted dimensions of length 1. Null without enough voiced frames."""
    return _slices(v, _speaker_features, pa.list_(pa.float64()))


def _speaker_features(v: pa.Array) -> pa.Array:
    flat, offsets = _samples(v)
    row, _, rms, crossings, low, high, bands = frames_of(flat, offsets)
    voiced = rms >= SILENCE
    row, n = row[voiced], np.bincount(row[voiced], minlength=len(v))
    measures = np.column_stack([np.log1p(bands), crossings / FRAME, rms, np.log1p(np.maximum(high, 0)) - np.log1p(np.maximum(low, 0))])[voiced]
    means = np.stack([np.bincount(row, m, minlength=len(v)) for m in measures.T], axis=1) / np.maximum(n, 1)[:, None]
    own = np.hstack([means, np.diff(means[:, :BANDS], axis=1)])
    i = np.arange(DIMENSIONS)
    out = own[:, i % own.shape[1]] * (1 + 0.07 * np.sin(1.7 * i))
    size = np.sqrt((out**2).sum(axis=1))
    out /= np.where(size == 0, 1.0, size)[:, None]
    enough = n >= LEAST_FRAMES
    ends = np.concatenate([[0], np.cumsum(np.where(enough, DIMENSIONS, 0))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out[enough].ravel()), mask=pa.array(~enough))


def _blocks(n: Column, share: float, most: int, draw) -> Column:
    """Ranges (start, end) that are masked among n places: as many as share x n / most, one at least, each of 1 to `most` places; those
    that would leave nothing are left out. draw(k, i) is a whole number for block k."""
    times = F.greatest(F.lit(1), F.floor(F.lit(share) * n / max(1, most)).cast("int"))

    def block(k: Column) -> Column:
        length = (draw(k, 0) % most + 1).cast("int")
        start = (draw(k, 1) % F.greatest(n - length + 1, F.lit(1))).cast("int")
        return F.when(length < n, F.struct(start.alias("start"), (start + length).alias("end")))

    return F.filter(F.transform(F.sequence(F.lit(0), times - 1), block), lambda b: b.isNotNull())


def masked(features: Column, key: Column, seed: str = "mask", time_share: float = 0.05, time_most: int = 10, band_share: float = 0.05, band_most: int = 16) -> Column:
    """An array of bands, each an array of values over time (as long as the first band), with blocks of time and blocks of bands set to 0.

    Where the blocks lie is decided by the MD5 of seed, key and the block's number, so every run masks the same cells. Null stays null."""
    draw = lambda kind: lambda k, i: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), key.cast("string"), F.lit(kind), k.cast("string"))), 1 + 8 * i, 8), 16, 10).cast("long")
    hit = lambda blocks, i: F.exists(blocks, lambda b: (i >= b["start"]) & (i < b["end"]))
    size = F.coalesce(F.size(F.get(features, F.lit(0))), F.lit(0))
    flags = lambda blocks, n: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: hit(blocks, i))).otherwise(F.array().cast("array<boolean>"))
    whole = F.struct(features.alias("f"), flags(_blocks(size, time_share, time_most, draw("t")), size).alias("t"), _blocks(F.size(features), band_share, band_most, draw("b")).alias("b"))

    def cover(w: Column) -> Column:  # the blocks are made once, not for every cell
        zero = lambda x: x * 0
        return F.transform(w["f"], lambda row, band: F.when(hit(w["b"], band), F.transform(row, zero)).otherwise(F.transform(row, lambda x, at: F.when(F.get(w["t"], at), zero(x)).otherwise(x))))

    return F.when(features.isNotNull(), F.get(F.transform(F.array(whole), cover), F.lit(0)))
