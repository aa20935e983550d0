"""Edits between two sequences, bit-parallel: a column of the distance table is two integers with a bit for each element.

A pair of n and m elements costs n x m / 64 steps of an integer's limbs, and O(n + m) memory beside BITS bits."""

from __future__ import annotations

from collections.abc import Hashable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of the table that are kept for walking back through it; beyond that the pair is halved first.
BITS = 1 << 28
KINDS = ("substitutions", "deletions", "insertions")


def _table(a: Sequence[Hashable], b: Sequence[Hashable], keep: list | None = None) -> tuple[int, int, int]:
    """The distance of all of a from all of b, and the last column's rises and falls from each element of a to the next.

    `keep` gets each column's two integers as bytes."""
    places: dict[Hashable, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    m = len(a)
    full, top, distance = (1 << m) - 1, m - 1, m
    up, down = full, 0
    for y in b:
        equal = places.get(y, 0)
        same = ((((equal & up) + up) ^ up) | equal | down) & full
        right, left = down | (full ^ (same | up)), same & up
        distance += (right >> top & 1) - (left >> top & 1)
        right, left = right << 1 & full | 1, left << 1 & full
        up, down = left | (full ^ (same | right)), right & same
        if keep is not None:
            keep.append((up.to_bytes((m + 7) // 8, "little"), down.to_bytes((m + 7) // 8, "little")))
    return distance, up, down


def _core(a: Sequence, b: Sequence) -> tuple[Sequence, Sequence]:
    """a and b without what they begin and end with alike."""
    start, end = 0, 0
    least = min(len(a), len(b))
    while start < least and a[start] == b[start]:
        start += 1
    while end < least - start and a[-1 - end] == b[-1 - end]:
        end += 1
    return a[start : len(a) - end], b[start : len(b) - end]


def distance(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """Fewest insertions, deletions and substitutions that make a into b."""
    a, b = _core(a, b)
    if len(a) < len(b):
        a, b = b, a  # the longer one as bits: fewer, longer steps
    return _table(a, b)[0] if b else len(a)


def operations(a: Sequence[Hashable], b: Sequence[Hashable]) -> tuple[int, int, int]:
    """Substitutions, deletions and insertions of an alignment with the fewest edits that make a into b; the same pair always gets the
    same one. Their sum is distance(a, b), deletions less insertions are len(a) - len(b)."""
    total, work = [0, 0, 0], [(a, b)]
    while work:
        a, b = _core(*work.pop())
        if not a or not b:
            total[1] += len(a)
            total[2] += len(b)
        elif 2 * len(a) * len(b) > BITS and len(b) > 1:
            half = len(b) // 2
            ahead, behind = _sums(a, b[:half]), _sums(a[::-1], b[half:][::-1])[::-1]
            cut = int((ahead + behind).argmin())
            work += [(a[:cut], b[:half]), (a[cut:], b[half:])]
        else:
            for i, n in enumerate(_walk(a, b)):
                total[i] += n
    return total[0], total[1], total[2]


def _sums(a: Sequence, b: Sequence) -> np.ndarray:
    """Distances of all beginnings of a from all of b."""
    _, up, down = _table(a, b)
    bits = lambda x: np.unpackbits(np.frombuffer(x.to_bytes((len(a) + 7) // 8, "little"), np.uint8), bitorder="little")[: len(a)].astype(np.int64)
    return len(b) + np.concatenate([[0], np.cumsum(bits(up) - bits(down))])


def _walk(a: Sequence, b: Sequence) -> tuple[int, int, int]:
    """Back from the end: a deletion where the table rises to the element of a, an insertion where it fell to it in the column before,
    else both elements."""
    columns: list[tuple[bytes, bytes]] = []
    _table(a, b, columns)
    i, j, changed, gone, new = len(a), len(b), 0, 0, 0
    while i and j:
        byte, bit = (i - 1) >> 3, 1 << ((i - 1) & 7)
        if columns[j - 1][0][byte] & bit:
            i, gone = i - 1, gone + 1
        elif j > 1 and columns[j - 2][1][byte] & bit:
            j, new = j - 1, new + 1
        else:
            i, j = i - 1, j - 1
            changed += a[i] != b[j]
    return changed, gone + i, new + j


def _pairs(a: pa.Array, b: pa.Array):
    """The elements of each pair, as numbers of the batch's distinct ones for lists, as characters for texts; null where one is null."""
    if pa.types.is_string(a.type):
        yield from zip(a.to_pylist(), b.to_pylist(), strict=True)
        return
    known: dict = {}
    for x, y in zip(a, b, strict=True):
        x, y = x.as_py(), y.as_py()
        yield tuple(None if v is None else [known.setdefault(e, len(known)) for e in v] for v in (x, y))


@F.arrow_udf(T.LongType())
def distance_of(a: pa.Array, b: pa.Array) -> pa.Array:
    """distance() of two columns of texts (by characters) or arrays; null if one is."""
    return pa.array([None if x is None or y is None else distance(x, y) for x, y in _pairs(a, b)], pa.int64())


@F.arrow_udf(T.StructType([T.StructField(k, T.LongType()) for k in KINDS]))
def operations_of(a: pa.Array, b: pa.Array) -> pa.Array:
    """operations() of two columns of texts or arrays; null if one is."""
    found = [None if x is None or y is None else dict(zip(KINDS, operations(x, y), strict=True)) for x, y in _pairs(a, b)]
    return pa.array(found, pa.struct([(k, pa.int64()) for k in KINDS]))
