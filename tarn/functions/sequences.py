"""Selections from ordered arrays (frames, segments) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def evenly(items: Column, k: int) -> Column:
    """k evenly spaced items with both ends, places rounded half to even; the one at half the count for k = 1; none of an empty array."""
    last = F.size(items) - 1
    if k == 1:
        picked = F.array(F.get(items, F.floor(F.size(items) / 2).cast("int")))
    else:
        picked = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda s: F.get(items, F.bround(s * last / (k - 1), 0).cast("int")))
    return F.when(last < 0, F.filter(items, lambda x: F.lit(False))).otherwise(picked)


def strided(items: Column, step: int = 2) -> Column:
    return F.filter(items, lambda x, i: i % step == 0)


def swapped_halves(items: Column) -> Column:
    """The second half before the first; the middle item of an odd count belongs to the second half."""
    half = F.floor(F.size(items) / 2).cast("int")
    return F.concat(F.slice(items, half + 1, F.size(items)), F.slice(items, F.lit(1), half))


def segments(items: Column, n: int) -> Column:
    """n contiguous parts with bounds rounded half to even; a part that would be empty has the item at its bound, or the last one."""
    bound = lambda j: F.bround(j * F.size(items) / n, 0).cast("int")
    size = lambda j: F.greatest(bound(j + 1) - bound(j), F.lit(1))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.slice(items, F.least(bound(j), F.size(items) - 1) + 1, size(j)))


def shifted(items: Column) -> Column:
    """Rotated by half the count."""
    return swapped_halves(items)


def hash_shuffled(items: Column, *key: Column) -> Column:
    """An order fixed by a key: items by the digest of key and place."""
    tagged = F.transform(items, lambda x, i: F.struct(F.sha2(F.concat_ws("|", *(k.cast("string") for k in key), i.cast("string")), 256).alias("h"), x.alias("x")))
    return F.transform(F.array_sort(tagged), lambda t: t.x)
