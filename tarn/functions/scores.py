"""Scalar functions over choice scores and loosely typed fields, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LABELS = [chr(65 + i) for i in range(26)]


def missing(c: Column) -> Column:
    """Null or blank."""
    return c.isNull() | (F.trim(c.cast("string")) == "")


def finite(c: Column) -> Column:
    """Double, null where it does not parse or is not finite."""
    x = c.try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def lenient_bool(c: Column) -> Column:
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.isin("true", "1", "yes"), True).when(t.isin("false", "0", "no"), False)


def dose(c: Column) -> Column:
    """Canonical dose: numbers by value (2.0 is 2, 0.50 is 0.5), other texts such as 'all' trimmed, '<missing>' for nothing."""
    x = finite(c.cast("string"))
    number = F.when(x == F.floor(x), F.format_string("%.0f", x)).otherwise(x.cast("string"))
    return F.when(missing(c), "<missing>").otherwise(F.coalesce(number, F.trim(c.cast("string"))))


def softmax(nll: Column) -> Column:
    """Probabilities of negative log-likelihoods (array), stable; null if any is null, negative or not finite."""
    least = F.array_min(nll)
    ok = F.forall(nll, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x < float("inf")))
    # the sum is bound once, as the state that the last step receives
    shares = F.aggregate(nll, F.lit(0.0), lambda a, x: a + F.exp(least - x), lambda z: F.transform(nll, lambda x: F.exp(least - x) / z))
    return F.when((F.size(nll) >= 2) & ok, shares)


def predicted_index(nll: Column) -> Column:
    """1-based place of the smallest value, the first on ties."""
    return F.array_position(nll, F.array_min(nll)).cast("int")


def gold_margin(nll: Column, gold: Column) -> Column:
    """Best distractor minus gold; gold is a 1-based place."""
    others = F.filter(nll, lambda x, i: (i + 1) != gold)
    return F.array_min(others) - F.get(nll, gold - 1) + F.lit(0.0)


def brier(p: Column, gold: Column) -> Column:
    return F.aggregate(F.transform(p, lambda x, i: F.pow(x - F.when(i + 1 == gold, 1.0).otherwise(0.0), F.lit(2.0))), F.lit(0.0), lambda a, b: a + b)


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """The Wilson score interval, within [0, 1]; (0, 0) for n = 0."""
    p = k / n
    d = 1 + z * z / n
    mid, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    lo, hi = F.greatest(F.lit(0.0), (mid - half) / d), F.least(F.lit(1.0), (mid + half) / d)
    return F.when(n == 0, 0.0).otherwise(lo), F.when(n == 0, 0.0).otherwise(hi)


def stable_id(*parts: Column) -> Column:
    """First 20 hex digits of the SHA-1 of the parts as texts joined by ::; a missing part is the text None, not left out."""
    return F.substring(F.sha1(F.concat_ws("::", *(F.coalesce(p.cast("string"), F.lit("None")) for p in parts))), 1, 20)


def hash_rank(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256)
