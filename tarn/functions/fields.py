"""Loosely typed fields as Column expressions: identifiers, numbers, digests, units, sort keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scores import dose, finite, missing

#: White space in the sense of Unicode, as a regular expression.
SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Spellings of the units of a time span (fixed values).
SECONDS = ("s", "sec", "secs", "second", "seconds")
NORMALIZED = ("norm", "normalized", "relative", "fraction", "fractions")


def present(*values: Column) -> Column:
    """The first value that is neither null nor blank."""
    return F.coalesce(*(F.when(~missing(v), v) for v in values))


def collapsed(c: Column) -> Column:
    """White space runs as one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def folded(c: Column) -> Column:
    """Case folded with white space collapsed: lower case of upper case, so that sharp s and ligatures fold as well.

    The translation in between keeps the optimizer from dropping the upper case; the last one undoes final sigma.
    """
    return F.translate(F.lower(F.translate(F.upper(collapsed(c)), "\u017f", "S")), "\u03c2", "\u03c3")


def group_value(c: Column, nested: bool = False) -> Column:
    """A grouping key: '<missing>' for null or blank, JSON text of nested values."""
    text = F.to_json(c) if nested else c.cast("string")
    return F.when(c.isNull() | (F.trim(text) == ""), "<missing>").otherwise(text)


def positive_int(c: Column) -> Column:
    """A whole number of at least one, written without sign, fraction or exponent; else null."""
    text = F.trim(c.cast("string"))
    return F.when(text.rlike("^0*[1-9][0-9]*$"), text.try_cast("bigint"))


def permutation_key(c: Column) -> Column:
    """1.0, '1' and 1 are one permutation; null is 0, other texts stand for themselves."""
    x = finite(F.coalesce(c.cast("string"), F.lit("0")))
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(c.cast("string"))


def sort_key(c: Column) -> Column:
    """Numbers first, by value, then texts; 'all' is a text."""
    x = F.when(F.lower(c.cast("string")) != "all", finite(c.cast("string")))
    return F.struct(x.isNull().alias("is_text"), x.alias("number"), F.when(x.isNull(), c.cast("string")).alias("text"))


def dose_order(requested: Column, effective_mean: Column) -> Column:
    """By mean effective dose, missing last, then by the requested dose."""
    return F.struct(F.coalesce(effective_mean, F.lit(float("inf"))).alias("effective"), sort_key(dose(requested)).alias("requested"))


def is_sha256(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9a-f]{64}$"), F.lit(False))


def locked_sha256(c: Column) -> Column:
    """A SHA-256 in lower case, trimmed; null if it is none."""
    text = F.lower(F.trim(c.cast("string")))
    return F.when(is_sha256(text), text)


def span_unit(c: Column) -> Column:
    """seconds or normalized from their spellings; null for others."""
    text = F.replace(F.lower(F.trim(c)), F.lit("-"), F.lit("_"))
    return F.when(text.isin(*SECONDS), "seconds").when(text.isin(*NORMALIZED), "normalized")


def integer_answer(value: Column, choices: Column, base: int) -> Column:
    """The letter of a 0- or 1-based choice number; null outside the choices."""
    i = value.cast("int") - base
    return F.when((i >= 0) & (i < F.size(choices)), F.char(i + 65))


def id_component(c: Column, fallback: Column | None = None) -> Column:
    """A scalar identifier as trimmed text; null (or the fallback) for blank and, by type, booleans."""
    text = F.trim(c.cast("string"))
    kept = F.when((text != "") & (F.typeof(c) != "boolean"), text)
    return kept if fallback is None else F.coalesce(kept, fallback.cast("string"))


def inside(root: Column, path: Column) -> Column:
    """Whether a normalised path lies under a root."""
    bare = F.regexp_replace(root, "/+$", "")
    return (path == bare) | (path.startswith(F.concat(bare, F.lit("/"))) & ~path.rlike(r"(^|/)\.\.(/|$)"))


def value_text(values: Column, place: int = 0) -> Column:
    """The text at a place of a list, the place held within it; null for an empty list."""
    at = F.greatest(F.least(F.lit(place), F.size(values) - 1), F.lit(0))
    return F.when(F.size(values) > 0, F.trim(F.get(values, at)))


def task_name(root: str, path: Column) -> Column:
    """Path below a root, without suffix, parts joined by '/'."""
    below = F.regexp_replace(path, "^(?:file:)?/*" + root.strip("/") + "/+", "")
    return F.regexp_replace(below, r"\.[^./]+$", "")


def strictly_increasing(values: Column) -> Column:
    pairs = F.zip_with(F.slice(values, F.lit(1), F.greatest(F.size(values) - 1, F.lit(0))), F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))), lambda a, b: a < b)
    return F.forall(pairs, lambda ok: F.coalesce(ok, F.lit(False)))


def valid_indices(values: Column, total: Column) -> Column:
    """Whether all indices lie in [0, total) and there is one."""
    return (F.size(values) > 0) & F.forall(values, lambda i: F.coalesce((i >= 0) & (i < total), F.lit(False)))


def shard_key(resampling: Column, pair: Column, role: Column, independent: Column, record: Column) -> Column:
    """What keeps dependent records in one shard: resampling unit, pair family of paired roles, independent unit, own id."""
    paired = F.when(F.lower(role).isin("original", "counterfactual", "nuisance"), pair)
    filled = lambda c: F.when(c != "", c)
    return F.coalesce(*(filled(c.cast("string")) for c in (resampling, paired, independent, record)), F.lit("<missing>"))


def unit_id(pair: Column, role: Column, independent: Column, base: Column, trial: Column) -> Column:
    """The aggregation unit of a row: pair family, independent unit, base record or trial."""
    paired = F.when(~missing(pair) & F.lower(F.coalesce(role, F.lit(""))).isin("original", "counterfactual", "nuisance"), F.concat(F.lit("pair::"), pair.cast("string")))
    named = lambda kind, c: F.when(~missing(c), F.concat(F.lit(f"{kind}::"), c.cast("string")))
    return F.coalesce(paired, named("independent", independent), named("base", base), F.concat(F.lit("trial::"), F.coalesce(trial.cast("string"), F.lit("<missing>"))))


def cluster_id(resampling: Column, unit: Column) -> Column:
    """The resampling cluster of a row."""
    return F.when(~missing(resampling), F.concat(F.lit("resampling::"), resampling.cast("string"))).otherwise(unit)


def reference_condition(channel: Column, condition: Column, visual: str) -> Column:
    """The condition that a dose is measured against, by its input channel; by its name where that is missing."""
    c, name = F.lower(F.trim(F.coalesce(channel, F.lit("")))), F.lower(F.trim(F.coalesce(condition, F.lit(""))))
    unnamed = F.when(name.contains("video_plus") | name.contains("visual_plus"), visual).when(name.contains("oracle"), "question_only").otherwise(visual)
    return F.when(c.isin("text_oracle", "embedding_oracle"), "question_only").when(c.isin("", "<missing>"), unnamed).otherwise(F.lit(visual))


def single_value(c: Column) -> Column:
    """Aggregate: the one value that occurs, '<mixed>' for several, '<missing>' for none."""
    filled = F.when(~missing(c), c.cast("string"))
    return F.when(F.min(filled).isNull(), "<missing>").when(F.min(filled) == F.max(filled), F.min(filled)).otherwise("<mixed>")


def unique_count(c: Column) -> Column:
    """Aggregate: different values that are neither null nor blank."""
    return F.count_distinct(F.when(~missing(c), c.cast("string")))


def any_of(*tests: Column) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))
