"""Statistics of paired, permuted and multi-part trial designs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def role_pairs(rows: DataFrame, keys: list[str], role: str, first: str, second: str) -> DataFrame:
    """One row a key: how many rows each of two roles has, and both rows' prediction, correct and gold.

    A key is complete with one row a role; with more it is ambiguous. One shuffle, no self-join.
    """
    side = lambda r, c: F.max(F.when(F.col(role) == r, F.col(c)))
    return rows.where(F.col(role).isin(first, second)).groupBy(*keys).agg(
        F.count_if(F.col(role) == first).alias("n1"), F.count_if(F.col(role) == second).alias("n2"),
        *(side(r, c).alias(f"{c}{i}") for i, r in ((1, first), (2, second)) for c in ("prediction", "correct", "gold")),
    )


PAIR_METRICS = ["both_correct", "semantic_flip", "correct_semantic_flip", "invariance", "correct_invariance"]


def pair_observations(pairs: DataFrame) -> DataFrame:
    """role_pairs with `whole` (one row of each role) and, where it holds, every pair metric as 0 or 1."""
    both = (F.col("correct1") == 1) & (F.col("correct2") == 1)
    flip, gold_flip = F.col("prediction1") != F.col("prediction2"), F.col("gold1") != F.col("gold2")
    seen = pairs.withColumn("whole", (F.col("n1") == 1) & (F.col("n2") == 1))
    found = zip(PAIR_METRICS, (both, flip, both & flip & gold_flip, ~flip, both & ~flip & ~gold_flip))
    return seen.withColumns({name: F.when(F.col("whole"), c.cast("int")) for name, c in found})


def pair_metrics(pairs: DataFrame, group: list[str]) -> DataFrame:
    """Flip and invariance rates of role_pairs over complete keys, with coverage and ambiguity."""
    return pair_observations(pairs).groupBy(*group).agg(
        F.count("*").alias("expected_units"), F.count_if("whole").alias("complete_units"), F.count_if((F.col("n1") > 1) | (F.col("n2") > 1)).alias("ambiguous_units"),
        (F.count_if("whole") / F.count("*")).alias("coverage"), *(F.avg(m).alias(m) for m in PAIR_METRICS),
    )


def votes(rows: DataFrame, keys: list[str], prediction: str) -> DataFrame:
    """Per key: rows and the modal share of its predictions. Counts go before keys, so a hot key is summed early."""
    by = rows.groupBy(*keys, prediction).agg(F.count("*").alias("n"))
    return by.groupBy(*keys).agg(F.sum("n").alias("rows"), F.max("n").alias("modal"), F.count("*").alias("predictions"))


def permutation_units(rows: DataFrame, keys: list[str], expected: int) -> DataFrame:
    """Per key: complete (each of the expected permutations once), consistent, stability, all_correct."""
    by = rows.groupBy(*keys, "prediction").agg(F.count("*").alias("n"), F.collect_set("permutation").alias("p"), F.min("correct").alias("c"))
    units = by.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.max("n").alias("modal"), F.count("*").alias("predictions"),
        F.size(F.array_distinct(F.flatten(F.collect_list("p")))).alias("permutations"), F.min("c").alias("all_correct"),
    )
    return units.select(
        *keys, ((F.col("n") == expected) & (F.col("permutations") == expected)).alias("complete"), (F.col("predictions") == 1).cast("int").alias("consistent"),
        (F.col("modal") / F.col("n")).alias("stability"), "all_correct",
    )


def option_votes(rows: DataFrame, question: list[str], candidate: str, choices: int) -> DataFrame:
    """Exact-set scoring: mean probability of each option over permutations, a unique best one per candidate, all
    candidates right per question. Rows have probability (array), permutation (a cyclic shift), gold (1-based, unshifted).

    Returns per question: candidates, tied (without a unique best option), exact (0 or 1).
    """
    option = (F.col("place") + F.col("permutation")) % choices + 1
    each = rows.select(*question, candidate, "permutation", "gold", F.posexplode("probability").alias("place", "p"))
    mean = each.groupBy(*question, candidate, option.alias("option")).agg(F.avg("p").alias("p"), F.min("gold").alias("gold"))
    mean = mean.withColumn("p", F.round("p", 9))
    best = mean.groupBy(*question, candidate).agg(F.max(F.struct("p", "option")).alias("top"), F.collect_list("p").alias("all"), F.min("gold").alias("gold"))
    best = best.withColumn("unique", F.size(F.filter("all", lambda x: x == F.col("top.p"))) == 1)
    return best.groupBy(*question).agg(
        F.count("*").alias("candidates"), F.count_if(~F.col("unique")).alias("tied"), F.min((F.col("unique") & (F.col("top.option") == F.col("gold"))).cast("int")).alias("exact"))


def dose_contrast(rows: DataFrame, left: str, right: str, strata: list[str], keys: list[str], unit: str) -> DataFrame:
    """left minus right where doses matter: in strata whose right condition has several doses rows meet at equal doses,
    elsewhere the right condition's single dose serves every dose of the left. Keys with several rows on a side drop out."""
    chosen = rows.where(F.col("condition").isin(left, right))
    several = chosen.where(F.col("condition") == right).groupBy(*strata).agg((F.min("dose") != F.max("dose")).alias("several"))
    tagged = chosen.join(several, strata).withColumn("at", F.when(F.col("several"), F.col("dose")))

    def side(c: str, by: list[str]) -> DataFrame:
        names = ["correct", "margin", *(["at"] if "at" not in by else [])]
        one = tagged.where(F.col("condition") == c).groupBy(*strata, *keys, *by).agg(F.count("*").alias("n"), *(F.max(x).alias(x) for x in names))
        return one.where("n = 1").drop("n")

    a, b = side(left, [unit, "dose"]).alias("a"), side(right, [unit, "at"]).alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*strata, *keys, unit]] + [F.col("a.at").eqNullSafe(F.col("b.at"))]
    pairs = a.join(b, on).select(
        *(F.col(f"a.{s}") for s in [*strata, unit]), F.col("a.at").isNotNull().alias("matched"),
        *((F.col(f"a.{x}") - F.col(f"b.{x}")).alias(x) for x in ("correct", "margin")))
    units = pairs.groupBy(*strata, "matched", unit).agg(F.count("*").alias("n"), F.avg("correct").alias("a"), F.avg("margin").alias("m"))
    return units.groupBy(*strata).agg(
        F.when(F.bool_or("matched"), "matched_requested_dose").otherwise("broadcast_single_dose").alias("dose_alignment"),
        F.sum("n").alias("aligned_rows"), F.count("*").alias("units"), F.avg("a").alias("accuracy_gain"), F.avg("m").alias("margin_gain"))


def score_issues(rows: DataFrame, tolerance: float = 2e-6) -> DataFrame:
    """Rows with a `kind` for each way in which reported_* fields disagree with those derived from nll by scored()."""
    far = lambda a, b: F.abs(a - b) > tolerance * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))
    rules: list[tuple[str, Column]] = [
        ("invalid_nll", F.col("prediction").isNull()),
        ("prediction_mismatch", F.col("prediction") != F.col("reported_prediction")),
        ("correct_mismatch", F.col("correct") != F.col("reported_correct")),
        ("margin_mismatch", far(F.col("margin"), F.col("reported_margin"))),
    ]
    kinds = F.array_compact(F.array(*(F.when(rule, kind) for kind, rule in rules)))
    return rows.withColumn("kind", F.explode(kinds))


def histograms(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Row counts by each of the columns alone, in one pass: field, value, rows."""
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns))
    return rows.select(F.explode(pairs).alias("x")).groupBy("x.field", "x.value").agg(F.count("*").alias("rows"))
