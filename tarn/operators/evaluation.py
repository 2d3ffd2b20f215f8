"""Evaluation statistics: scoring, two-level summaries, calibration, contrasts, dose curves, bootstrap intervals.

Input rows: trial_id, base_id, permutation, cluster, dataset, condition, dose, nll array<double>, gold (1-based place).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S


def scored(rows: DataFrame) -> DataFrame:
    """Adds probability, prediction, correct, margin, brier, confidence, confidence_brier; rows with bad scores get nulls."""
    out = rows.withColumn("probability", S.softmax(F.col("nll")))
    out = out.withColumn("prediction", F.when(F.col("probability").isNotNull(), S.predicted_index(F.col("nll"))))
    out = out.withColumns({
        "correct": F.when(F.col("prediction").isNotNull(), (F.col("prediction") == F.col("gold")).cast("int")),
        "margin": F.when(F.col("prediction").isNotNull(), S.gold_margin(F.col("nll"), F.col("gold"))),
        "brier": S.brier(F.col("probability"), F.col("gold")),
        "confidence": F.get("probability", F.col("prediction") - 1),
    })
    return out.withColumn("confidence_brier", F.pow(F.col("confidence") - F.col("correct"), F.lit(2.0)))


def summary(rows: DataFrame, group: list[str], unit: str = "base_id") -> DataFrame:
    """Row means and means of unit means, in one shuffle by group and unit and one by group."""
    units = rows.groupBy(*group, unit).agg(
        F.count("*").alias("n"), F.sum("correct").alias("c"), F.avg("correct").alias("a"), F.avg("margin").alias("m"),
        F.avg("brier").alias("b"), F.avg("confidence_brier").alias("cb"), F.min("correct").alias("all_correct"), F.sum("margin").alias("ms"),
    )
    return units.groupBy(*group).agg(
        F.sum("n").alias("rows"), F.count("*").alias("units"), (F.sum("c") / F.sum("n")).alias("accuracy_rows"), F.avg("a").alias("accuracy"),
        F.avg("m").alias("gold_margin"), F.avg("b").alias("brier"), F.avg("cb").alias("confidence_brier"), F.avg("all_correct").alias("all_rows_correct"),
    )


def calibration_error(rows: DataFrame, group: list[str], bins: int = 10) -> DataFrame:
    """Expected calibration error over equal-width confidence bins, the top bin closed."""
    place = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1))
    by = rows.where("confidence IS NOT NULL AND correct IS NOT NULL").groupBy(*group, place.alias("bin")).agg(F.count("*").alias("n"), F.sum(F.col("correct") - F.col("confidence")).alias("gap"))
    return by.groupBy(*group).agg((F.sum(F.abs("gap")) / F.sum("n")).alias("ece"), F.sum("n").alias("rows"))


def contrast(rows: DataFrame, left: str, right: str, keys: list[str], unit: str) -> DataFrame:
    """left minus right on aligned rows, averaged by unit and then over units. Ambiguous keys take no part.

    Both sides come from one scan: conditional aggregates by key replace the self-join.
    """
    side = lambda c, what: F.max(F.when(F.col("condition") == c, F.col(what)))
    count = lambda c: F.count_if(F.col("condition") == c)
    by = rows.where(F.col("condition").isin(left, right)).groupBy(*keys, unit).agg(
        count(left).alias("nl"), count(right).alias("nr"), *(side(c, w).alias(f"{w}_{s}") for s, c in (("l", left), ("r", right)) for w in ("correct", "margin"))
    )
    pairs = by.where("nl = 1 AND nr = 1")
    units = pairs.groupBy(unit).agg(F.count("*").alias("n"), F.avg(F.col("correct_l") - F.col("correct_r")).alias("a"), F.avg(F.col("margin_l") - F.col("margin_r")).alias("m"))
    return units.agg(F.sum("n").alias("aligned_rows"), F.count("*").alias("units"), F.avg("a").alias("accuracy_gain"), F.avg("m").alias("margin_gain")).select(F.lit(f"{left}_minus_{right}").alias("contrast"), "*")


def dose_curve(points: DataFrame, group: list[str], dose: str, gain: str, share: float = 0.9) -> DataFrame:
    """Adds dose_index, the running largest gain, the threshold (share of the largest) and whether the dose is the first to reach it."""
    w = Window.partitionBy(*group).orderBy(dose)
    top = F.max(gain).over(Window.partitionBy(*group))
    out = points.withColumns({"dose_index": F.row_number().over(w), "running_gain": F.max(gain).over(w), "threshold": F.when(top > 0, top * share)})
    reached = (F.col("running_gain") >= F.col("threshold")) & (F.coalesce(F.lag("running_gain").over(w), F.lit(float("-inf"))) < F.col("threshold"))
    return out.withColumn("first_at_share", F.coalesce(reached, F.lit(False)))


def bootstrap_interval(rows: DataFrame, value: str, cluster: str, replicates: int, seed: int = 42, level: float = 0.95) -> DataFrame:
    """estimate, low, high of the mean over cluster resamples."""
    from . import resampling

    sums = rows.where(F.col(value).isNotNull()).groupBy(cluster).agg(F.sum(value).alias("num_mean"), F.count(value).cast("double").alias("den_mean"))
    out = resampling.intervals(sums, [], cluster, ["mean"], replicates, seed, level)
    return out.select(F.col("mean").alias("estimate"), F.col("mean_ci_low").alias("low"), F.col("mean_ci_high").alias("high"))


def expanded(bases: DataFrame, conditions: DataFrame, choices: int) -> DataFrame:
    """Base rows for every condition and cyclic shift of the choices; conditions are a small, configured table."""
    out = bases.join(F.broadcast(conditions), bases.kind == conditions.for_kind)
    out = out.withColumn("shift", F.explode(F.sequence(F.lit(0), F.lit(choices - 1))))
    return out.withColumn("answer", (F.col("gold") - 1 + F.col("shift")) % choices + 1)


def ranked(table: DataFrame, metrics: list[str], inverted: list[str], name: str) -> DataFrame:
    """Min-max scaled metrics (a constant one is 0 before an inversion, so 1 after it), their mean and the order by it."""
    whole = Window.partitionBy()  # a report table: one row a system
    scale = {}
    for m in metrics:
        low, high = F.min(m).over(whole), F.max(m).over(whole)
        x = F.when(high > low, (F.col(m) - low) / (high - low)).otherwise(0.0)
        scale[f"{m}_scaled"] = 1 - x if m in inverted else x
    out = table.withColumns(scale)
    out = out.withColumn("overall", sum(F.col(c) for c in scale) / len(scale))
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("overall"), name)))


def label_questions(rows: DataFrame, key: str, label: str, distractors: int, broadcast_labels: int = 100_000) -> DataFrame:
    """Multiple-choice rows from labels: the answer and `distractors` other labels (all, if fewer), in the order of a digest.

    The distinct labels stand in a ring by their digests; a row takes the next ones from a place that its key's digest
    gives. So a row looks at distractors + 1 labels, however many there are; the numbered labels are broadcast up to
    `broadcast_labels` and joined by shuffle beyond. Keys are unique. Adds choices and answer (a letter).
    """
    from ..functions.digests import hex_mod, numbered

    usable = rows.where(F.col(label).isNotNull())
    digest = lambda x, *salt: F.sha2(F.concat_ws("|", *salt, x), 256)
    ring = numbered(usable.select(F.col(label).alias("__x")).distinct().withColumn("__h", digest(F.col("__x"))), ["__h", "__x"]).drop("__h")
    ring = ring.withColumnRenamed("number", "__at")
    size = ring.count()
    places = F.transform(F.sequence(F.lit(0), F.lit(max(0, min(distractors, size - 1)))), lambda j: (F.col("__from") + j) % max(1, size))
    asked = usable.select(key, F.col(label).alias("__own"), hex_mod(F.substring(digest(F.col(key).cast("string")), 1, 15), max(1, size)).alias("__from"))
    asked = asked.withColumn("__places", places).select(key, "__own", F.posexplode("__places").alias("__n", "__at"))
    met = asked.join(F.broadcast(ring) if size <= broadcast_labels else ring, "__at").where("__x <> __own")
    near = met.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct("__n", "__x"))), 1, distractors).alias("__near"))
    out = usable.join(near, key, "left")
    others = F.coalesce(F.transform("__near", lambda t: t["__x"]), F.array().cast("array<string>"))
    shown = F.transform(F.concat(others, F.array(label)), lambda x: F.struct(digest(x, F.lit("order"), F.col(key).cast("string")).alias("h"), x.alias("x")))
    out = out.withColumn("choices", F.transform(F.array_sort(shown), lambda t: t.x)).drop("__near")
    return out.withColumn("answer", F.char(F.array_position("choices", F.col(label)) + 64))


