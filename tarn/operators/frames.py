"""Frame views over a frame clock: which source frames a model sees, as index arithmetic on arrays.

A clock is `total_frames`, `fps`, `duration_sec` and, for variable rates, `intervals` (array of struct(start, end), one a
frame, in presentation order; null: constant rate). Spans are half-open, in seconds or as shares of the duration.
"""

from __future__ import annotations

import hashlib
import json
import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from ..functions import fields as X
from ..functions.sequences import evenly

#: Fixed values.
VIEWS = ["full", "single", "reverse", "shuffle", "evidence_only", "evidence_present", "evidence_removed", "random_position_mask", "random_matched"]
NEEDS_EVIDENCE = ["evidence_only", "evidence_present", "evidence_removed", "random_position_mask", "random_matched"]
EPSILON = 1e-9
_INDICES = ArrayType(IntegerType())
_WINDOWS = StructType([StructField("windows", ArrayType(StructType([StructField("start", DoubleType()), StructField("end", DoubleType())]))), StructField("strategy", StringType())])
CLOCK = "total_frames int, fps double, duration_sec double, intervals array<struct<start:double,end:double>>, timestamp_source string"


def clock_issues(total: Column, fps: Column, duration: Column, intervals: Column, source: Column) -> Column:
    """What is wrong with a frame clock: an array of texts."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    slack = F.greatest(F.lit(EPSILON), duration * EPSILON)
    ordered = F.forall(F.zip_with(F.slice(intervals, F.lit(1), F.greatest(F.size(intervals) - 1, F.lit(0))), F.slice(intervals, F.lit(2), F.greatest(F.size(intervals) - 1, F.lit(0))), lambda a, b: (F.greatest(a["start"], F.lit(0.0)) <= F.greatest(b["start"], F.lit(0.0))) & (a["end"] <= b["end"])), lambda ok: F.coalesce(ok, F.lit(False)))
    sound = F.forall(intervals, lambda x: finite(x["start"]) & finite(x["end"]) & (x["start"] >= -slack) & (x["end"] > F.greatest(x["start"], F.lit(0.0))) & (x["end"] <= duration + slack))
    constant = total / fps
    rules = [
        (~F.coalesce(total > 0, F.lit(False)), "total_frames must be positive"), (~F.coalesce(finite(fps) & (fps > 0), F.lit(False)), "fps must be finite and positive"), (~F.coalesce(finite(duration) & (duration > 0), F.lit(False)), "duration_sec must be finite and positive"),
        (intervals.isNotNull() & (F.size(intervals) != total), "there must be one interval per frame"), (intervals.isNotNull() & ~sound, "intervals must be finite, positive and within the duration"), (intervals.isNotNull() & ~ordered, "intervals must be in presentation order"),
        (source.isNotNull() & (F.trim(source) == ""), "timestamp_source must not be blank"),
        (intervals.isNull() & (timestamp_source(intervals, source, F.lit(None).cast("string")) == "declared_cfr") & (F.abs(duration - constant) > F.greatest(F.lit(EPSILON), constant * EPSILON)), "a declared constant rate requires duration_sec == total_frames / fps"),
    ]
    return F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), message) for test, message in rules)))


def timestamp_source(intervals: Column, given: Column, backend: Column) -> Column:
    return F.coalesce(F.trim(given), F.when(intervals.isNotNull(), "explicit_frame_intervals").when(F.lower(backend) == "opencv", "opencv_average_fps_unverified").otherwise("declared_cfr"))


def aligned(intervals: Column, source: Column) -> Column:
    """Whether seconds name frames for sure."""
    return intervals.isNotNull() | (source == "declared_cfr")


def first_ending_after(intervals: Column, value: Column) -> Column:
    """Place of the first interval that ends after a time (their count, if none): ends do not fall."""
    return F.size(F.filter(intervals, lambda x: x["end"] <= value))


def first_starting_at(intervals: Column, value: Column) -> Column:
    return F.size(F.filter(intervals, lambda x: x["start"] < value))


def overlap(total: Column, fps: Column, intervals: Column, start: Column, end: Column) -> Column:
    """struct(lo, hi): frames lo to hi (exclusive) that overlap [start, end); null if none does."""
    lo = F.greatest(F.lit(0), F.least(total - 1, F.floor(start * fps).cast("int")))
    hi = F.greatest(lo + 1, F.least(total, F.ceil(end * fps - 1e-12).cast("int")))
    a, b = first_ending_after(intervals, start), first_starting_at(intervals, end)
    met = (a < b) & (F.get(intervals, a)["start"] < end) & (F.get(intervals, b - 1)["end"] > start)
    pair = lambda x, y: F.struct(x.cast("int").alias("lo"), y.cast("int").alias("hi"))
    return F.when(intervals.isNull(), pair(lo, hi)).otherwise(F.when(met, pair(a, b)))


def frame_interval(index: Column, fps: Column, intervals: Column) -> Column:
    return F.when(intervals.isNull(), F.struct((index / fps).alias("start"), ((index + 1) / fps).alias("end"))).otherwise(F.get(intervals, index))


def resolved_spans(spans: Column, total: Column, fps: Column, duration: Column, intervals: Column) -> Column:
    """Array of struct(start_sec, end_sec, lo, hi, problem): problem tells why a span names no frames."""
    def one(s: Column) -> Column:
        unit = X.span_unit(F.coalesce(s["unit"], F.lit("seconds")))
        scale = F.when(unit == "normalized", duration).otherwise(1.0)
        a, b = s["start"] * scale, s["end"] * scale
        bounds = overlap(total, fps, intervals, a, b)
        problem = (
            F.when(unit.isNull(), "unknown unit").when(s["start"].isNull() | s["end"].isNull() | F.isnan(s["start"]) | F.isnan(s["end"]), "bounds must be finite").when(s["start"] < 0, "start must be >= 0").when(s["end"] <= s["start"], "duration must be positive")
            .when((unit == "normalized") & (s["end"] > 1), "normalized bounds must be <= 1").when((unit == "seconds") & (b > duration + EPSILON), "exceeds the video").when(bounds.isNull(), "overlaps no frame")
        )
        return F.struct(a.alias("start_sec"), b.alias("end_sec"), bounds["lo"].alias("lo"), bounds["hi"].alias("hi"), problem.alias("problem"))

    return F.transform(F.coalesce(spans, F.array().cast("array<struct<start:double,end:double,unit:string,role:string,event_id:string>>")), one)


def span_frames(resolved: Column, total: Column) -> Column:
    """The frames of all spans, in order, each once."""
    each = F.transform(F.filter(resolved, lambda r: r["problem"].isNull()), lambda r: F.sequence(r["lo"], r["hi"] - 1))
    return F.filter(F.array_sort(F.array_distinct(F.flatten(each))), lambda i: (i >= 0) & (i < total))


def merged(intervals: Column, tolerance: float = EPSILON) -> Column:
    """Intervals (struct(start, end)) that overlap or touch become one; empty ones vanish."""
    kept = F.array_sort(F.filter(intervals, lambda x: x["end"] > x["start"]))

    def step(out: Column, x: Column) -> Column:
        last = F.element_at(out, -1)
        joins = (F.size(out) > 0) & (x["start"] <= F.try_element_at(out, F.lit(-1))["end"] + tolerance)
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when(joins, F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(wider))).otherwise(F.concat(out, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end")))))

    return F.aggregate(kept, F.array().cast("array<struct<start:double,end:double>>"), step)


def stratified(everything: Column, evidence: Column, rest: Column, count: int) -> Column:
    """One grid for the evidence views: slots in proportion, at least one for the evidence and, if there is one, for the rest."""
    share = F.bround(count * F.size(evidence) / F.size(everything), 0).cast("int")
    slots = F.least(F.greatest(F.lit(1), share), F.lit(count))
    if count > 1:
        slots = F.when(F.size(rest) > 0, F.least(slots, F.lit(count - 1))).otherwise(slots)
    out = None
    for k in range(count + 1):  # evenly takes a number: count is the model's fixed number of frames
        pick = F.array_sort(F.concat(evenly(evidence, k) if k else F.slice(evidence, 1, 0), evenly(rest, count - k) if k < count else F.slice(evidence, 1, 0)))
        out = pick if out is None else F.when(slots == k, pick).otherwise(out)
    return out


def stream(seed: int, visual_id: str, view: str) -> random.Random:
    """The random numbers of one view of one video."""
    text = json.dumps({"seed": int(seed), "view": view, "visual_id": str(visual_id)}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return random.Random(int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big"))


@F.pandas_udf(_INDICES)
def shuffled(items: pd.Series, seed: pd.Series, visual_id: pd.Series, view: pd.Series) -> pd.Series:
    def one(x, s, v, w):
        x = [int(i) for i in x]
        stream(s, v, w).shuffle(x)
        return x

    return pd.Series([one(*row) for row in zip(items, seed, visual_id, view)])


@F.pandas_udf(_INDICES)
def masked(size: pd.Series, evidence: pd.Series, seed: pd.Series, visual_id: pd.Series) -> pd.Series:
    """As many input positions as show evidence, others first, drawn without replacement."""
    def one(n, e, s, v):
        e, rng = [int(i) for i in e], stream(s, v, "random_position_mask")
        others = [i for i in range(int(n)) if i not in set(e)]
        rng.shuffle(others)
        chosen = others[: len(e)]
        if len(chosen) < len(e):
            again = list(e)
            rng.shuffle(again)
            chosen += again[: len(e) - len(chosen)]
        return sorted(chosen)

    return pd.Series([one(*row) for row in zip(size, evidence, seed, visual_id)])


def matched_windows(evidence: list[tuple[float, float]], available: list[tuple[float, float]], duration: float, rng: random.Random) -> tuple[list[tuple[float, float]], str] | None:
    """Windows outside the evidence that last as long as it: one stretch where one is long enough, else several. Null if there is not enough."""
    target, slack = sum(b - a for a, b in evidence), max(EPSILON, duration * EPSILON)
    if target <= 0 or sum(b - a for a, b in available) + slack < target:
        return None

    def place(a: float, b: float, take: float) -> tuple[float, float]:
        free = max(0.0, b - a - take)
        at = a + (rng.random() * free if free > slack else 0.0)
        return at, at + take

    whole = [x for x in available if x[1] - x[0] + slack >= target]
    if whole:
        a, b = whole[rng.randrange(len(whole))]
        return [place(a, b, target)], "contiguous_non_evidence_duration_window"
    order, out, left = list(available), [], target
    rng.shuffle(order)
    for a, b in order:
        if left <= slack:
            break
        take = min(b - a, left)
        out.append(place(a, b, take))
        left -= take
    return (out, "multi_span_non_evidence_duration_match") if left <= slack else None


@F.pandas_udf(_WINDOWS)
def duration_matched(evidence: pd.Series, available: pd.Series, duration: pd.Series, seed: pd.Series, visual_id: pd.Series) -> pd.DataFrame:
    """matched_windows row by row in Arrow batches: its draws follow one another."""
    out = []
    pairs = lambda x: [(float(i["start"]), float(i["end"])) for i in x]
    for e, a, d, s, v in zip(evidence, available, duration, seed, visual_id):
        found = matched_windows(pairs(e), pairs(a), float(d), stream(s, v, "random_matched"))
        out.append(([{"start": x, "end": y} for x, y in sorted(found[0])], found[1]) if found else (None, None))
    return pd.DataFrame(out, columns=["windows", "strategy"])


def selections(rows: DataFrame, count: int) -> DataFrame:
    """rows (visual_id, view, seed, clock columns, spans, clip) with the selected frames of each view.

    Adds indices, timestamps, evidence_positions, masked_positions, strategy, windows, candidates, evidence_frames and
    problem (why there is no selection; then indices is null). count: frames that a model sees.
    """
    c = F.col
    total, fps, duration, intervals = c("total_frames"), c("fps"), c("duration_sec"), c("intervals")
    out = rows.withColumn("__r", resolved_spans(c("spans"), total, fps, duration, intervals))
    by_frames = c("clip.unit") == "frames"
    first, last = F.coalesce(c("clip.start_frame"), F.lit(0)), c("clip.end_frame_exclusive")
    begin = F.when(by_frames, frame_interval(first, fps, intervals)["start"]).otherwise(F.coalesce(c("clip.start"), F.lit(0.0)))
    finish = F.when(by_frames, frame_interval(last - 1, fps, intervals)["end"]).otherwise(F.coalesce(c("clip.end"), duration))
    out = out.withColumns({"__begin": begin, "__finish": finish})
    window = overlap(total, fps, intervals, c("__begin"), c("__finish"))
    bounds = F.when(c("clip").isNull(), F.struct(F.lit(0).alias("lo"), total.alias("hi"))).when(by_frames, F.struct(first.alias("lo"), last.alias("hi"))).otherwise(window)
    out = out.withColumn("__b", bounds)
    slack = F.greatest(F.lit(EPSILON), duration * EPSILON)
    sure = aligned(intervals, timestamp_source(intervals, c("timestamp_source"), F.lit(None).cast("string")))
    faulty = F.get(F.filter("__r", lambda r: r["problem"].isNotNull()), 0)["problem"]
    outside = F.exists("__r", lambda r: (r["start_sec"] < c("__begin") - slack) | (r["end_sec"] > c("__finish") + slack))
    problem = (
        F.when(~c("view").isin(*VIEWS), "unknown view").when(by_frames & (c("clip.expected_total_frames") != total), "the frame count does not match the clip").when(by_frames & (last > total), "the clip ends after the last frame")
        .when((F.size("__r") > 0) & ~sure, "spans need a sure frame clock").when(c("clip").isNotNull() & ~F.coalesce(by_frames, F.lit(False)) & ~sure, "a clip in seconds needs a sure frame clock").when(faulty.isNotNull(), faulty)
        .when(c("__begin") >= duration, "the clip starts after the video").when(c("__finish") > duration + EPSILON, "the clip ends after the video").when(c("__b").isNull(), "the clip overlaps no frame").when(outside, "spans extend outside the clip")
        .when(c("view").isin(*NEEDS_EVIDENCE) & (F.size("__r") == 0), "the view needs evidence")
    )
    out = out.withColumn("problem", problem)
    good = c("problem").isNull()
    empty = F.array().cast("array<int>")
    out = out.withColumn("__all", F.when(good, F.sequence(c("__b.lo"), c("__b.hi") - 1)).otherwise(empty)).withColumn("__e", F.when(good, span_frames(c("__r"), total)).otherwise(empty))
    out = out.withColumn("__rest", F.array_except("__all", "__e"))
    view = c("view")
    uniform, grid = evenly(c("__all"), count), stratified(c("__all"), c("__e"), c("__rest"), count)
    evidence_union = merged(F.transform("__r", lambda r: F.struct(r["start_sec"].alias("start"), r["end_sec"].alias("end"))))
    clipped = F.transform("__rest", lambda i: F.struct(F.greatest(frame_interval(i, fps, intervals)["start"], c("__begin")).alias("start"), F.least(frame_interval(i, fps, intervals)["end"], c("__finish")).alias("end")))
    wanted = good & (view == "random_matched")
    none = F.array().cast("array<struct<start:double,end:double>>")
    # the three draws need Python; none takes another's result, so one pass of batches serves all
    shared = view.isin("evidence_present", "evidence_removed", "random_position_mask")
    places = F.filter(F.transform(grid, lambda x, i: F.when(F.array_contains("__e", x), i.cast("int"))), lambda i: i.isNotNull())
    out = out.withColumn("evidence_positions", F.when(shared & good, places).otherwise(empty))
    out = out.withColumn("__drawn", masked(F.lit(count), F.when(view == "random_position_mask", c("evidence_positions")).otherwise(empty), "seed", "visual_id"))
    out = out.withColumn("__s", shuffled(F.when(good & (view == "shuffle"), uniform).otherwise(empty), "seed", "visual_id", "view"))
    out = out.withColumn("__w", duration_matched(F.when(wanted, evidence_union).otherwise(none), F.when(wanted, merged(clipped)).otherwise(none), duration, c("seed"), c("visual_id")))
    near = F.flatten(F.transform(F.coalesce(c("__w.windows"), none), lambda w: F.coalesce(F.sequence(overlap(total, fps, intervals, w["start"], w["end"])["lo"], overlap(total, fps, intervals, w["start"], w["end"])["hi"] - 1), empty)))
    out = out.withColumn("__near", F.array_sort(F.array_intersect("__rest", near)))
    middle = F.get("__all", F.floor(F.size("__all") / 2).cast("int"))
    picked = (
        F.when(view == "single", F.array_repeat(middle, count)).when(view == "reverse", F.reverse(uniform)).when(view == "evidence_only", evenly(c("__e"), count))
        .when(view.isin("evidence_present", "evidence_removed", "random_position_mask"), grid).when(view == "random_matched", evenly(c("__near"), count)).otherwise(uniform)
    )
    out = out.withColumn("__p", F.when(good, picked).otherwise(empty))
    out = out.withColumn("indices", F.when(view == "shuffle", c("__s")).otherwise(c("__p")))
    short = F.when(good & (view == "random_matched") & c("__w.windows").isNull(), "too little time outside the evidence").when(good & (F.size("indices") < count), "no frames to choose from")
    out = out.withColumn("problem", F.coalesce("problem", short))
    out = out.withColumn("masked_positions", F.when(view == "evidence_removed", c("evidence_positions")).when(view == "random_position_mask", c("__drawn")).otherwise(empty))
    candidates = F.when(view == "evidence_only", F.size("__e")).when(view == "random_matched", F.size("__near")).when(view == "single", 1).otherwise(F.size("__all"))
    strategy = F.when(view == "evidence_removed", "solid_midgray_rgb_on_shared_evidence_grid").when(view == "random_position_mask", "solid_midgray_rgb_random_same_count_prefer_non_evidence_on_shared_grid").otherwise(c("__w.strategy"))
    out = out.withColumns({
        "timestamps": F.transform("indices", lambda i: frame_interval(i, fps, intervals)["start"]), "strategy": strategy, "windows": c("__w.windows"), "candidates": candidates, "evidence_frames": F.size("__e"),
        "indices": F.when(c("problem").isNull(), c("indices")),
    })
    return out.drop("__r", "__begin", "__finish", "__b", "__all", "__e", "__rest", "__w", "__near", "__p", "__s", "__drawn")


def distinct_views(rows: DataFrame, key: str = "visual_id") -> DataFrame:
    """One row a view, the first by its other columns: extraction needs each view once, whatever the number of trials."""
    names = [c for c in rows.columns if c != key]
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*names)).alias("r")).select(key, "r.*")
