"""Trials from base records: conditions x doses x option permutations, with clues, reasons for skipping, and the way back.

Conditions are a small, configured table and are broadcast; records are expanded where they lie, without a shuffle.
Records have the columns of functions.records.RECORD.
"""

from __future__ import annotations

import dataclasses
import math
import random
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions import digests as D
from ..functions import records as R
from ..functions import text as T

#: Fixed values of a condition.
CHANNELS = ["question_only", "visual", "text_oracle", "embedding_oracle", "visual_plus_text"]
VIEWS = ["none", "full", "single", "reverse", "shuffle", "evidence_only", "evidence_present", "evidence_removed", "random_position_mask", "random_matched"]
CLUE_FIELDS = ["static_facts", "unordered_events", "ordered_events", "temporal_relations", "state_changes", "relations", "operator", "intermediate"]
EVENT_VIEWS = ["atomic", "ordered", "timestamp_sham"]
SHOWN = {
    "static_facts": "Visual fact", "unordered_events": "Observed event", "ordered_events": "Timed event", "temporal_relations": "Temporal relation", "state_changes": "State change", "relations": "Relation",
    "operator": "Reasoning operator", "intermediate": "Intermediate fact", "rationale": "Rationale",
}
HEADING = "Evidence supplied by the diagnostic oracle:"
ORACLE_CHANNELS = ["text_oracle", "embedding_oracle", "visual_plus_text"]
_CONDITIONS = (
    "name string, input_channel string, visual_view string, clue_fields array<string>, always_include_fields array<string>, required_fields array<string>, required_any_fields array<string>, "
    "sham_fields array<string>, matched_event_view string, requires_matched_events boolean, doses array<string>, requires_evidence boolean, description string"
)


@dataclasses.dataclass(frozen=True)
class Condition:
    """One condition of the design; doses are numbers of facts or 'all'."""

    name: str
    input_channel: str
    visual_view: str = "none"
    clue_fields: tuple[str, ...] = ()
    always_include_fields: tuple[str, ...] = ()
    required_fields: tuple[str, ...] = ()
    required_any_fields: tuple[str, ...] = ()
    sham_fields: tuple[str, ...] = ()
    matched_event_view: str | None = None
    requires_matched_events: bool = False
    doses: tuple[int | str, ...] = ("all",)
    requires_evidence: bool = False
    description: str = ""

    @classmethod
    def of(cls, value: dict) -> Condition:
        """From a configuration mapping; lists become tuples. Raises ValueError with every fault."""
        known = {f.name for f in dataclasses.fields(cls)}
        given = {k: tuple(v) if isinstance(v, list) else v for k, v in value.items() if k in known and v is not None}
        out = cls(**{"name": "", "input_channel": "", **given})
        if faults := out.faults():
            raise ValueError(f"condition {out.name!r}: " + "; ".join(faults))
        return out

    def faults(self) -> list[str]:
        fields, visual, oracle = set(self.clue_fields), self.input_channel in ("visual", "visual_plus_text"), self.input_channel in ORACLE_CHANNELS
        dose_ok = lambda d: d == "all" or (isinstance(d, int) and not isinstance(d, bool) and d >= 0)
        event_field = "unordered_events" if self.matched_event_view == "atomic" else "ordered_events"
        tests = [
            (not self.name.strip(), "the name is empty"), (self.input_channel not in CHANNELS, f"unknown input_channel {self.input_channel!r}"), (self.visual_view not in VIEWS, f"unknown visual_view {self.visual_view!r}"),
            (visual != (self.visual_view != "none"), "visual channel and view do not go together"), (oracle and not fields, "an oracle channel needs clue_fields"), (not oracle and bool(fields), "only an oracle channel has clue_fields"),
            (not fields <= set(CLUE_FIELDS), f"unknown clue fields {sorted(fields - set(CLUE_FIELDS))}"), (not {*self.always_include_fields, *self.required_fields, *self.required_any_fields} <= fields, "required and mandatory fields must be clue fields"),
            (not set(self.sham_fields) <= fields, "sham fields must be clue fields"), (not set(self.sham_fields) <= {"operator"}, "only operator facts have a sham"), (self.matched_event_view not in (None, *EVENT_VIEWS), "unknown matched_event_view"),
            (self.requires_matched_events and self.matched_event_view is None, "requires_matched_events needs a matched_event_view"), (self.matched_event_view in EVENT_VIEWS and event_field not in fields, f"its view needs {event_field}"),
            (not self.doses or not all(map(dose_ok, self.doses)) or len(set(self.doses)) != len(self.doses), "doses must be different counts or 'all'"),
        ]
        return [message for bad, message in tests if bad]


def condition_table(spark: SparkSession, conditions: Sequence[Condition]) -> DataFrame:
    if len({c.name for c in conditions}) != len(conditions) or not conditions:
        raise ValueError("conditions must be there and have different names")
    rows = [tuple(list(map(str, v)) if k == "doses" else list(v) if isinstance(v, tuple) else v for k, v in dataclasses.asdict(c).items()) for c in conditions]
    return spark.createDataFrame(rows, _CONDITIONS)


def option_permutations(value: int | str) -> int | None:
    """None for 'all' (as many as choices), else a count of at least 1."""
    if str(value).strip().lower() in ("all", "all_positions"):
        return None
    if isinstance(value, bool) or not str(value).strip().lstrip("+").isdigit() or int(value) < 1:
        raise ValueError("option_permutations must be >= 1 or 'all'")
    return int(value)


def seeded_orders(count: int, replicates: int, seed: int, base_id: str) -> list[list[int]]:
    """Cyclic shifts, then different seeded shuffles, then the first ones again."""
    orders = [[(i + s) % count for i in range(count)] for s in range(min(max(replicates, 1), count))]
    stream, seen = random.Random(f"{seed}:{base_id}:option-permutation"), {tuple(o) for o in orders}
    while len(orders) < min(replicates, math.factorial(count)):
        order = list(range(count))
        stream.shuffle(order)
        if tuple(order) not in seen:
            seen.add(tuple(order))
            orders.append(order)
    return orders + [orders[k % len(orders)] for k in range(max(0, replicates - len(orders)))]


def orders(choices: Column, base_id: Column, replicates: int | None, seed: int, most_choices: int = 26) -> Column:
    """The permutations of a record's options (0-based old places): cyclic shifts where these suffice, which needs no Python."""
    n = F.size(choices)
    shifts = lambda k: F.transform(F.sequence(F.lit(0), k - 1), lambda s: F.transform(F.sequence(F.lit(0), n - 1), lambda i: ((i + s) % n).cast("int")))
    if replicates is None:
        return shifts(n)
    if replicates <= 2:
        return shifts(F.least(n, F.lit(replicates)))

    @F.pandas_udf(ArrayType(ArrayType(IntegerType())))
    def shuffled(counts: pd.Series, ids: pd.Series) -> pd.Series:
        return pd.Series([seeded_orders(int(c), replicates, seed, i) for c, i in zip(counts, ids)])

    return shuffled(n, base_id)


def matched_events(oracles: Column, record_id: Column) -> Column:
    """Events that both the unordered and the ordered facts have, in the order of a digest that says nothing about time.

    Array of struct(rank, fact_id, atomic_text, ordered_text, sham_text, order, same): same tells whether the two agree
    apart from time; a pair that does not is an error of the record.
    """
    atomic, timed = R.safe_facts(oracles["unordered_events"]), R.safe_facts(oracles["ordered_events"])
    of = lambda facts, key: F.get(F.filter(facts, lambda f: R.event_id(f) == key), F.lit(0))
    shared = F.array_intersect(F.transform(atomic, R.event_id), F.transform(timed, R.event_id))

    def one(key: Column) -> Column:
        a, o = of(atomic, key), of(timed, key)
        rank = F.sha2(F.concat(F.lit('{"event_id":'), D.quoted(key), F.lit(',"record_id":'), D.quoted(record_id), F.lit("}")), 256)
        text = R.fact_text(a, "unordered_events")
        return F.struct(
            rank.alias("rank"), key.alias("fact_id"), text.alias("atomic_text"), R.fact_text(o, "ordered_events").alias("ordered_text"), R.timestamp_sham(o, text).alias("sham_text"), R.event_order(o, rank).alias("order"),
            F.coalesce(a["payload"] == o["payload"], F.lit(False)).alias("same"), F.sha2(a["payload"], 256).alias("semantic_sha256"),
        )

    return F.array_sort(F.transform(F.filter(shared, lambda k: k.isNotNull()), one))


def matched_event_audit(oracles: Column) -> Column:
    """struct of counts, and of event ids that only one side has, sorted."""
    ids = lambda f: F.filter(F.transform(R.safe_facts(oracles[f]), R.event_id), lambda k: k.isNotNull())
    a, o = ids("unordered_events"), ids("ordered_events")
    return F.struct(
        F.size(F.array_intersect(a, o)).alias("shared_event_count"), F.size(a).alias("atomic_event_count"), F.size(o).alias("ordered_event_count"),
        F.array_sort(F.array_except(a, o)).alias("unmatched_atomic_event_ids"), F.array_sort(F.array_except(o, a)).alias("unmatched_ordered_event_ids"),
    )


def _lines(oracles: Column, fields: Column, keep) -> Column:
    """struct(field, text) of the safe facts of the fields that keep() admits, in the order of `fields`."""
    def of(name: Column) -> Column:
        out = F.array().cast("array<struct<field:string,text:string>>")
        for f in CLUE_FIELDS:
            texts = F.filter(F.transform(R.safe_facts(oracles[f]), lambda x: F.struct(F.lit(f).alias("field"), F.trim(R.fact_text(x, f)).alias("text"))), lambda s: s["text"] != "")
            out = F.when(name == f, texts).otherwise(out)
        return out

    return F.flatten(F.transform(F.filter(fields, keep), of))


def clue(oracles: Column, events: Column, spec: dict[str, Column], dose: Column) -> Column:
    """struct(clue_text, effective_dose, selected_fact_ids) for one record, condition (columns of the condition table) and dose.

    events: the record's matched_events, computed once for all conditions.
    """
    some = lambda items: F.when(dose == "all", items).otherwise(F.slice(items, F.lit(1), F.coalesce(dose.try_cast("int"), F.lit(0))))
    always = spec["always_include_fields"]
    mandatory = _lines(oracles, always, lambda f: F.lit(True))
    plain = F.concat(some(_lines(oracles, spec["clue_fields"], lambda f: ~F.array_contains(always, f))), mandatory)
    view = spec["matched_event_view"]
    picked = some(events)
    ordered = F.transform(F.array_sort(F.transform(picked, lambda e: F.struct(e["order"].alias("order"), e["ordered_text"].alias("text")))), lambda e: e["text"])
    texts = F.when(view == "atomic", F.transform(picked, lambda e: e["atomic_text"])).when(view == "ordered", ordered).otherwise(F.transform(picked, lambda e: e["sham_text"]))
    shown = F.transform(texts, lambda t: F.struct(F.when(view == "atomic", "unordered_events").otherwise("ordered_events").alias("field"), t.alias("text")))
    lines = F.when(view.isNull(), plain).otherwise(F.concat(shown, mandatory))
    lines = F.transform(lines, lambda s: F.struct(s["field"].alias("field"), F.when(F.array_contains(spec["sham_fields"], s["field"]), T.sham(s["text"])).otherwise(s["text"]).alias("text")))
    label = F.create_map(*(F.lit(x) for kv in SHOWN.items() for x in kv))
    said = F.array_join(F.transform(lines, lambda s: F.concat(F.lit("- "), F.coalesce(F.try_element_at(label, s["field"]), s["field"]), F.lit(": "), s["text"])), "\n")
    ids = F.when(view.isNull(), F.array().cast("array<string>")).otherwise(F.transform(picked, lambda e: e["fact_id"]))
    return F.struct(F.when(F.size(lines) > 0, F.concat(F.lit(HEADING + "\n"), said)).otherwise("").alias("clue_text"), F.size(lines).alias("effective_dose"), ids.alias("selected_fact_ids"))


def available_fields(oracles: Column) -> Column:
    """Clue fields with at least one safe fact."""
    return F.array_compact(F.array(*(F.when(F.size(R.safe_facts(oracles[f])) > 0, f) for f in CLUE_FIELDS)))


def skip_reason(spec: dict[str, Column], available: Column, spans: Column, events: Column) -> Column:
    """Why a condition does not apply to a record, whatever the dose; null if it does."""
    have = F.array_intersect(available, spec["clue_fields"])
    lost = F.array_sort(F.array_except(spec["required_fields"], have))
    return (
        F.when(spec["requires_evidence"] & (F.coalesce(F.size(spans), F.lit(0)) < 1), "no_evidence_span")
        .when(F.size(lost) > 0, F.concat(F.lit("missing_required_oracle_fields:"), F.array_join(lost, ",")))
        .when((F.size(spec["required_any_fields"]) > 0) & ~F.arrays_overlap(spec["required_any_fields"], have), "missing_all_required_any_oracle_fields")
        .when(spec["requires_matched_events"] & (F.size(events) == 0), "no_matched_atomic_ordered_events")
    )


def visual_id(record_id: Column, view: Column, seed: int) -> Column:
    """visual::<digest> of what a view shows: the source of the pixels, the view, its spans and clip, and the seed."""
    evidence = view.isin("evidence_only", "evidence_present", "evidence_removed", "random_position_mask", "random_matched")
    d = F.col("diagnostic")
    spans = F.when(evidence, d["evidence_spans"]).otherwise(F.array().cast(f"array<{R.SPAN}>"))
    spec = F.struct(d["media_clip"].alias("clip"), spans.alias("evidence_spans"), F.col("media_type"), F.lit(seed).alias("seed"), view.alias("view"))
    whole = F.to_json(F.struct(R.visual_source(record_id=record_id, benchmark=F.col("benchmark")).alias("source"), spec.alias("view_spec")), {"ignoreNullFields": "false"})
    return F.when(view != "none", F.concat(F.lit("visual::"), F.sha2(whole, 256)))


CONTENT = "tarn.trial_content.1"


def content_sha256(rows: DataFrame) -> Column:
    """Digest of what scoring and analysis see of a trial; media paths are no part of it."""
    parts = ["base_id", "media_type", "question", "choices", "answer", "answer_text", "clue_text", "visual_id", "condition"]
    d = F.col("diagnostic")
    diagnostic = F.struct(*(d[k].alias(k) for k in ["schema_version", *R.METADATA, "evidence_spans", "media_clip"]))
    return F.sha2(F.to_json(F.struct(F.lit(CONTENT).alias("schema"), *(F.col(p) for p in parts if p in rows.columns), diagnostic.alias("diagnostic")), {"ignoreNullFields": "false"}), 256)


def expanded(records: DataFrame, conditions: Sequence[Condition], seed: int = 42, permutations: int | str = 1) -> tuple[DataFrame, DataFrame]:
    """(trials, skipped): a trial for every record, condition that applies, dose with a clue, and permutation.

    skipped: base_id, condition, reason, one row a condition or dose that does not apply.
    """
    spark = records.sparkSession
    # a small, configured table: an array in every row, so no join is needed at all
    specs = F.array(*(_literal(r) for r in condition_table(spark, conditions).collect()))
    d = F.col("diagnostic")
    oracles = d["oracles"]
    rows = records.withColumn("base_id", F.col("id")).withColumn("__orders", orders(F.col("choices"), F.col("id"), option_permutations(permutations), seed))
    rows = rows.withColumn("__events", matched_events(oracles, F.col("id"))).withColumn("__have", available_fields(oracles)).withColumn("spec", F.explode(specs))
    spec = {c: F.col(f"spec.{c}") for c in [x.split()[0] for x in _CONDITIONS.split(", ")]}
    rows = rows.withColumn("reason", skip_reason(spec, F.col("__have"), d["evidence_spans"], F.col("__events")))
    skipped = rows.where("reason IS NOT NULL").select("base_id", F.col("spec.name").alias("condition"), "reason")
    doses = rows.where("reason IS NULL").drop("reason").withColumn("dose", F.explode("spec.doses")).withColumn("clue", clue(oracles, F.col("__events"), spec, F.col("dose")))
    empty = spec["input_channel"].isin(*ORACLE_CHANNELS) & (F.col("clue.clue_text") == "")
    skipped = skipped.unionByName(doses.where(empty).select("base_id", F.col("spec.name").alias("condition"), F.lit("no_oracle_fact").alias("reason")))
    trials = doses.where(~empty).withColumn("visual_id", visual_id(F.col("base_id"), spec["visual_view"], seed)).select("*", F.posexplode("__orders").alias("permutation_index", "permutation"))
    gold = F.ascii(T.normalized_answer(F.col("answer"), F.col("choices"))) - 65
    named = ["name", "input_channel", "visual_view", "clue_fields", "always_include_fields", "required_fields", "required_any_fields", "sham_fields", "matched_event_view", "requires_matched_events"]
    condition = F.struct(*(spec[c].alias(c) for c in named), F.col("clue.selected_fact_ids").alias("selected_fact_ids"), F.col("dose").alias("requested_dose"), F.col("clue.effective_dose").alias("effective_dose"), "permutation_index", "permutation", F.lit(seed).alias("seed"))
    trials = trials.withColumns({
        "answer_text": F.get("choices", gold), "__answer": T.option_label((F.array_position("permutation", gold) - 1).cast("int")), "__choices": T.permuted(F.col("choices"), F.col("permutation")),
        "clue_text": F.col("clue.clue_text"), "condition": condition,
    }).withColumn("choices", F.col("__choices")).withColumn("answer", F.col("__answer")).drop("__orders", "__events", "__have", "__answer", "__choices", "spec", "dose", "clue", "permutation", "permutation_index")
    trials = trials.withColumn("trial_content_sha256", content_sha256(trials)).withColumn("trial_id", F.concat(F.lit("trial::"), F.col("trial_content_sha256")))
    return trials.withColumn("id", F.col("trial_id")), skipped


def _literal(row) -> Column:
    """A condition row as a literal struct."""
    def lit(v):
        return F.array(*map(F.lit, v)).cast("array<string>") if isinstance(v, list) else F.lit(v)

    kinds = [x.split() for x in _CONDITIONS.split(", ")]
    return F.struct(*(lit(row[k]).cast(t).alias(k) for k, t in kinds))


def skip_report(skipped: DataFrame) -> DataFrame:
    return skipped.groupBy("condition", "reason").agg(F.count("*").alias("n"))


def base_records(trials: DataFrame) -> DataFrame:
    """The records that trials were made of, one row a base: permutations undone, names of the trial dropped.

    differing: how many different originals the base's trials give; one, or the trials are inconsistent.
    """
    order = F.col("condition.permutation")
    whole = trials.withColumn("__choices", T.restored(F.col("choices"), order)).withColumn("__answer", T.option_label(F.get(order, F.ascii("answer") - 65)))
    keep = [c for c in ("source", "benchmark", "task", "media_type", "media_path", "question", "diagnostic") if c in trials.columns]
    body = F.struct(*keep, F.col("__choices").alias("choices"), F.col("__answer").alias("answer"))
    found = whole.select(F.col("base_id").alias("id"), body.alias("b"), F.sha2(F.to_json(body, {"ignoreNullFields": "false"}), 256).alias("__d"))
    return found.groupBy("id").agg(F.count_distinct("__d").alias("differing"), F.first("b").alias("b"), F.count("*").alias("trials")).select("id", "b.*", "differing", "trials")


def result_design(trials: DataFrame) -> DataFrame:
    """The design columns that a scored result carries."""
    c, d = F.col("condition"), F.col("diagnostic")
    return trials.select(
        "trial_id", "base_id", "trial_content_sha256", "visual_id", *(d[k].alias(k) for k in R.METADATA), c["name"].alias("condition"), c["input_channel"].alias("input_channel"), c["visual_view"].alias("visual_view"),
        c["requested_dose"].alias("requested_dose"), c["effective_dose"].alias("effective_dose"), c["permutation_index"].alias("permutation_index"), c["seed"].alias("seed"), "choices", "answer", "answer_text",
    )


#: The prompt's fixed wording.
MARK = "<VISUAL>"
INSTRUCTION = "Answer the question using only the option letter."


def channel_prompt(question: Column, choices: Column, channel: Column, clue_text: Column, media_type: Column | None = None) -> Column:
    """struct(prefix, marker, suffix) by input channel: the wording is one for all, the mark stands where pixels go, the
    clue is shown where the channel has text. Null for an unknown channel."""
    media = F.when(F.coalesce(media_type if media_type is not None else F.lit("video"), F.lit("video")) == "video", "video").otherwise("image")
    said = F.trim(F.coalesce(clue_text, F.lit("")))
    before = (
        F.when(channel == "visual_plus_text", F.concat(F.lit("\n"), said, F.lit("\n"))).when(channel.isin("visual", "embedding_oracle"), "\n")
        .when(channel == "text_oracle", F.concat(said, F.lit("\n"))).when(channel == "question_only", "")
    )
    prefix = F.concat(F.lit("You are given a "), media, F.lit(f". {INSTRUCTION}\n"))
    suffix = F.concat(before, F.lit("Question: "), F.trim(question), F.lit("\nOptions:\n"), T.format_choices(choices), F.lit("\nAnswer:"))
    marker = F.when(channel.isin("visual", "visual_plus_text", "embedding_oracle"), MARK)
    return F.when(before.isNotNull(), F.struct(prefix.alias("prefix"), marker.alias("marker"), suffix.alias("suffix")))


def around_mark(prompt: Column, mark: str = MARK) -> Column:
    """struct(prefix, suffix) around the first mark; without one all is prefix."""
    at = F.locate(mark, prompt)
    return F.struct(F.when(at > 0, F.substring(prompt, F.lit(1), at - 1)).otherwise(prompt).alias("prefix"), F.when(at > 0, F.substring(prompt, at + F.lit(len(mark)), F.length(prompt))).otherwise("").alias("suffix"))


def inconsistent_trials(actual: DataFrame, regenerated: DataFrame) -> DataFrame:
    """side (missing or extra), trial_id and digest of trials that only one side has: none if the matrix is closed."""
    from .relational import differences

    pair = ["trial_id", "trial_content_sha256"]
    return differences(regenerated.select(*pair), actual.select(*pair))
