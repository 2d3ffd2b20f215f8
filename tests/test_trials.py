"""Records, their validation, clues, trials and the way back."""

import json
import random

from pyspark.sql import functions as F

from tarn.functions import records as R
from tarn.operators import trials as T
from tarn.operators import validation as V


def fact(text, **more):
    base = dict.fromkeys([p.split(":")[0] for p in R.FACT[len("struct<"):-1].split(",")])
    f = {**base, "text": text, "access": "safe_visual_gt", "source": "s", "lineage": "official_adapter", **more}
    return {**f, "payload": json.dumps([f["text"], f["fact_id"], f["event_id"]])}


def record(i="r1", **changes):
    facts = {f: [] for f in R.FACT_FIELDS}
    facts |= {"operator": None, "answer_derived": False, **changes.pop("oracles", {})}
    d = {
        "schema_version": "1.1", "dataset": "diag", "split": "eval", "information_family": "temporal_order", "question_family": "order", "reasoning_depth": 1, "resampling_unit_id": f"video::{i}", "pair_id": f"standalone:{i}", "pair_role": "standalone",
        "independent_unit_id": None, "official_candidate_id": None, "official_candidate_count": None, "adapter_run_id": None, "evidence_spans": [], "media_clip": None, "oracles": facts, "provenance": {"source_id": i}, **changes.pop("diagnostic", {}),
    }
    return {"id": i, "source": "s", "benchmark": "b", "task": "mcq", "media_type": "video", "media_path": f"/m/{i}.mp4", "question": "What came first?", "choices": ["red", "green", "blue"], "answer": "B", "diagnostic": d, **changes}


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), R.RECORD)


def test_validation_collects_everything(spark):
    span = lambda a, b, u="seconds": {"start": a, "end": b, "unit": u, "role": None, "event_id": None}
    clip = lambda **k: {**dict.fromkeys(["unit", "start", "end", "start_frame", "end_frame_exclusive", "expected_total_frames"]), **k}
    d = lambda **k: {"diagnostic": k}
    cases = {
        "ok": {}, "id": {"id": " "}, "media_type": {"media_type": "sound"}, "choices": {"choices": ["one"], "answer": "A"}, "choices ": {"choices": ["Straße", "STRASSE", "x"], "answer": "C"}, "answer": {"answer": "purple"}, "diagnostic.schema_version": d(schema_version="1"),
        "diagnostic.information_family": d(information_family="x"), "diagnostic.pair_role": d(pair_role="x"), "diagnostic.reasoning_depth": d(reasoning_depth=4), "diagnostic.evidence_spans[0].end": d(evidence_spans=[span(2.0, 1.0)]), "diagnostic.evidence_spans[1].end": d(evidence_spans=[span(0.0, 1.0), span(0.5, 1.5, "normalized")]),
        "diagnostic.oracles.static_facts[0].lineage": {"oracles": {"static_facts": [fact("x", lineage="guess")]}}, "diagnostic.oracles.operator[0].access": {"oracles": {"operator": [fact("x")]}}, "diagnostic.oracles.relations": {"oracles": {"relations": None}}, "diagnostic.oracles.answer_derived": {"oracles": {"answer_derived": True}},
        "diagnostic.media_clip": d(media_clip=clip(unit="frames", end_frame_exclusive=9, expected_total_frames=8)), "diagnostic.resampling_unit_id": d(resampling_unit_id=""), "diagnostic.adapter_run_id": d(adapter_run_id="adapter-run::x"), "diagnostic.official_candidate_id": d(official_candidate_id="1"), "diagnostic.provenance.source_id": d(provenance={}),
        "diagnostic": {"diagnostic": None},
    }
    rows = []
    for k, c in cases.items():
        r = record("r", **{x: y for x, y in c.items() if x not in ("id",) and not (x == "diagnostic" and y is None)})
        rows.append({**r, **({"id": c["id"]} if "id" in c else {}), **({"diagnostic": None} if k == "diagnostic" else {}), "benchmark": k})
    got = frame(spark, *rows).select("benchmark", V.record_issues().alias("i")).collect()
    for r in got:
        assert {x.path for x in r.i} == (set() if r.benchmark == "ok" else {r.benchmark.strip()}), (r.benchmark, r.i)
    assert frame(spark, rows[0], rows[1]).select(V.has_errors(V.record_issues()).alias("e")).collect() == [(False,), (True,)]


def test_manifest_issues(spark):
    pair = lambda i, role, answer, split="eval", unit="u", **k: record(i, answer=answer, diagnostic={"pair_id": "p", "pair_role": role, "split": split, "resampling_unit_id": unit}, **k)
    good = [pair("a", "original", "A"), pair("b", "counterfactual", "B"), pair("c", "nuisance", "A", choices=["red", "green", "blue "])]
    assert V.manifest_issues(frame(spark, *good)).count() == 0
    bad = [pair("a", "original", "A"), pair("b", "counterfactual", "A", question="Other?"), pair("c", "nuisance", "C", split="train"), record("a"), pair("d", "standalone", "A", unit="w")]
    got = sorted((r.level, r.path, r.message[:20]) for r in V.manifest_issues(frame(spark, *bad)).collect())
    paths = [p for _, p, _ in got]
    assert {"id", "answer", "question", "diagnostic.split", "diagnostic.pair_id", "diagnostic.resampling_unit_id"} <= set(paths) and paths.count("answer") == 2
    counts = {(r.field, r.value): r.rows for r in V.coverage(frame(spark, *good)).collect()}
    assert counts[("pair_rows", "nuisance")] == 1 and counts[("answer_position", "A")] == 2 and counts[("resampling_unit_id", "units")] == 1
    rows = spark.createDataFrame([("u", "m1"), ("v", "m2")], "unit string, media string")
    assert [tuple(r) for r in V.shared_identities(rows, spark.createDataFrame([("u", "m3")], "unit string, media string"), "unit", "media").collect()] == [("unit", "u")]


def events():
    e = lambda k, t, **m: fact(f"event {k}", event_id=k, **m)
    return {"unordered_events": [e("e1", 0), e("e2", 0), e("e3", 0), e("hidden", 0, access="target_semantic")], "ordered_events": [e("e2", 0, start_sec=1.0, end_sec=2.5), e("e1", 0, start_sec=0.25), e("e4", 0, frame=7.0)], "static_facts": [fact(" a  b "), fact("c")], "operator": [fact("compare 12 things", access="operator_only")]}


def conditions():
    C = T.Condition
    return [
        C("full_video", "visual", "full"), C("question_only", "question_only"), C("facts", "text_oracle", clue_fields=("static_facts",), doses=(1, "all")), C("only", "visual", "evidence_only", requires_evidence=True),
        C("ordered", "text_oracle", clue_fields=("unordered_events", "ordered_events"), matched_event_view="ordered", requires_matched_events=True), C("sham", "text_oracle", clue_fields=("ordered_events", "operator"), always_include_fields=("operator",), sham_fields=("operator",), matched_event_view="timestamp_sham"),
        C("needs", "text_oracle", clue_fields=("relations", "state_changes"), required_fields=("relations",)), C("any", "text_oracle", clue_fields=("relations",), required_any_fields=("relations",)), C("empty", "text_oracle", clue_fields=("relations",)),
    ]


def test_trials(spark):
    rows = frame(spark, record("r1", oracles=events()), record("r2", choices=["x", "y"], answer="A"))
    made, skipped = T.expanded(rows, conditions(), permutations="all")
    got = {(r.base_id, r.condition.name, r.condition.requested_dose, r.condition.permutation_index): r for r in made.collect()}
    assert {(k[0], k[1]) for k in got} == {("r1", c) for c in ("full_video", "question_only", "facts", "ordered", "sham")} | {("r2", "full_video"), ("r2", "question_only")}
    assert len(got) == 6 * 3 + 2 * 2
    one = got[("r1", "facts", "1", 1)]
    assert one.choices == ["green", "blue", "red"] and one.answer == "A" and one.answer_text == "green" and one.clue_text == f"{T.HEADING}\n- Visual fact: a b" and one.condition.effective_dose == 1 and one.visual_id is None
    assert got[("r1", "facts", "all", 0)].condition.effective_dose == 2
    assert got[("r1", "ordered", "all", 0)].clue_text == f"{T.HEADING}\n- Timed event: [t=0.25s] event e1\n- Timed event: [t=1-2.5s] event e2"
    sham = got[("r1", "sham", "all", 0)].clue_text.split("\n")
    assert set(sham[1:3]) == {"- Timed event: [t=000.000s] event e1", "- Timed event: [t=000.000-000.000s] event e2"} and sham[3] == "- Reasoning operator: xxxxxxx 00 xxxxxx"
    assert got[("r1", "full_video", "all", 0)].visual_id == got[("r1", "full_video", "all", 2)].visual_id != got[("r2", "full_video", "all", 0)].visual_id
    assert len({r.trial_id for r in got.values()}) == len(got)
    why = {(r.base_id, r.condition): r.reason for r in skipped.collect()}
    assert why[("r1", "only")] == "no_evidence_span" and why[("r1", "needs")] == "missing_required_oracle_fields:relations" and why[("r1", "any")] == "missing_all_required_any_oracle_fields" and why[("r1", "empty")] == "no_oracle_fact"
    assert why[("r2", "ordered")] == "no_matched_atomic_ordered_events" and why[("r2", "facts")] == "no_oracle_fact"
    assert {(r.condition, r.reason): r.n for r in T.skip_report(skipped).collect()}[("only", "no_evidence_span")] == 2
    back = {r.id: r for r in T.base_records(made).collect()}
    assert back["r1"].differing == 1 and back["r1"].choices == ["red", "green", "blue"] and back["r1"].answer == "B" and back["r2"].trials == 4
    assert T.inconsistent_trials(made, T.expanded(rows, conditions(), permutations="all")[0]).count() == 0
    assert {r.side for r in T.inconsistent_trials(made.where("base_id = 'r1'"), made).collect()} == {"missing"}
    assert T.result_design(made).where("condition = 'facts'").count() == 6
    audit = rows.where("id = 'r1'").select(T.matched_event_audit(F.col("diagnostic.oracles")).alias("a")).first().a
    assert (audit.shared_event_count, audit.unmatched_atomic_event_ids, audit.unmatched_ordered_event_ids) == (2, ["e3"], ["e4"])


def test_seeded_orders(spark):
    orders = T.seeded_orders(3, 8, 42, "b")
    assert orders[:3] == [[0, 1, 2], [1, 2, 0], [2, 0, 1]] and len({tuple(o) for o in orders[:6]}) == 6 and orders[6:] == orders[:2]
    stream, want = random.Random("42:b:option-permutation"), []
    while len(want) < 3:
        o = [0, 1, 2]
        stream.shuffle(o)
        if o not in orders[:3] and o not in want:
            want.append(o)
    assert orders[3:6] == want
    got = frame(spark, record("b")).select(T.orders(F.col("choices"), F.col("id"), 5, 42).alias("o"), T.orders(F.col("choices"), F.col("id"), 1, 42).alias("one")).first()
    assert got.o == orders[:5] and got.one == [[0, 1, 2]]
    assert T.option_permutations("All") is None and T.option_permutations("3") == 3
    for bad in (0, True, "x"):
        try:
            T.option_permutations(bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_condition_faults():
    assert all(not c.faults() for c in conditions())
    C = T.Condition
    bad = [C("", "visual", "full"), C("a", "x"), C("a", "visual"), C("a", "text_oracle"), C("a", "visual", "full", clue_fields=("relations",)), C("a", "text_oracle", clue_fields=("rumours",)), C("a", "text_oracle", clue_fields=("relations",), required_fields=("operator",)), C("a", "text_oracle", clue_fields=("relations",), doses=(1, 1)), C("a", "text_oracle", clue_fields=("relations",), matched_event_view="atomic"), C("a", "text_oracle", clue_fields=("relations",), sham_fields=("relations",))]
    assert all(c.faults() for c in bad)
    assert T.Condition.of({"name": "n", "input_channel": "text_oracle", "clue_fields": ["relations"], "doses": [0, "all"], "unknown": 1}).doses == (0, "all")


def test_prompts(spark):
    row = spark.createDataFrame([("Q?", ["a", "b"], " clue ")], "q string, c array<string>, t string")
    said = {}
    for channel in [*T.CHANNELS, "other"]:
        p = row.select(T.channel_prompt(F.col("q"), F.col("c"), F.lit(channel), F.col("t")).alias("p")).first().p
        said[channel] = None if p is None else (p.marker, p.suffix)
    tail = "Question: Q?\nOptions:\nA. a\nB. b\nAnswer:"
    assert said == {"question_only": (None, tail), "visual": ("<VISUAL>", "\n" + tail), "text_oracle": (None, "clue\n" + tail), "embedding_oracle": ("<VISUAL>", "\n" + tail), "visual_plus_text": ("<VISUAL>", "\nclue\n" + tail), "other": None}
    cut = spark.createDataFrame([("a<VISUAL>b<VISUAL>",), ("ab",)], "p string").select(T.around_mark(F.col("p")).alias("x")).collect()
    assert [tuple(r.x) for r in cut] == [("a", "b<VISUAL>"), ("ab", "")]


def test_record_helpers(spark):
    rows = frame(spark, record("r1", diagnostic={"provenance": {"source_id": "r1", "video_id": "v9", "annotation_file": "/x"}}))
    got = rows.select(R.visual_source().alias("s"), R.portable(F.col("diagnostic.provenance")).alias("p"), *R.metadata(), R.first_of(rows, "diagnostic.nothing", "diagnostic.pair_id").alias("f")).first()
    assert tuple(got.s) == ("diag", "video_id", "v9") and got.p == {"source_id": "r1", "video_id": "v9"} and got.dataset == "diag" and got.f == "standalone:r1"
    import hashlib

    want = "d:" + hashlib.sha256(json.dumps(["d", 3, "x\"y", "é"], ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()[:20]
    assert spark.range(1).select(R.stable_id("d", F.lit("3"), R.json_text(F.lit('x"y')), R.json_text(F.lit("é"))).alias("i")).first().i == want
    program = spark.createDataFrame([(["filter_color", "exist"], ["unique"]), ([], [])], "q array<string>, c array<string>").select(R.program_text(F.col("q"), F.col("c"), F.lit("c + q")).alias("t")).collect()
    assert [r.t for r in program] == ["candidate program: unique; question program: filter color -> exist; composition rule: c + q", None]
