"""Official annotation shapes to records, in small."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tarn.operators import validation as V
from tarn.sources import connectors as C


def problems(records):
    return {r.id: r.problems for r in records.select("id", "problems").collect()}


def ident(dataset, *parts):
    return f"{dataset}:" + hashlib.sha256(json.dumps([dataset, *parts], ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()[:20]


def valid(records):
    return C.loaded(records).select(F.flatten(F.collect_list(V.record_issues())).alias("i")).first().i == []


def scene(i=3, **q):
    question = {"question_id": 1, "question_type": "explanatory", "question_subtype": None, "question": "Why?", "program": ["a_b"], "choices": [{"choice_id": 0, "choice": "x", "answer": "correct", "program": ["c"]}, {"choice_id": 1, "choice": "y", "answer": "Wrong", "program": []}], **q}
    return {"scene_index": i, "video_filename": f"video_{i:05d}.mp4", "questions": [question, {**question, "question_id": 9, "question_type": "descriptive", "choices": []}]}


def test_scene_questions(spark):
    truth = spark.createDataFrame([(3, [(1, "red", "metal", "cube"), (0, "blue", "rubber", "sphere")], [(40, [1, 0]), (5, [0, 1])])], C.SCENE_TRUTH_SHAPE)
    out = C.scene_questions(spark.createDataFrame([scene()], C.SCENES_SHAPE), "/m", "eval", truth)
    rows = sorted(out.collect(), key=lambda r: r.diagnostic.official_candidate_id)
    assert [r.id for r in rows] == [ident("clevrer", 3, "1", "0"), ident("clevrer", 3, "1", "1")] and [r.answer for r in rows] == ["B", "A"] and all(r.problems == [] for r in rows) and valid(out)
    d = rows[0].diagnostic
    assert d.independent_unit_id == "clevrer:3:1" and d.official_candidate_count == 2 and d.reasoning_depth == 2 and d.resampling_unit_id == "clevrer:scene:3" and rows[0].media_path == "/m/video_00003.mp4"
    assert [f.text for f in d.oracles.static_facts] == ["Object 0 is a blue rubber sphere.", "Object 1 is a red metal cube."] and [f.frame for f in d.oracles.ordered_events] == [5.0, 40.0] and all(f.frame is None for f in d.oracles.unordered_events)
    assert [f.event_id for f in d.oracles.unordered_events] == sorted(f.event_id for f in d.oracles.ordered_events) and d.oracles.operator[0].text == "candidate program: c; question program: a b; composition rule: choice_program + question_program"
    bad = spark.createDataFrame([scene(question_type="odd"), scene(4, choices=[{"choice_id": 0, "choice": " ", "answer": "maybe", "program": []}]), scene(5, choices=[])], C.SCENES_SHAPE)
    said = [p for r in C.scene_questions(bad, "/m", "eval").collect() for p in r.problems]
    assert {"question_type", "choice", "answer", "no candidates"} <= set(said)
    worse = spark.createDataFrame([(3, [(1, "red", "metal", "cube")], [(40, [1, 0]), (-5, [1, 1])])], C.SCENE_TRUTH_SHAPE)
    assert {"a collision of an unknown object", "a faulty collision frame", "a collision needs two different objects"} <= set(C.scene_oracles(worse).first().truth_problems)
    assert spark.range(1).select(C.scene_file(F.lit(7))).first()[0] == "sim_00007.json"


def test_option_questions(spark):
    questions = spark.createDataFrame([("u1", "Q?", None, *"abcde"), ("u2", "Q?", None, *"aacde"), ("u3", "Q?", None, *"abcde")], C.OPTION_SHAPE)
    out = C.option_questions(questions, spark.createDataFrame([("u1", 4), ("u2", 0), ("u9", 0)], "key string, value int"), "/m", "eval")
    got = {r.diagnostic.provenance["source_id"]: r for r in out.collect()}
    assert set(got) == {"u1", "u2", "u9"} and got["u1"].answer == "E" and got["u1"].problems == [] and got["u2"].problems == ["duplicate choices"] and "an answer to an unknown question" in got["u9"].problems and got["u1"].id == ident("egoschema", "u1")


def test_grounded_questions(spark):
    rows = [("v1", "1", "CW", "Why?", "B!", "a", "b!", "c", "d", "e"), ("v1", "2", "XX", "Q", "a", *"abcde"), ("v2", "1", "DC", "Q", "a", *"abcde"), ("v1", "3", "TN", "Q", "e", *"abcde")]
    grounding = spark.createDataFrame([("v1", (10.0, 3.0, {"1": [[-0.2, 4.0], [5.0, 10.5]], "3": [[4.0, 2.0]], "2": [[0.0, 1.0]]}))], f"key string, value {C.GROUNDING_SHAPE}")
    out = C.grounded_questions(spark.createDataFrame(rows, C.GROUNDED_SHAPE), grounding, spark.createDataFrame([("v1", "d/77")], "key string, value string"), "/m", "eval", "val")
    got = {r.diagnostic.provenance["source_id"]: r for r in out.collect()}
    one = got["v1:1"]
    assert one.problems == [] and one.answer == "B" and one.media_path == "/m/d/77.mp4" and [(s.start, s.end) for s in one.diagnostic.evidence_spans] == [(0.0, 4.0), (5.0, 10.5)] and one.diagnostic.information_family == "causal_compositional" and one.id == ident("next_gqa", "val", "v1:1")
    assert got["v1:2"].problems == ["type"] and "no grounding of the video" in got["v2:1"].problems and got["v1:3"].problems == ["an inconsistent interval"]


def test_paired_videos(spark):
    rows = [("a_1", "a1.mp4", "Q?", ["x", "y"], "x", None, None), ("a_2", "a2.mp4", "q? ", ["X", "y"], "Y", "src", None), ("b_1", "b.mp4", "Q?", ["x", "y"], "x", None, "temporal_reasoning"), ("c", "c.mp4", "Q?", ["x", "y"], "x", None, None), ("d_1", "d.mp4", "Q?", ["x", "y"], "x", None, None), ("d_2", "d.mp4", "Q?", ["x", "y"], "x", None, None)]
    out = C.paired_videos(spark.createDataFrame(rows, C.PAIRED_SHAPE), "/m", "eval", "intuitive_physics")
    got = {r.diagnostic.provenance["source_id"]: r for r in out.collect()}
    assert got["a_1"].problems == [] == got["a_2"].problems and got["a_2"].answer == "B" and got["a_1"].diagnostic.pair_role == "original" and got["a_2"].diagnostic.pair_id == "mvp:intuitive_physics:a"
    assert got["b_1"].problems == ["a pair needs both roles once"] and "no pair role" in got["c"].problems and set(got["d_1"].problems) == {"both roles show the same video", "the answer must change"} and got["b_1"].diagnostic.information_family == "temporal_order"
    pair = out.where(F.col("diagnostic.provenance")["official_pair_key"] == "a")
    assert valid(pair) and V.manifest_issues(C.loaded(pair)).where("level = 'error'").count() == 0
    half = spark.createDataFrame([("mvp", "a_1", "broken"), ("mvp", "zz", "unused"), ("other", "a_2", "x")], C.EXCLUSION)
    kept, issues = C.excluded(pair, half, "mvp")
    assert sorted((r.kind, r.source_id) for r in issues.collect()) == [("not closed", "mvp:intuitive_physics:a"), ("unused", "zz")] and kept.count() == 1
    assert [r.kind for r in C.exclusion_issues(spark.createDataFrame([("a", "b", " "), ("c", "d", "e"), ("c", "d", "f")], C.EXCLUSION)).orderBy("kind").collect()] == ["blank", "duplicate"]
    with pytest.raises(Exception, match="no pair role"):
        C.loaded(out).collect()


def test_reversed_videos(spark):
    q = "What moves?\nA. red\nB) blue"
    both = lambda a, b, other=q: [("v", {"action": [(q, a)]}), ("v_reverse", {"action": [(other, b)]})]
    shape = f"key string, value {C.DIMENSIONS_SHAPE}"
    meta = spark.createDataFrame([("v", ({"action": {"subject": "a dog", "action": "runs"}},)), ("v_reverse", ({},))], f"key string, value {C.META_SHAPE}")
    got = {r.diagnostic.provenance["video_key"]: r for r in C.reversed_videos(spark.createDataFrame(both("A. red", "blue"), shape), meta, "/m", "eval").collect()}
    assert got["v"].problems == [] and got["v"].choices == ["red", "blue"] and got["v"].question == "What moves?" and got["v"].diagnostic.pair_role == "original" and got["v_reverse"].diagnostic.pair_role == "counterfactual" and got["v"].diagnostic.pair_id == "tempcompass:v:action:0"
    fact = got["v"].diagnostic.oracles.unordered_events[0]
    assert fact.text == "a dog performs runs." and fact.access == "target_semantic" and got["v_reverse"].diagnostic.oracles.unordered_events == [] and got["v"].id == ident("tempcompass", "v", "action", 0, "What moves?")
    same = C.reversed_videos(spark.createDataFrame(both("red", "red"), shape), None, "/m", "eval").collect()
    other = C.reversed_videos(spark.createDataFrame(both("red", "blue", "What else moves?\nA. red\nB. blue"), shape), None, "/m", "eval").collect()
    assert {r.diagnostic.pair_role for r in [*same, *other]} == {"standalone"}
    cases = {"no options": "x", "A. a\nB. b": "a", "Q\nA. a\nC. b": "a", "Q\nA. a\nB. b\nlate": "a", "Q\nA. a\nB. b": "c", "Q\nA. a\nB. b ": "B. a"}
    rows = spark.createDataFrame(list(cases.items()), "q string, a string").select(C.labelled_question(F.col("q"), F.col("a")).alias("m")).collect()
    assert [r.m.problem for r in rows] == ["a prompt and two options are needed", "a prompt and two options are needed", "labels must be contiguous", "text after the options", "the answer matches no option", "the answer matches no option"]
    said = spark.createDataFrame([(d, {"subject": "s", "event1": "a", "event2": "b", d: "z"}) for d in C.DIMENSIONS], "d string, v map<string,string>").select(C.dimension_sentence(F.col("d"), F.col("v")).alias("t")).collect()
    assert [r.t for r in said] == ["s performs z.", "s moves with direction: z.", "s has speed: z.", "For s, a occurs before b.", "s changes state: z."]


def test_task_questions(spark):
    row = lambda task, i, **k: {**dict.fromkeys(["question_id", "start", "end", "accurate_start", "accurate_end", "video_length"]), "video": f"{i}.mp4", "question": "Q?", "candidates": ["a", "b"], "answer": "b", "task": task, **k}
    rows = [row("action_localization", 1, start=1.0, end=2.0, accurate_start=1.2, accurate_end=1.8), row("action_sequence", 2, start=3.0, end=2.0), row("action_sequence", 3), row("object_count", 4, question_id="q7"), row("dance", 5)]
    got = {r.media_path: r for r in C.task_questions(spark.createDataFrame(rows, C.TASKS_SHAPE + ", task string"), "/m", "eval").collect()}
    assert got["/m/action_localization/1.mp4"].diagnostic.evidence_spans[0].start == 1.2 and got["/m/action_sequence/2.mp4"].problems == ["an invalid interval"] and got["/m/action_sequence/3.mp4"].problems == ["no interval"]
    assert got["/m/object_count/4.mp4"].diagnostic.provenance["source_id"] == "object_count:q7" and got["/m/object_count/4.mp4"].answer == "B" and "task" in got["/m/dance/5.mp4"].problems


def tracked(split="train", **more):
    track = lambda i, frames: (i, "cup", [[0.0, 0.0, 0.5, 0.5]] * len(frames), [1] * len(frames), frames, [float(f) for f in frames], [0] * len(frames))
    segment = lambda i, a, b, objects=(0,): (i, f"act {i}", [a * 1e5, b * 1e5], [a, b], list(objects))
    v = {"metadata": ("v", 10.0, 100, split), "mc_question": [(0, "Q?", ["a", "b", "c"], 2, "Physics", "Descriptive", ["motion"])], "object_tracking": [track(0, [1, 30]), track(1, [60, 61])], "action_localisation": [segment("x", 1, 5), segment("y", 2, 60)], "sound_localisation": [segment("s", 3, 4, (-1,))], **more}
    return ("v", tuple(v.values()))


def test_tracked_videos(spark):
    shape = f"key string, value {C.TRACKED_SHAPE}"
    cuts = spark.createDataFrame([("v", 50)], "key string, value int")
    r = C.tracked_videos(spark.createDataFrame([tracked()], shape), cuts, "/m", "eval", audio=True).first()
    o = r.diagnostic.oracles
    assert r.problems == [] and r.answer == "C" and r.diagnostic.information_family == "causal_compositional" and r.diagnostic.media_clip.end_frame_exclusive == 50 and [f.text for f in o.static_facts] == ["Entity 0 is a cup."]
    assert [f.event_id for f in o.unordered_events] == ["x", "s"] and [(f.start_sec, f.end_sec) for f in o.ordered_events] == [(0.1, 0.5)]
    assert any("cut frame" in p for p in C.tracked_videos(spark.createDataFrame([tracked()], shape), None, "/m", "eval").first().problems)
    assert C.tracked_videos(spark.createDataFrame([tracked(split="test")], shape), None, "/m", "eval").first().problems == []
    bad = tracked(split="test", object_tracking=[(0, "cup", [[0.0, 0.0, 0.5, 1.5]], [1], [1], [1.0], [0])], action_localisation=[("x", "act", [5.0, 1.0], [0, 1], [7])])
    assert C.tracked_videos(spark.createDataFrame([bad], shape), None, "/m", "eval").first().problems == ["a faulty track", "a faulty action"]
    topics = [("memory", "x", []), ("a", "b", ["count"]), ("a", "after", []), ("motion", "x", []), ("a", "b", []), ("a", "Predictive", [])]
    got = spark.createDataFrame(topics, "a string, r string, t array<string>").select(C.topic_family(F.col("a"), F.col("r"), F.col("t")).alias("f"), C.reasoning_depth(F.col("r")).alias("d")).collect()
    assert [r.f for r in got] == ["binding_tracking", "metric_temporal", "temporal_order", "local_motion", "static", "causal_compositional"] and got[-1].d == 2 and got[0].d == 1


def test_shared(spark, tmp_path):
    assert C.connector(" Next-GQA ") is C.grounded_questions
    with pytest.raises(ValueError):
        C.connector("nothing")
    assert C.eligibility_issues(True, False, allow_uncut=True, other=False) == ["limited", "media not required", "allow_uncut"]
    rows = spark.createDataFrame([(1, "/m/a.mp4"), (2, "/m/b.mp4"), (3, "/m/c.mp4"), (4, "/m/d.mp4")], "id int, media_path string").withColumn("problems", F.array().cast("array<string>"))
    files = spark.createDataFrame([("/m/a.mp4",), ("/m/x/b.mp4",), ("/m/x/c.mp4",), ("/m/y/c.mp4",)], "path string")
    got = {r.id: (r.media_path, r.problems) for r in C.resolved(rows, files).collect()}
    assert got == {1: ("/m/a.mp4", []), 2: ("/m/x/b.mp4", []), 3: ("/m/c.mp4", ["ambiguous media"]), 4: ("/m/d.mp4", ["media not found"])}
    (tmp_path / "k.json").write_text('{"v": {"duration": 2, "location": {"1": [[0, 1]]}}}')
    assert C.annotations(spark, str(tmp_path / "k.json"), C.GROUNDING_SHAPE, keyed=True).first().value.duration == 2.0
    literals = spark.createDataFrame([("['a', \"b\"]",), ('["x"]',), ("['it\\'s', 'b']",), ("no",)], "t string").select(C.list_literal(F.col("t")).alias("l")).collect()
    assert [r.l for r in literals][:2] == [["a", "b"], ["x"]]
    cover = C.coverage(C.loaded(C.paired_videos(spark.createDataFrame([("a_1", "1", "Q", ["x", "y"], "x", None, None), ("a_2", "2", "Q", ["x", "y"], "y", None, None)], C.PAIRED_SHAPE), "/m", "eval"))).first()
    assert (cover.rows, cover.with_evidence, cover.with_safe_facts) == (2, 0, 0)
