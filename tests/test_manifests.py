"""Rows of any shape, lookups, folders of results, sinks, the model boundary and the verbs."""

import json

import pytest
from pyspark.sql import functions as F

from tarn.operators import models as O
from tarn.operators import resampling as B
from tarn.sources import manifests as M
from tarn.sources import sinks


def test_rows_of_any_shape(spark, tmp_path):
    rows = [
        {"id": 7, "conversations": [{"from": "human", "value": "<video>What?"}, {"from": "gpt", "value": " This. "}], "video": "a"}, {"caption": "A dog.", "video": {"path": "b.avi"}}, {"question": "Q", "answer": "x", "options": ["x", "y"], "image": "c.png"},
        {"question": "Q", "answer": "x", "choices": "[\"x\", \"z\"]", "video": "http://h/v"}, {"question": "no answer"}, {"question": "Describe it", "answer": "d", "video": "/abs/e"},
    ]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    (tmp_path / "b.json").write_text(json.dumps({"annotations": rows[:2]}))
    (tmp_path / "c.json").write_text(json.dumps(rows[0]))
    got = [r.asDict() for r in M.normalized(M.variants(spark, str(tmp_path / "a.jsonl")), "src", "/root").collect()]
    assert [(r["task"], r["media_type"], r["media_path"], r["question"], r["answer"], r["choices"]) for r in got] == [
        ("qa", "video", "/root/a.mp4", "What?", "This.", None), ("caption", "video", "/root/b.avi", "Describe the video.", "A dog.", None), ("mcq", "image", "/root/c.png", "Q", "x", ["x", "y"]), ("mcq", "video", "http://h/v", "Q", "x", ["x", "z"]), ("caption", "video", "/abs/e.mp4", "Describe it", "d", None)]
    assert got[0]["id"] == "src_7" and len(got[2]["id"]) == 24
    assert M.variants(spark, str(tmp_path / "b.json")).count() == 2 and M.variants(spark, str(tmp_path / "c.json")).count() == 1
    assert M.dataset_spec("o/Name:cfg:val") == {"dataset_id": "o/Name", "config": "cfg", "split": "val", "source": "name_cfg"} and M.dataset_spec("o/n")["split"] == "train"
    uris = spark.createDataFrame([("hf://datasets/o/n@main/a%20b/c.mp4",), ("hf://datasets/o/n/x+y.mp4",), ("/x",)], "u string").select(M.dataset_uri(F.col("u")).alias("x")).collect()
    assert [tuple(r.x) if r.x else None for r in uris] == [("o/n", "main", "a b/c.mp4"), ("o/n", None, "x+y.mp4"), None]


def test_trees_and_answers(spark):
    tree = {"tasks": [{"x": {"question": "Q1", "options": {"b": "two", "a": {"text": "one"}}, "answer": 1}}, [{"question": "Q2", "candidates": ["u", " "], "answer": "U", "inner": {"question": "no", "choices": [], "answer": 1}}]], "other": {"question": "no answer"}}
    documents = spark.createDataFrame([("f", json.dumps(tree))], "file string, t string").select("file", F.parse_json("t").alias("v"))
    items = M.mcq_items(documents, 4).withColumn("raw", F.coalesce(F.try_variant_get("v", "$.options", "variant"), F.try_variant_get("v", "$.candidates", "variant"))).withColumn("c", M.choice_list(F.col("raw")))
    got = {r.q: (r.c, r.a) for r in items.select(M.value(F.col("v"), ["question"]).alias("q"), "c", M.any_answer(F.variant_get("v", "$.answer", "variant"), F.col("c")).alias("a")).collect()}
    assert got == {"Q1": (["one", "two"], "B"), "Q2": (["u"], "U")}
    keyed = spark.createDataFrame([('{"Question": "q", "answer": ""}',)], "t string").select(F.parse_json("t").alias("v"))
    assert keyed.select(M.value(F.col("v"), ["question"], any_case=True).alias("a"), M.value(F.col("v"), ["answer"]).alias("b")).first() == ("q", None)
    said = spark.createDataFrame([("b", ["x", "y"]), ("Y", ["x", "y"]), ("z", None), (None, ["x"])], "a string, c array<string>").select(M.choice_answer(F.col("a"), F.col("c")).alias("l")).collect()
    assert [r.l for r in said] == ["B", "Y", "z", ""]
    dup = spark.createDataFrame([(2, "Q  ", ["A"], "a", "m"), (1, "q", ["a "], "A", "m"), (3, "q", ["b"], "A", "m")], "id int, q string, c array<string>, a string, m string")
    assert sorted(r.id for r in M.deduplicated(dup, M.semantic_key(F.col("m"), F.col("q"), F.col("c"), F.col("a")), ["id"]).collect()) == [1, 3]
    assert sorted(r.n for r in M.unique_ids(spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "n string, k int"), "n", ["k"], F.col("k").cast("string")).collect()) == ["x", "x_2", "y"]


def test_media(spark):
    files = spark.createDataFrame([("/m/video/a.mp4", 10), ("/m/b/c.avi", 200_000)], "path string, length long")
    index = M.media_index(files, "/m")
    rows = spark.createDataFrame([(1, "a.mp4"), (2, "./c"), (3, "b\\c.avi"), (4, "nothing"), (5, None)], "id int, raw string")
    assert {r.id: r.media_path for r in M.looked_up(rows, "raw", index).collect()} == {1: "/m/video/a.mp4", 2: "/m/b/c.avi", 3: "/m/b/c.avi", 4: None, 5: None}
    kept, counts = M.valid_media(spark.createDataFrame([(1, "/m/video/a.mp4"), (2, "/m/b/c.avi"), (3, "/no")], "id int, media_path string"), files)
    assert [r.id for r in kept.collect()] == [2] and {r.reason: r.rows for r in counts.collect()} == {"too_small": 1, "kept": 1, "missing": 1}
    assert M.fewer_than(rows, 6) and not M.fewer_than(rows, 5)


def test_groups_and_captions(spark):
    category = M.categories(spark.createDataFrame([("3", " ", "x; y;"), ("4", "m", None)], "index string, major string, minor string"))
    assert {r.group_id: r.categories for r in category.collect()} == {3: ["unknown", "x", "y"], 4: ["m"]}
    items = spark.createDataFrame([("3_pos", "What?\nA. one\n(B) two\nAnswer with the option.", "v.mp4", " a")], "idx string, question string, video_name string, GT string")
    r = M.group_records(items, "text", category, "/r/").first()
    assert (r.id, r.group_id, r.pair_role, r.question, r.choices, r.answer, r.media_path) == ("vinoground:text:3_pos", 3, "pos", "What?", ["one", "two"], "A", "/r/v.mp4")
    assert M.incomplete_groups(M.group_records(items, "text", category, "/r")).count() == 1
    rows = spark.createDataFrame([("a", ["x", "y", "z"]), ("b", None), ("c", [])], "id string, caps array<string>")
    assert [(r.id, r.caption_index, r.caption) for r in M.caption_variants(rows, "caps", 2).orderBy("id", "caption_index").collect()] == [("a", 0, "x"), ("a", 1, "y"), ("b", None, None), ("c", None, None)]
    assert [r.caption for r in M.caption_variants(rows, "caps", 1, 9).orderBy("id").collect()] == ["z", None, None]
    named = spark.createDataFrame([(None, "d/e.mp4", 5), ("x", "d/f.mp4", 6), (None, None, 7)], "own string, path string, row_index int")
    assert [r.i for r in named.select(M.row_identifier(named, "own", "path").alias("i")).collect()] == ["e", "x", "row_000007"]
    manifest = spark.createDataFrame([(None, "activitynet_v1"), ("v2", "x")], "video_id string, id string")
    fetch = spark.createDataFrame([("v1", "u", 1.0), ("v2", "u", 1.0), ("v3", "u", 9.0), ("v4", "u", None), ("v5", None, 1.0), ("v6", "u", 2.0)], "video_id string, video_url string, duration double")
    assert sorted(r.video_id for r in M.to_fetch(fetch, manifest, 5.0).collect()) == ["v4", "v6"] and M.to_fetch(fetch, manifest, 5.0, 1).count() == 1
    assert M.clip_record(spark.createDataFrame([("v", "/p", 1.0, "l", "y")], "video_id string, path string, duration double, label string, youtube_url string")).first().id == "activitynet_v"
    exported = spark.createDataFrame([("r 1", 0, "/p", None, None, None, "cap", 1, "l")], "row_id string, row_index int, media_path string, question string, answer string, choices array<string>, caption string, caption_index int, label string")
    e = M.exported_records(exported, "o/d").first()
    assert (e.id, e.task, e.answer, e.question) == ("o_d_r_1_cap01", "caption", "cap", "Describe the video.")
    assert [r.label for r in M.label_names(spark.createDataFrame([("0",), ("7",), ("",)], "c string"), "c", spark.createDataFrame([(0, "zero")], "number int, name string")).collect()] == ["zero", "7", None]


def test_folders_and_sinks(spark, tmp_path):
    for e, m, text in (("e1", "original", '{"id": 1, "correct": true}\n{"id": 1, "correct": false}\n'), ("e2", "original", '{"id": 2, "correct": true}\n'), ("e2", "reverse", "")):
        (tmp_path / "eval" / e / m).mkdir(parents=True)
        (tmp_path / "eval" / e / m / "predictions.jsonl").write_text(text)
    root = f"{tmp_path}/eval"
    rows = M.by_folder(spark, root, "predictions.jsonl", ["encoder", "mode"], "id string, correct boolean")
    assert sorted((r.encoder, r.mode, r.id) for r in rows.collect()) == [("e1", "original", "1"), ("e1", "original", "1"), ("e2", "original", "2")]
    assert M.by_folder(spark, f"{tmp_path}/none", "x.jsonl", ["e"], "id string").count() == 0 and M.folders(spark, root) == ["e1", "e2"] and M.folders(spark, root, "a, b") == ["a", "b"]
    assert [p.split("eval/")[1] for p in M.absent_parts(spark, root, ["e1", "e2"], ["original", "reverse"])] == ["e1/reverse/predictions.jsonl", "e2/reverse/predictions.jsonl"]
    assert M.last_by_id(spark.createDataFrame([(1, "a", 0), (1, "b", 1)], "id int, v string, n int"), "id", F.col("n")).first().v == "b"
    tasks = M.row_task(spark.createDataFrame([("1", None), ("2", "own"), ("3", None)], "id string, task_type string"), spark.createDataFrame([("1", None, "bench")], "id string, task_type string, benchmark string"))
    assert {r.id: r.task_name for r in tasks.collect()} == {"1": "bench", "2": "own", "3": "unknown"}
    table = spark.createDataFrame([("b", "ALL", "0.5"), ("a", "ALL", "x"), ("c", "one", "1"), ("z", "ALL", "1")], "encoder string, `group` string, m string")
    assert [(r.encoder, r.m) for r in M.report_rows(table, "ALL", ["m"], ["z"]).collect()] == [("z", 1.0), ("a", None), ("b", 0.5)]
    df = spark.createDataFrame([(2, "é", {"b": 1, "a": 2}), (1, "x", {})], "id int, t string, m map<string,int>")
    for name in ("o.jsonl", "o.jsonl.gz"):
        sinks.one_jsonl(df, f"{tmp_path}/{name}", ["id"])
        first = (tmp_path / name).read_bytes()
        sinks.one_jsonl(df.repartition(2), f"{tmp_path}/{name}", ["id"])
        assert (tmp_path / name).read_bytes() == first
    assert (tmp_path / "o.jsonl").read_text().splitlines()[1] == '{"id": 2, "m": {"a": 2, "b": 1}, "t": "é"}'
    assert sinks.csv_text([{"b": 1}, {"a": 2, "b": [1]}], ["a"]) == "a,b\n,1\n2,[1]\n" and sinks.csv_text([]) == "" and sinks.csv_text([], fields=["x"]) == "x\n"
    with pytest.raises(ValueError):
        sinks.reject_aliases({"out": f"{tmp_path}/x", "report": f"{tmp_path}/./x"})
    with pytest.raises(FileExistsError):
        sinks.refuse_overwrite([f"{tmp_path}/o.jsonl"])
    with pytest.raises(RuntimeError):
        sinks.yaml_file(f"{tmp_path}/y.yaml", {"a": 1}, lambda p: (_ for _ in ()).throw(RuntimeError("no")))
    assert not (tmp_path / "y.yaml").exists() and not list(tmp_path.glob(".y*"))
    part = lambda *ids: spark.createDataFrame([(i, i * 2) for i in ids], "trial_id int, v int")
    for ids in ((1, 2, 2), (2, 3)):
        sinks.append_new(part(*ids), f"{tmp_path}/results")
    assert sorted(r.trial_id for r in spark.read.parquet(f"{tmp_path}/results").collect()) == [1, 2, 3]


def test_models(spark):
    views = spark.createDataFrame([("v1", 1), ("v1", 2), ("v2", 3), (None, 4)], "visual_id string, n int")
    features = O.encoded(views, lambda: lambda b: [[[float(n), 1.0], [0.0, 2.0]] for n in b["n"]])
    assert {r.visual_id: r.tokens for r in features.collect()} == {"v1": [[1.0, 1.0], [0.0, 2.0]], "v2": [[3.0, 1.0], [0.0, 2.0]]} and O.feature_size(features) == 2
    with_tokens, lost = O.joined_features(spark.createDataFrame([("t1", "v1"), ("t2", "v9"), ("t3", None)], "trial_id string, visual_id string"), features)
    assert [r.visual_id for r in lost.collect()] == ["v9"] and with_tokens.where("tokens IS NULL").count() == 2
    trials = spark.createDataFrame([("t1", "0" * 63 + "1", ["a", "b"], "B"), ("t2", "0" * 64, ["a", "b"], "A")], "trial_id string, trial_content_sha256 string, choices array<string>, answer string")
    score = lambda: lambda b: [{"A": 2.0, "B": 1.0} for _ in range(len(b))]
    got = {r.trial_id: r for r in O.scored(trials, score).collect()}
    assert got["t1"].prediction == "B" and got["t1"].correct and not got["t2"].correct and abs(got["t2"].gold_margin + 1) < 1e-12 and [r.trial_id for r in O.scored(trials, score, 2, 1).collect()] == ["t1"]
    row = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]], [1, 2], [5], [9, 8])], "t array<array<float>>, p array<int>, s array<int>, a array<int>")
    out = row.select(O.padded(F.col("t"), 3).alias("pad"), O.training_places(F.col("p"), F.lit(4), F.col("s"), F.col("a"), 7).alias("x"), O.training_places(F.col("p"), F.lit(4), F.col("s"), F.col("a"), 4).alias("y"), O.projected(F.col("t"), [[1.0], [2.0]], [0.5]).alias("w"), O.gelu(F.array(F.array(F.lit(0.0), F.lit(1.0)))).alias("g")).first()
    assert out.pad.mask == [1, 1, 0] and out.pad.tokens[2] == [0.0, 0.0] and out.x.ids == [1, 2, -1, -1, 5, 9, 8] and out.x.labels == [-100] * 5 + [9, 8] and out.y.ids == [-1, 5, 9, 8] and out.w == [[5.5], [11.5]] and abs(out.g[0][1] - 0.8412) < 1e-3
    flags = O.perturbation_rows(spark.createDataFrame([(1, "original", "A", True), (1, "reverse", "B", False), (1, "shuffle", "A", True), (2, "original", "A", False), (2, "reverse", "A", False), (2, "shuffle", "B", True)], "id int, mode string, prediction string, correct boolean"))
    assert {r.id: (r.robust, r.temporal_sensitive, r.helped, r.reverse_changed, r.shuffle_changed) for r in flags.collect()} == {1: (False, True, False, True, False), 2: (False, False, True, False, True)}


def test_resampling(spark):
    """The stream form repeats its draws one by one and equals the plain form; batches do not matter."""
    import numpy as np

    values = {"c1": [1.0, 0.0], "c2": [1.0], "c3": [0.0, 0.0, 1.0], "c4": [1.0]}
    whole = np.concatenate(list(B.stream_counts(4, 50, 7)))
    assert np.array_equal(whole, np.concatenate(list(B.stream_counts(4, 50, 7, cells=12)))) and (whole.sum(1) == 4).all()
    units = [[x] for c in values for x in values[c]]
    members = [[0, 1], [2], [3, 4, 5], [6]]
    plain = B.grouped_bootstrap(units, members, lambda s: {"m": float(np.mean([u[0] for u in s]))}, 7, 50)
    sums = spark.createDataFrame([("g", c, float(sum(v)), float(len(v))) for c, v in values.items()], "g string, c string, num_m double, den_m double")
    got = B.stream_intervals(sums, ["g"], "c", ["m"], 50, lambda g: 7).first()
    assert all(abs(got[k] - plain[k]) < 1e-12 for k in ("m", "m_ci_low", "m_ci_high"))
    few = B.intervals(sums, ["g"], "c", ["m"], 200, 1).first()
    assert few.m == got.m and 0 <= few.m_ci_low <= few.m <= few.m_ci_high <= 1
    kept, B.BROADCAST_CLUSTERS = B.BROADCAST_CLUSTERS, 0
    try:
        assert B.intervals(sums, ["g"], "c", ["m"], 200, 1).first() == few
    finally:
        B.BROADCAST_CLUSTERS = kept
    assert B.stable_seed(42, "summary", ["a", 1]) == int.from_bytes(__import__("hashlib").sha256(b'[42, "summary", ["a", 1]]').digest()[:8], "big")


def test_verbs(spark, tmp_path):
    from test_trials import record

    from tarn import cli

    records = [record("a"), record("b", answer="C")]
    (tmp_path / "m.jsonl").write_text("".join(json.dumps(r) + "\n" for r in records))
    (tmp_path / "c.yaml").write_text("conditions:\n- {name: full_video, input_channel: visual, visual_view: full}\n- {name: question_only, input_channel: question_only}\n")
    t = str(tmp_path)
    assert cli.main(["validate", "--manifest", f"{t}/m.jsonl", "--report", f"{t}/v.json"], spark) == 0 and json.loads((tmp_path / "v.json").read_text())["valid"]
    assert cli.main(["build-trials", "--manifest", f"{t}/m.jsonl", "--conditions", f"{t}/c.yaml", "--out", f"{t}/trials", "--report", f"{t}/b.json", "--option-permutations", "all"], spark) == 0
    assert json.loads((tmp_path / "b.json").read_text())["trials"] == 12
    pairs = [{"video_id": f"x_{i}", "video_path": f"{i}.mp4", "question": "Q?", "candidates": ["l", "r"], "answer": a} for i, a in ((1, "l"), (2, "r"))]
    (tmp_path / "p.json").write_text(json.dumps(pairs))
    assert cli.main(["adapt", "--dataset", "mvp", "--annotations", f"{t}/p.json", "--media-root", "/m", "--split", "eval", "--out", f"{t}/o.jsonl", "--report", f"{t}/a.json"], spark) == 0
    assert len((tmp_path / "o.jsonl").read_text().splitlines()) == 2
    trials = spark.read.parquet(f"{t}/trials")
    rows = []
    for r in trials.collect():
        nll = {"A": 0.5, "B": 1.0, "C": 2.0}
        rows.append({"trial_id": r.trial_id, "base_id": r.base_id, "dataset": "diag", "information_family": "temporal_order", "question_family": "order", "reasoning_depth": "1", "resampling_unit_id": f"u{r.base_id}", "condition": r.condition.name, "input_channel": r.condition.input_channel, "requested_dose": "0", "effective_dose": "0", "permutation_index": str(r.condition.permutation_index), "choices": r.choices, "answer": r.answer, "choice_nll": nll})
    (tmp_path / "pred.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    (tmp_path / "man.jsonl").write_text("".join(json.dumps({k: v for k, v in r.items() if k != "choice_nll"}) + "\n" for r in rows))
    run = ["analyze", "--predictions", f"{t}/pred.jsonl", "--manifest", f"{t}/man.jsonl", "--out", f"{t}/out", "--replicates", "5"]
    assert cli.main(run, spark) == 0 and cli.main([*run, "--overwrite", "--require-complete"], spark) == 1
    assert len((tmp_path / "out" / "summary.csv").read_text().splitlines()) == 3 and "condition_vs_reference" in (tmp_path / "out" / "comparisons.csv").read_text()
    (tmp_path / "s.yaml").write_text("analysis: {bootstrap_replicates: 5}\nconfirmatory_comparisons: [[full_video, question_only]]\n")
    assert cli.main([*run, "--overwrite", "--config", f"{t}/s.yaml"], spark) == 0
    stated = (tmp_path / "out" / "confirmatory.csv").read_text().splitlines()
    assert len(stated) == 2 and "full_video_minus_question_only" in stated[1] and "broadcast_single_dose" in stated[1]
    with pytest.raises(FileExistsError):
        cli.main(run, spark)
