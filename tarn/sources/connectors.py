"""Connectors: official annotations of video question sets to base records.

Each takes a DataFrame of annotations in its declared shape (`*_SHAPE`; files are read with `annotations`) and returns
records (functions.records.RECORD) with a column `problems`: every rule that a row breaks. `loaded` applies exclusions and
turns remaining problems into an error; nothing is dropped silently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fields as X
from ..functions import records as R
from ..functions import text as T
from ..functions.scores import missing

NONE = "array<string>"


def _problems(*rules: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(True)), message) for test, message in rules)))


def annotations(spark: SparkSession, path: str, shape: str, keyed: bool = False) -> DataFrame:
    """A JSON file as rows of `shape`: an array of objects, or (keyed) an object whose entries become (key, value) rows."""
    if keyed:
        return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{shape}>")).alias("key", "value"))
    return spark.read.schema(shape).json(path, multiLine=not path.endswith((".jsonl", ".jsonl.gz")))


def media_path(root: str, *candidates: Column) -> Column:
    """The first candidate under a root; rows that must name an existing file go through `resolved`."""
    return F.concat(F.lit(root.rstrip("/") + "/"), F.regexp_replace(candidates[0], "^(\\./)+", ""))


def candidate_issues(choices: Column, least: int = 2, most: int = 26) -> list[tuple[Column, str]]:
    return [
        (~F.size(choices).between(least, most), "the number of choices"), (F.exists(choices, missing), "an empty choice"),
        (F.size(F.array_distinct(F.transform(choices, X.folded))) != F.size(choices), "duplicate choices"),
    ]


def text_answer(answer: Column, choices: Column) -> Column:
    """The letter of the one choice that an answer's text names; null if none or several."""
    same = F.filter(F.sequence(F.lit(0), F.size(choices) - 1), lambda i: X.folded(F.get(choices, i)) == X.folded(answer))
    return F.when(F.size(same) == 1, T.option_label(F.get(same, 0)))


def list_literal(c: Column) -> Column:
    """A list written as ['a', "b"] or [a] as an array: JSON first, else single quotes taken as double ones."""
    return F.coalesce(F.from_json(c, NONE), F.from_json(F.regexp_replace(F.regexp_replace(c, r"(?<=[\[,\s])'|'(?=\s*[,\]])", '"'), r"\\'", "'"), NONE))


def provenance(**values: Column | str) -> Column:
    """A map of what is there."""
    pairs = F.array(*(F.struct(F.lit(k).alias("k"), (v if isinstance(v, Column) else F.lit(v)).cast("string").alias("v")) for k, v in values.items()))
    return F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))


# scenes with questions of several binary candidates ------------------------------------------------------------------

SCENES_SHAPE = (
    "scene_index int, video_filename string, questions array<struct<question_id:int,question_type:string,question_subtype:string,question:string,program:array<string>,"
    "choices:array<struct<choice_id:int,choice:string,answer:string,program:array<string>>>>>"
)
SCENE_TRUTH_SHAPE = "scene_index int, objects array<struct<id:int,color:string,material:string,shape:string>>, collisions array<struct<frame:int,object:array<int>>>"
#: Question kind to reasoning depth (fixed values).
SCENE_DEPTH = {"explanatory": 2, "predictive": 2, "counterfactual": 3}


def scene_file(index: Column) -> Column:
    return F.format_string("sim_%05d.json", index)


def described(o: Column) -> Column:
    return F.concat_ws(" ", o["color"], o["material"], o["shape"])


def scene_oracles(truth: DataFrame) -> DataFrame:
    """scene_index, oracles, truth_problems: objects as static facts, collisions as unordered (by digest) and ordered events."""
    objects, hits = F.col("objects"), F.coalesce(F.col("collisions"), F.array())
    of = lambda i: F.get(F.filter(objects, lambda o: o["id"] == i), F.lit(0))
    static = F.transform(F.array_sort(F.transform(objects, lambda o: F.struct(o["id"].alias("id"), o.alias("o")))), lambda x: R.fact(F.concat(F.lit("Object "), x["id"].cast("string"), F.lit(" is a "), described(x["o"]), F.lit(".")), source="ground_truth.objects"))

    def event(c: Column, i: Column, timed: bool) -> Column:
        a, b = F.get(c["object"], 0), F.get(c["object"], 1)
        key = R.stable_id("clevrer_collision", F.col("scene_index").cast("string"), i.cast("string"), a.cast("string"), b.cast("string"))
        say = lambda x: F.concat(x.cast("string"), F.lit(" ("), described(of(x)), F.lit(")"))
        text = F.concat(F.lit("Object "), say(a), F.lit(" collides with object "), say(b), F.lit("."))
        more = {"frame": c["frame"]} if timed else {}
        return F.struct(c["frame"].alias("frame"), F.array_min(c["object"]).alias("low"), F.array_max(c["object"]).alias("high"), key.alias("key"), R.fact(text, source="ground_truth.collisions", event_id=key, **more).alias("fact"))

    timed = F.transform(F.array_sort(F.transform(hits, lambda c, i: event(c, i, True))), lambda x: x["fact"])
    plain = F.transform(F.array_sort(F.transform(hits, lambda c, i: F.struct(event(c, i, False)["key"].alias("key"), event(c, i, False)["fact"].alias("fact")))), lambda x: x["fact"])
    ids = F.transform(objects, lambda o: o["id"])
    same = F.transform(hits, lambda c: F.concat_ws(":", c["frame"].cast("string"), F.array_min(c["object"]).cast("string"), F.array_max(c["object"]).cast("string")))
    wrong = _problems(
        (F.size(objects) < 1, "no objects"), (F.size(F.array_distinct(ids)) != F.size(ids), "duplicate object id"), (F.exists(objects, lambda o: o["id"].isNull() | (o["id"] < 0) | missing(o["color"]) | missing(o["material"]) | missing(o["shape"])), "a faulty object"),
        (F.exists(hits, lambda c: c["frame"].isNull() | (c["frame"] < 0)), "a faulty collision frame"), (F.exists(hits, lambda c: (F.size(c["object"]) != 2) | (F.get(c["object"], 0) == F.get(c["object"], 1))), "a collision needs two different objects"),
        (F.exists(hits, lambda c: F.exists(c["object"], lambda i: ~F.array_contains(ids, i))), "a collision of an unknown object"), (F.size(F.array_distinct(same)) != F.size(same), "duplicate collision"),
    )
    return truth.select("scene_index", R.oracles(static_facts=static, unordered_events=plain, ordered_events=timed).alias("oracles"), wrong.alias("truth_problems"))


def scene_questions(scenes: DataFrame, root: str, split: str, truth: DataFrame | None = None, dataset: str = "clevrer") -> DataFrame:
    """One Yes/No record for every candidate of every question that is not descriptive; a question is the independent unit."""
    rows = scenes.select("scene_index", "video_filename", F.explode("questions").alias("q"))
    twice = Window.partitionBy("scene_index", F.col("q.question_id"))
    rows = rows.withColumn("__q", F.count("*").over(twice)).withColumn("kind", F.lower(F.trim("q.question_type"))).where("kind <> 'descriptive' OR kind IS NULL OR size(q.choices) > 0")
    rows = rows.select("*", F.explode_outer("q.choices").alias("c"))
    scene, qid, cid = (F.col(x).cast("string") for x in ("scene_index", "q.question_id", "c.choice_id"))
    if truth is not None:
        rows = rows.join(scene_oracles(truth), "scene_index", "left")
        oracles, lost = F.col("oracles"), [(F.col("oracles").isNull(), "no scene annotation"), (F.size("truth_problems") > 0, "a faulty scene annotation")]
    else:
        oracles, lost = R.oracles(), []
    program = R.program_text(F.col("q.program"), F.col("c.program"), F.lit("choice_program + question_program"))
    operator = F.when(program.isNotNull(), F.array(R.fact(program, access="operator_only")))
    oracles = oracles.withField("operator", operator.cast(R.NO_FACTS))
    group = F.concat_ws(":", F.lit(dataset), scene, qid)
    said = F.lower(F.trim("c.answer"))
    wrong = _problems(
        (F.col("scene_index").isNull() | (F.col("scene_index") < 0), "scene_index"), (missing(F.col("video_filename")), "video_filename"), (F.col("q.question_id").isNull() | (F.col("q.question_id") < 0), "question_id"), (F.col("__q") > F.greatest(F.lit(1), F.lit(1)), "duplicate question_id"),
        (~F.col("kind").isin(*SCENE_DEPTH), "question_type"), (F.col("c").isNull(), "no candidates"), (F.col("c.choice_id").isNull() | (F.col("c.choice_id") < 0), "choice_id"),
        (F.size(F.filter("q.choices", lambda x: x["choice_id"] == F.col("c.choice_id"))) > 1, "duplicate choice_id"), (missing(F.col("q.question")), "question"), (missing(F.col("c.choice")), "choice"), (~said.isin("correct", "wrong"), "answer"), *lost,
    )
    depth = F.create_map(*(F.lit(x) for kv in SCENE_DEPTH.items() for x in kv))
    return R.record(rows, {
        "id": R.stable_id(dataset, scene, R.json_text(qid), R.json_text(cid)), "source": dataset.upper(), "benchmark": F.concat(F.lit(f"{dataset}:"), F.col("kind")), "task": F.lit("binary_mcq"), "media_path": media_path(root, F.col("video_filename")),
        "question": F.concat(F.trim("q.question"), F.lit("\nCandidate statement: "), F.trim("c.choice"), F.lit("\nIs this candidate statement correct?")), "choices": F.array(F.lit("No"), F.lit("Yes")), "answer": F.when(said == "correct", "B").when(said == "wrong", "A"),
        "dataset": dataset, "split": split, "information_family": "causal_compositional", "question_family": F.concat(F.lit(f"{dataset}:"), F.col("kind")), "reasoning_depth": F.coalesce(F.try_element_at(depth, F.col("kind")), F.lit(0)),
        "resampling_unit_id": F.concat(F.lit(f"{dataset}:scene:"), scene), "independent_unit_id": group, "official_candidate_id": cid, "official_candidate_count": F.size("q.choices"), "oracles": oracles, "problems": wrong,
        "provenance": provenance(source_id=F.concat_ws(":", scene, qid, cid), scene_index=scene, question_id=qid, choice_id=cid, question_group=group, question_type=F.col("kind"), question_subtype=F.col("q.question_subtype"), candidate_statement=F.trim("c.choice"), official_choice_label=said),
    })


# questions with answers in a second file -----------------------------------------------------------------------------

OPTION_SHAPE = "q_uid string, question string, google_drive_id string, `option 0` string, `option 1` string, `option 2` string, `option 3` string, `option 4` string"


def option_questions(questions: DataFrame, answers: DataFrame, root: str, split: str, dataset: str = "egoschema") -> DataFrame:
    """questions with their 0-based answers (key, value); questions without an answer are none of the set, an answer without a question is a problem."""
    seen = questions.withColumn("__n", F.count("*").over(Window.partitionBy("q_uid")))
    rows = answers.select(F.col("key").alias("uid"), F.col("value").cast("int").alias("given")).join(seen, F.col("uid") == F.col("q_uid"), "left")
    choices = F.array(*(F.trim(F.col(f"option {i}")) for i in range(5)))
    rows = rows.withColumn("choices", choices)
    answer = X.integer_answer(F.col("given"), F.col("choices"), 0)
    wrong = _problems((F.col("q_uid").isNull(), "an answer to an unknown question"), (F.col("__n") > 1, "duplicate question"), *candidate_issues(F.col("choices")), (answer.isNull(), "answer"), (missing(F.col("question")), "question"))
    return R.record(rows, {
        "id": R.stable_id(dataset, R.json_text(F.col("uid"))), "source": "EgoSchema", "benchmark": f"{dataset}:public_500", "media_path": media_path(root, F.concat(F.col("uid"), F.lit(".mp4"))), "question": F.col("question"), "choices": F.col("choices"), "answer": answer,
        "dataset": dataset, "split": split, "information_family": "long_range_selection", "question_family": f"{dataset}:long_range_compositional", "reasoning_depth": 2, "resampling_unit_id": F.concat(F.lit(f"{dataset}:video:"), F.col("uid")), "problems": wrong,
        "provenance": provenance(source_id=F.col("uid"), q_uid=F.col("uid"), google_drive_id=F.col("google_drive_id"), source_split="public_500", answer_index_base="0"),
    })


# questions with grounded spans ---------------------------------------------------------------------------------------

GROUNDED_SHAPE = "video_id string, qid string, type string, question string, answer string, a0 string, a1 string, a2 string, a3 string, a4 string"
GROUNDING_SHAPE = "struct<duration:double,fps:double,location:map<string,array<array<double>>>>"


def question_family(kind: Column) -> Column:
    """struct(family, depth) by the first letter of a question type: causal, temporal or descriptive; null for others."""
    first = F.upper(F.substring(F.trim(kind), 1, 1))
    pair = lambda f, d: F.struct(F.lit(f).alias("family"), F.lit(d).alias("depth"))
    return F.when(first == "C", pair("causal_compositional", 2)).when(first == "T", pair("temporal_order", 2)).when(first == "D", pair("static", 0))


def grounded_spans(spans: Column, duration: Column, video: Column, qid: Column) -> tuple[Column, Column]:
    """(spans, whether one is wrong): starts down to -1 are rounding and become 0, ends may exceed the duration by 1."""
    made = F.transform(spans, lambda s, i: F.struct(F.greatest(F.get(s, 0), F.lit(0.0)).alias("start"), F.get(s, 1).alias("end"), F.lit("seconds").alias("unit"), F.lit("necessary").alias("role"), F.concat_ws(":", video, qid, F.lit("evidence"), i.cast("string")).alias("event_id")))
    odd = F.exists(spans, lambda s: F.coalesce((F.size(s) != 2) | (F.get(s, 0) < -1) | (F.get(s, 1) <= F.greatest(F.get(s, 0), F.lit(0.0))) | (F.get(s, 1) > duration + 1), F.lit(True)))
    return made, odd


def grounded_questions(questions: DataFrame, grounding: DataFrame | None, video_map: DataFrame | None, root: str, split: str, source_split: str, dataset: str = "next_gqa") -> DataFrame:
    """Multiple-choice rows with their evidence spans (grounding: key, value) and video paths (video_map: key, value)."""
    rows = questions
    if grounding is not None:
        rows = rows.join(grounding.select(F.col("key").alias("__v"), F.col("value").alias("g")), F.col("video_id") == F.col("__v"), "left")
    if video_map is not None:
        rows = rows.join(video_map.select(F.col("key").alias("__m"), F.col("value").cast("string").alias("mapped")), F.col("video_id") == F.col("__m"), "left")
    mapped = F.coalesce(F.col("mapped"), F.col("video_id")) if video_map is not None else F.col("video_id")
    choices = F.array(*(F.trim(F.col(f"a{i}")) for i in range(5)))
    rows = rows.withColumn("choices", choices)
    answer, kind = text_answer(F.col("answer"), F.col("choices")), question_family(F.col("type"))
    rules = [(missing(F.col("video_id")), "video_id"), (missing(F.col("qid")), "qid"), (kind.isNull(), "type"), *candidate_issues(F.col("choices")), (answer.isNull(), "answer"), (missing(F.col("question")), "question")]
    values: dict[str, Column | str | int] = {}
    if grounding is not None:
        found = F.try_element_at(F.col("g.location"), F.col("qid"))
        spans, odd = grounded_spans(found, F.col("g.duration"), F.col("video_id"), F.col("qid"))
        rules += [(F.col("g").isNull(), "no grounding of the video"), (F.col("g").isNotNull() & ~(F.col("g.duration") > 0), "duration"), (F.col("g").isNotNull() & (F.coalesce(F.size(found), F.lit(0)) < 1), "no evidence for the question"), (odd & found.isNotNull(), "an inconsistent interval")]
        values["evidence_spans"] = spans
    source = F.concat_ws(":", F.col("video_id"), F.col("qid"))
    file = F.when(mapped.rlike(r"\.[^./]+$"), mapped).otherwise(F.concat(mapped, F.lit(".mp4")))
    return R.record(rows, {
        "id": R.stable_id(dataset, R.json_text(F.lit(source_split)), R.json_text(source)), "source": "NExT-GQA", "benchmark": dataset, "media_path": media_path(root, file), "question": F.col("question"), "choices": F.col("choices"), "answer": answer, "dataset": dataset, "split": split,
        "information_family": kind["family"], "question_family": F.concat(F.lit(f"{dataset}:"), F.col("type")), "reasoning_depth": kind["depth"], "resampling_unit_id": F.concat(F.lit(f"{dataset}:video:"), mapped), "problems": _problems(*rules),
        "provenance": provenance(source_id=source, video_id=F.col("video_id"), qid=F.col("qid"), question_type=F.col("type"), mapped_video_id=mapped, source_split=source_split), **values,
    })


# minimal pairs of videos ---------------------------------------------------------------------------------------------

PAIRED_SHAPE = "video_id string, video_path string, question string, candidates array<string>, answer string, source string, category string"
#: Category to information family (fixed values); other categories are causal_compositional.
PAIR_FAMILIES = {"human_object_interactions": "binding_tracking", "robot_object_interactions": "binding_tracking", "intuitive_physics": "causal_compositional", "temporal_reasoning": "temporal_order"}


def paired_videos(rows: DataFrame, root: str, split: str, category: str = "unknown", dataset: str = "mvp") -> DataFrame:
    """Rows named <pair>_1 and <pair>_2: same question and candidates, other video, other answer; _1 is the original."""
    said = F.trim("video_id")
    out = rows.withColumns({
        "pair": F.regexp_extract(said, r"^(.+)_([12])$", 1), "role": F.regexp_extract(said, r"^(.+)_([12])$", 2).try_cast("int"), "choices": F.transform("candidates", lambda t: F.trim(t)), "kind": F.coalesce(F.when(~missing(F.col("category")), F.col("category")), F.lit(category)),
    }).withColumn("letter", text_answer(F.col("answer"), F.col("choices")))
    folded = F.transform("choices", X.folded)
    group = out.groupBy("pair").agg(
        F.count("*").alias("n"), F.count_distinct("role").alias("roles"), F.count_distinct("kind").alias("kinds"), F.count_distinct(X.folded(F.col("question"))).alias("questions"),
        F.count_distinct(F.array_join(folded, "\u0001")).alias("lists"), F.count_distinct("video_path").alias("videos"), F.count_distinct(X.folded(T.answer_text(F.col("letter"), F.col("choices")))).alias("answers"))
    out = out.join(group, "pair")
    wrong = _problems(
        (F.col("pair") == "", "no pair role"), (F.size("choices") != 2, "pairs are binary"), *candidate_issues(F.col("choices")), (F.col("letter").isNull(), "answer"), (missing(F.col("video_path")), "video_path"), (missing(F.col("question")), "question"),
        ((F.col("n") != 2) | (F.col("roles") != 2), "a pair needs both roles once"), (F.col("kinds") > 1, "the pair crosses categories"), (F.col("questions") > 1, "the questions differ"), (F.col("lists") > 1, "the candidates differ"),
        ((F.col("n") == 2) & (F.col("videos") < 2), "both roles show the same video"), ((F.col("n") == 2) & (F.col("answers") < 2), "the answer must change"),
    )
    family = F.create_map(*(F.lit(x) for kv in PAIR_FAMILIES.items() for x in kv))
    name = lambda p: F.concat_ws(":", F.lit(p), F.col("kind"), F.col("pair"))
    return R.record(out, {
        "id": R.stable_id(dataset, R.json_text(F.col("kind")), R.json_text(said)), "source": "MVP", "benchmark": F.concat(F.lit(f"{dataset}:"), F.col("kind")), "media_path": media_path(root, F.col("video_path")), "question": F.col("question"), "choices": F.col("choices"), "answer": F.col("letter"),
        "dataset": dataset, "split": split, "information_family": F.coalesce(F.try_element_at(family, F.col("kind")), F.lit("causal_compositional")), "question_family": F.concat(F.lit(f"{dataset}:"), F.col("kind")), "reasoning_depth": 2,
        "resampling_unit_id": name(f"{dataset}:video_family"), "pair_id": name(dataset), "pair_role": F.when(F.col("role") == 1, "original").otherwise("counterfactual"), "problems": wrong,
        "provenance": provenance(source_id=said, official_pair_key=F.col("pair"), official_pair_role=F.col("role"), raw_video=F.col("video_path"), source_dataset=F.coalesce(F.col("source"), F.lit("unknown")), category=F.col("kind"), answer_index_base="text"),
    })


# questions as labelled lines, with reversed videos -------------------------------------------------------------------

DIMENSIONS_SHAPE = "map<string,array<struct<question:string,answer:string>>>"
META_SHAPE = "struct<eval_dim:map<string,map<string,string>>>"
#: Dimension to information family (fixed values).
DIMENSIONS = {"action": "local_motion", "direction": "local_motion", "speed": "metric_temporal", "order": "temporal_order", "attribute_change": "binding_tracking"}
DIMENSION_FIELD = {"action": "unordered_events", "direction": "relations", "speed": "temporal_relations", "order": "temporal_relations", "attribute_change": "state_changes"}
_LINE = r"^\s*([A-Z])[.)]\s*(.+?)\s*$"


def labelled_question(said: Column, answer: Column) -> Column:
    """struct(question, choices, letter, problem) of a prompt followed by lines 'A. text' and an answer in either form."""
    lines = F.filter(F.split(said, r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"), lambda x: F.trim(x) != "")
    is_choice = lambda x: x.rlike(_LINE)
    options = F.filter(lines, is_choice)
    first = F.array_position(F.transform(lines, is_choice), F.lit(True)).cast("int")
    late = (first > 0) & F.exists(F.slice(lines, F.greatest(first, F.lit(1)), F.size(lines)), lambda x: ~is_choice(x))
    choices, labels = F.transform(options, lambda x: F.regexp_extract(x, _LINE, 2)), F.transform(options, lambda x: F.regexp_extract(x, _LINE, 1))
    expected = F.transform(F.sequence(F.lit(0), F.size(options) - 1), lambda i: F.char(i + 65))
    label, text = F.regexp_extract(answer, _LINE, 1), F.regexp_extract(answer, _LINE, 2)
    named = F.array_contains(labels, label) & (X.folded(F.get(choices, F.ascii(label) - 65)) == X.folded(text))
    letter = F.when(label != "", F.when(named, label)).otherwise(text_answer(answer, choices))
    prompt = F.array_join(F.transform(F.filter(lines, lambda x: ~is_choice(x)), lambda t: F.trim(t)), "\n")
    problem = (
        F.when(missing(said), "no question").when(late, "text after the options").when((prompt == "") | (F.size(options) < 2), "a prompt and two options are needed").when(labels != expected, "labels must be contiguous")
        .when(missing(answer), "no answer").when(letter.isNull(), "the answer matches no option")
    )
    return F.struct(prompt.alias("question"), choices.alias("choices"), letter.alias("letter"), problem.alias("problem"))


def dimension_sentence(dimension: Column, value: Column) -> Column:
    """A target fact as a sentence by its dimension."""
    get = lambda k: F.coalesce(F.try_element_at(value, F.lit(k)), F.lit("None"))
    who = X.present(F.try_element_at(value, F.lit("subject")), F.lit("the scene"))
    return (
        F.when(dimension == "action", F.concat(who, F.lit(" performs "), get("action"), F.lit("."))).when(dimension == "direction", F.concat(who, F.lit(" moves with direction: "), get("direction"), F.lit(".")))
        .when(dimension == "speed", F.concat(who, F.lit(" has speed: "), get("speed"), F.lit("."))).when(dimension == "order", F.concat(F.lit("For "), who, F.lit(", "), get("event1"), F.lit(" occurs before "), get("event2"), F.lit(".")))
        .when(dimension == "attribute_change", F.concat(who, F.lit(" changes state: "), get("attribute_change"), F.lit(".")))
    )


def reversed_videos(questions: DataFrame, meta: DataFrame | None, root: str, split: str, dataset: str = "tempcompass") -> DataFrame:
    """questions: (key, value DIMENSIONS_SHAPE). <video> and <video>_reverse are a pair where question and options agree and the answer changes."""
    rows = questions.select("key", F.explode("value").alias("dimension", "items")).select("key", "dimension", F.posexplode("items").alias("i", "item"))
    rows = rows.withColumn("m", labelled_question(F.col("item.question"), F.col("item.answer"))).withColumn("base", F.regexp_replace("key", "_reverse$", "")).withColumn("reverse", F.col("key").endswith("_reverse"))
    side = F.struct(F.col("m.question").alias("q"), F.col("m.choices").alias("c"), X.folded(T.answer_text(F.col("m.letter"), F.col("m.choices"))).alias("a"))
    both = rows.groupBy("base", "dimension", "i").agg(F.first(F.when(~F.col("reverse"), side), True).alias("o"), F.first(F.when(F.col("reverse"), side), True).alias("r"))
    paired = F.coalesce((F.col("o.q") == F.col("r.q")) & (F.col("o.c") == F.col("r.c")) & (F.col("o.a") != F.col("r.a")), F.lit(False))
    rows = rows.join(both.select("base", "dimension", "i", paired.alias("paired")), ["base", "dimension", "i"])
    oracles = R.oracles()
    rules = [(~F.col("dimension").isin(*DIMENSIONS), "dimension"), (F.col("m.problem").isNotNull(), "question")]
    if meta is not None:
        rows = rows.join(meta.select(F.col("key").alias("__k"), F.col("value").alias("meta")), F.col("key") == F.col("__k"), "left")
        value = F.try_element_at(F.col("meta.eval_dim"), F.col("dimension"))
        fact = F.when(value.isNotNull(), F.array(R.fact(dimension_sentence(F.col("dimension"), value), access="target_semantic", source="meta_info.eval_dim")))
        for field in sorted(set(DIMENSION_FIELD.values())):
            own = [d for d, f in DIMENSION_FIELD.items() if f == field]
            oracles = oracles.withField(field, F.coalesce(F.when(F.col("dimension").isin(*own), fact), F.array()).cast(R.NO_FACTS))
        rules.append((F.col("meta").isNull(), "no meta information"))
    family = F.create_map(*(F.lit(x) for kv in DIMENSIONS.items() for x in kv))
    source = F.concat_ws(":", "key", "dimension", F.col("i").cast("string"))
    ident = R.stable_id(dataset, R.json_text(F.col("key")), R.json_text(F.col("dimension")), F.col("i").cast("string"), R.json_text(F.col("m.question")))
    return R.record(rows, {
        "id": ident, "source": "TempCompass", "benchmark": dataset, "media_path": media_path(root, F.concat(F.col("key"), F.lit(".mp4"))), "question": F.col("m.question"), "choices": F.col("m.choices"), "answer": F.col("m.letter"), "dataset": dataset, "split": split,
        "information_family": F.try_element_at(family, F.col("dimension")), "question_family": F.concat(F.lit(f"{dataset}:"), F.col("dimension")), "reasoning_depth": F.when(F.col("dimension") == "order", 2).otherwise(1), "resampling_unit_id": F.concat(F.lit(f"{dataset}:video_family:"), F.col("base")),
        "pair_id": F.when(F.col("paired"), F.concat_ws(":", F.lit(dataset), "base", "dimension", F.col("i").cast("string"))), "pair_role": F.when(F.col("paired"), F.when(F.col("reverse"), "counterfactual").otherwise("original")), "oracles": oracles, "problems": _problems(*rules),
        "provenance": provenance(source_id=source, video_key=F.col("key"), dimension=F.col("dimension"), answer_index_base="letter-and-text"),
    })


# tasks in files of their own -----------------------------------------------------------------------------------------

TASKS_SHAPE = "question_id string, video string, question string, candidates array<string>, answer string, start double, end double, accurate_start double, accurate_end double, video_length double"
#: Task to (information family, depth) (fixed values).
TASKS = {
    "action_antonym": ("local_motion", 1), "action_count": ("metric_temporal", 1), "action_localization": ("metric_temporal", 1), "action_sequence": ("temporal_order", 2), "egocentric_sequence": ("temporal_order", 2),
    "moving_direction": ("local_motion", 1), "object_count": ("binding_tracking", 1), "object_shuffle": ("binding_tracking", 2), "scene_transition": ("temporal_order", 1), "unexpected_action": ("metric_temporal", 2),
}


def task_questions(rows: DataFrame, root: str, split: str, dataset: str = "tvbench") -> DataFrame:
    """rows with a column `task`: the union of the task files. Two tasks need an interval, the accurate one first where there is one."""
    span = lambda a, b: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.struct(F.col(a).alias("start"), F.col(b).alias("end")))
    interval = F.when(F.col("task") == "action_localization", F.coalesce(span("accurate_start", "accurate_end"), span("start", "end"))).when(F.col("task") == "action_sequence", span("start", "end"))
    out = rows.withColumn("span", interval).withColumn("choices", F.transform("candidates", lambda t: F.trim(t))).withColumn("__i", F.row_number().over(Window.partitionBy("task").orderBy("question_id", "video", "question")) - 1)
    needs = F.col("task").isin("action_localization", "action_sequence")
    source = X.id_component(F.col("question_id"), F.concat(F.lit("row:"), F.col("__i").cast("string")))
    answer = text_answer(F.col("answer"), F.col("choices"))
    pick = lambda k: F.try_element_at(F.create_map(*(F.lit(x) for t, v in TASKS.items() for x in (t, v[k]))), F.col("task"))
    wrong = _problems(
        (~F.col("task").isin(*TASKS), "task"), (missing(F.col("video")), "video"), (missing(F.col("question")), "question"), *candidate_issues(F.col("choices")), (answer.isNull(), "answer"),
        (needs & F.col("span").isNull(), "no interval"), (F.col("span").isNotNull() & ((F.col("span.start") < 0) | (F.col("span.end") <= F.col("span.start"))), "an invalid interval"),
    )
    evidence = F.when(F.col("span").isNotNull(), F.array(F.struct(F.col("span.start").alias("start"), F.col("span.end").alias("end"), F.lit("seconds").alias("unit"), F.lit("dataset_temporal_annotation").alias("role"), F.lit(None).cast("string").alias("event_id"))))
    return R.record(out, {
        "id": R.stable_id(dataset, R.json_text(F.col("task")), R.json_text(source), R.json_text(F.col("video")), R.json_text(F.trim("question"))), "source": "TVBench", "benchmark": F.concat(F.lit(f"{dataset}:"), F.col("task")), "media_path": media_path(root, F.concat_ws("/", F.col("task"), F.col("video"))),
        "question": F.col("question"), "choices": F.col("choices"), "answer": answer, "dataset": dataset, "split": split, "information_family": pick(0), "question_family": F.concat(F.lit(f"{dataset}:"), F.col("task")), "reasoning_depth": F.coalesce(pick(1), F.lit(0)),
        "resampling_unit_id": F.concat(F.lit(f"{dataset}:video:"), F.col("video")), "evidence_spans": evidence, "problems": wrong, "provenance": provenance(source_id=F.concat_ws(":", F.col("task"), source), raw_video=F.col("video"), source_split="train", answer_index_base="text"),
    })


# videos with tracks, actions and sounds ------------------------------------------------------------------------------

_SEGMENT = "struct<id:string,label:string,timestamps:array<double>,frame_ids:array<int>,parent_objects:array<int>>"
TRACKED_SHAPE = (
    "struct<metadata:struct<video_id:string,frame_rate:double,num_frames:int,split:string>,mc_question:array<struct<id:int,question:string,options:array<string>,answer_id:int,area:string,reasoning:string,tag:array<string>>>,"
    "object_tracking:array<struct<id:int,label:string,bounding_boxes:array<array<double>>,initial_tracking_box:array<int>,frame_ids:array<int>,timestamps:array<double>,is_masked:array<int>>>,"
    f"action_localisation:array<{_SEGMENT}>,sound_localisation:array<{_SEGMENT}>>"
)


def track_issue(t: Column) -> Column:
    """What is wrong with a track: null if nothing."""
    sizes = F.array(*(F.size(t[k]) for k in ("bounding_boxes", "initial_tracking_box", "frame_ids", "timestamps", "is_masked")))
    box = lambda b: (F.size(b) == 4) & (F.get(b, 0) >= 0) & (F.get(b, 0) <= F.get(b, 2)) & (F.get(b, 2) <= 1) & (F.get(b, 1) >= 0) & (F.get(b, 1) <= F.get(b, 3)) & (F.get(b, 3) <= 1)
    return (
        F.when(missing(t["label"]), "label").when((F.size(F.array_distinct(sizes)) != 1) | (F.get(sizes, 0) < 1), "arrays of different length").when(~X.strictly_increasing(t["frame_ids"]) | ~X.strictly_increasing(t["timestamps"]), "not strictly increasing")
        .when(F.exists(t["bounding_boxes"], lambda b: ~F.coalesce(box(b), F.lit(False))), "boxes must be normalised")
    )


def segment_issue(s: Column, objects: Column) -> Column:
    a, b, f, g = F.get(s["timestamps"], 0), F.get(s["timestamps"], 1), F.get(s["frame_ids"], 0), F.get(s["frame_ids"], 1)
    return (
        F.when(missing(s["label"]), "label").when((F.size(s["timestamps"]) != 2) | (F.size(s["frame_ids"]) != 2), "start and end are needed").when((f < 0) | (g < f), "an invalid frame interval").when((a < 0) | (b <= a), "an invalid time interval")
        .when(F.exists(F.coalesce(s["parent_objects"], F.array().cast("array<int>")), lambda i: (i != -1) & ~F.array_contains(objects, i)), "an unknown object")
    )


def topic_family(area: Column, reasoning: Column, tags: Column) -> Column:
    """The information family of a question by keywords of its area, reasoning and tags, in this order."""
    text = F.lower(F.concat_ws(" ", area, reasoning, F.array_join(tags, " ")))
    has = lambda *words: X.any_of(*(text.contains(w) for w in words))
    return (
        F.when(F.lower(reasoning).isin("explanatory", "predictive", "counterfactual") | has("physics"), "causal_compositional").when(has("memory", "track", "occlusion", "object permanence"), "binding_tracking").when(has("duration", "count", "speed", "frequency"), "metric_temporal")
        .when(has("before", "after", "order", "sequence", "temporal"), "temporal_order").when(has("motion", "direction", "action recognition"), "local_motion").otherwise("static")
    )


def reasoning_depth(reasoning: Column) -> Column:
    r = F.lower(reasoning)
    return F.when(r == "descriptive", 0).when(r.isin("explanatory", "predictive"), 2).when(r == "counterfactual", 3).otherwise(1)


def track_oracles(video: Column, cut: Column, audio: bool = False) -> Column:
    """Facts of what is visible before the cut frame: objects, their tracks, and segments that end before it."""
    empty = F.array()
    seen = F.filter(F.coalesce(video["object_tracking"], empty), lambda t: cut.isNull() | F.exists(t["frame_ids"], lambda f: f < cut))
    label = lambda t: F.trim(t["label"])
    static = F.transform(seen, lambda t: R.fact(F.concat(F.lit("Entity "), t["id"].cast("string"), F.lit(" is a "), label(t), F.lit("."))))
    tracks = F.transform(seen, lambda t: R.fact(F.concat(F.lit("Entity "), t["id"].cast("string"), F.lit(" ("), label(t), F.lit(") is one persistent object track."))))
    shown = lambda segments: F.filter(F.coalesce(segments, empty), lambda s: cut.isNull() | (F.get(s["frame_ids"], 1) < cut))
    actions = shown(video["action_localisation"])
    plain = F.transform(actions, lambda s: R.fact(label(s), event_id=s["id"]))
    timed = F.transform(F.array_sort(F.transform(actions, lambda s: F.struct(F.get(s["timestamps"], 0).alias("a"), F.get(s["timestamps"], 1).alias("b"), R.fact(label(s), event_id=s["id"], start_sec=F.get(s["timestamps"], 0) / 1e6, end_sec=F.get(s["timestamps"], 1) / 1e6).alias("f")))), lambda x: x["f"])
    if audio:
        plain = F.concat(plain, F.transform(shown(video["sound_localisation"]), lambda s: R.fact(s["label"], event_id=s["id"])))
    return R.oracles(static_facts=static, relations=tracks, unordered_events=plain, ordered_events=timed)


def tracked_videos(videos: DataFrame, cuts: DataFrame | None, root: str, split: str, audio: bool = False, allow_uncut: bool = False, dataset: str = "perception_test") -> DataFrame:
    """videos: (key, value TRACKED_SHAPE); cuts: (key, value) first hidden frame, -1 for none. Training and validation questions need one."""
    rows = videos.withColumnsRenamed({"key": "video", "value": "v"})
    rows = rows.join(cuts.select(F.col("key").alias("video"), F.col("value").cast("int").alias("cut")), "video", "left") if cuts is not None else rows.withColumn("cut", F.lit(None).cast("int"))
    m = F.col("v.metadata")
    own_split = F.coalesce(m["split"], F.lit(split))
    guarded = own_split.isin("train", "valid", "validation")
    cut = F.when(guarded & (F.col("cut") != -1), F.col("cut"))
    objects = F.transform(F.coalesce(F.col("v.object_tracking"), F.array()), lambda t: t["id"])
    segments = lambda k: F.exists(F.coalesce(F.col(f"v.{k}"), F.array()), lambda s: segment_issue(s, objects).isNotNull())
    video_rules = [
        (m["video_id"] != F.col("video"), "video_id differs from its key"), (m["frame_rate"].isNull() | F.isnan(m["frame_rate"]), "frame_rate"), (~(m["num_frames"] > 0), "num_frames"), (guarded & F.col("cut").isNull() & F.lit(not allow_uncut), "no cut frame: later frames give the answer away"),
        (guarded & (F.coalesce(F.col("cut"), F.lit(-1)) != -1) & ~F.col("cut").between(1, m["num_frames"]), "an invalid cut frame"), (F.size(F.array_distinct(objects)) != F.size(objects), "duplicate object id"),
        (F.exists(F.coalesce(F.col("v.object_tracking"), F.array()), lambda t: track_issue(t).isNotNull()), "a faulty track"), (segments("action_localisation"), "a faulty action"), (segments("sound_localisation"), "a faulty sound"),
    ]
    rows = rows.withColumns({"clip_end": cut, "oracles": track_oracles(F.col("v"), cut, audio), "video_problems": _problems(*video_rules)})
    rows = rows.select("*", F.explode("v.mc_question").alias("q")).withColumn("choices", F.transform("q.options", lambda t: F.trim(t)))
    answer = X.integer_answer(F.col("q.answer_id"), F.col("choices"), 0)
    area, reasoning = F.trim("q.area"), F.trim("q.reasoning")
    rules = [(F.col("q.id").isNull(), "id"), *candidate_issues(F.col("choices")), (answer.isNull(), "answer_id"), (missing(area), "area"), (missing(reasoning), "reasoning"), (missing(F.col("q.question")), "question")]
    source = F.concat(F.col("video"), F.lit(":mc_question:"), F.col("q.id").cast("string"))
    clip = F.when(F.col("clip_end").isNotNull(), F.struct(F.lit("frames").alias("unit"), F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("end"), F.lit(0).alias("start_frame"), F.col("clip_end").alias("end_frame_exclusive"), F.col("v.metadata.num_frames").alias("expected_total_frames")))
    return R.record(rows, {
        "id": R.stable_id(dataset, R.json_text(source)), "source": "Perception Test", "benchmark": f"{dataset}:mcq", "media_path": media_path(root, F.concat(F.col("video"), F.lit(".mp4"))), "question": F.col("q.question"), "choices": F.col("choices"), "answer": answer, "dataset": dataset, "split": split,
        "information_family": topic_family(area, reasoning, F.coalesce(F.col("q.tag"), F.array().cast(NONE))), "question_family": F.concat_ws(":", F.lit(dataset), F.lower(area), F.lower(reasoning)), "reasoning_depth": reasoning_depth(reasoning), "resampling_unit_id": F.concat(F.lit(f"{dataset}:video:"), F.col("video")),
        "media_clip": clip, "oracles": F.col("oracles"), "problems": F.concat(F.col("video_problems"), _problems(*rules)),
        "provenance": provenance(source_id=source, video_id=F.col("video"), source_cut_frame=F.col("cut"), source_split=F.col("v.metadata.split"), area=area, reasoning=reasoning, tags=F.array_join("q.tag", ","), timestamps_unit="microseconds", answer_index_base="0"),
    })


# what all connectors share -------------------------------------------------------------------------------------------

EXCLUSION = "dataset string, source_id string, reason string"


def exclusion_issues(exclusions: DataFrame) -> DataFrame:
    """Faulty entries: kind, dataset, source_id."""
    blank = exclusions.where(F.greatest(*(missing(F.col(c)).cast("int") for c in ("dataset", "source_id", "reason"))) == 1).select(F.lit("blank").alias("kind"), "dataset", "source_id")
    twice = exclusions.groupBy("dataset", "source_id").count().where("count > 1").select(F.lit("duplicate").alias("kind"), "dataset", "source_id")
    return blank.unionByName(twice)


def excluded(records: DataFrame, exclusions: DataFrame, dataset: str) -> tuple[DataFrame, DataFrame]:
    """(records without excluded ones, issues): every entry of the dataset must match exactly one record, and a question or
    pair goes as a whole."""
    own = exclusions.where(F.col("dataset") == dataset).select(F.trim("source_id").alias("__s"))
    source = F.try_element_at(F.col("diagnostic.provenance"), F.lit("source_id"))
    matches = own.join(records.select(source.alias("__r")), F.col("__s") == F.col("__r"), "left").groupBy("__s").agg(F.count("__r").alias("n"))
    issues = matches.where("n <> 1").select(F.when(F.col("n") == 0, "unused").otherwise("ambiguous").alias("kind"), F.lit(dataset).alias("dataset"), F.col("__s").alias("source_id"))
    marked = records.join(own.withColumn("__x", F.lit(1)), source == F.col("__s"), "left")
    d = F.col("diagnostic")
    unit = F.coalesce(d["independent_unit_id"], F.when(d["pair_role"] != "standalone", d["pair_id"]))
    torn = marked.where(unit.isNotNull()).groupBy(unit.alias("source_id")).agg(F.count("*").alias("n"), F.count("__x").alias("x")).where("x > 0 AND x < n").select(F.lit("not closed").alias("kind"), F.lit(dataset).alias("dataset"), "source_id")
    return marked.where("__x IS NULL").drop("__x", "__s"), issues.unionByName(torn)


def loaded(records: DataFrame) -> DataFrame:
    """Records without their column `problems`; reading a record that has one fails with it."""
    first = F.concat_ws(": ", F.lit("record"), F.coalesce(F.col("id"), F.lit("?")), F.array_join("problems", ", "))
    return records.withColumn("id", F.when(F.size("problems") > 0, F.raise_error(first).cast("string")).otherwise(F.col("id"))).drop("problems")


def duplicate_ids(records: DataFrame) -> DataFrame:
    return records.groupBy("id").count().where("count > 1").select("id")


def resolved(records: DataFrame, files: DataFrame, required: bool = True) -> DataFrame:
    """Records with the one file that their media path names: by path, else by file name. files: (path).

    Adds to `problems` where none or, by name, several files fit.
    """
    exact = files.select(F.col("path").alias("__p")).distinct()
    named = files.groupBy(F.element_at(F.split("path", "/"), -1).alias("__b")).agg(F.min("path").alias("__f"), F.count_distinct("path").alias("__n"))
    rows = records.withColumn("__base", F.element_at(F.split("media_path", "/"), -1)).join(exact, F.col("media_path") == F.col("__p"), "left").join(named, F.col("__base") == F.col("__b"), "left")
    found = F.coalesce(F.col("__p"), F.when(F.col("__n") == 1, F.col("__f")))
    more = _problems((found.isNull() & (F.coalesce(F.col("__n"), F.lit(0)) > 1), "ambiguous media"), (found.isNull() & F.col("__n").isNull() & F.lit(required), "media not found"))
    return rows.withColumn("problems", F.concat("problems", more)).withColumn("media_path", F.coalesce(found, F.col("media_path"))).drop("__base", "__p", "__b", "__f", "__n")


def coverage(records: DataFrame) -> DataFrame:
    """Rows, rows with evidence and rows with a safe fact by dataset, split, information family and question family."""
    d = F.col("diagnostic")
    safe = sum((F.size(R.safe_facts(d["oracles"][f])) for f in [*R.FACT_FIELDS, "operator"]), F.lit(0)) > 0
    return records.groupBy(*(d[k].alias(k) for k in ("dataset", "split", "information_family", "question_family"))).agg(F.count("*").alias("rows"), F.count_if(F.size(d["evidence_spans"]) > 0).alias("with_evidence"), F.count_if(safe).alias("with_safe_facts"))


def eligibility_issues(limited: bool, require_media: bool, **escapes: bool) -> list[str]:
    """Why a run may not enter a confirmatory release."""
    return [*(["limited"] if limited else []), *([] if require_media else ["media not required"]), *sorted(k for k, v in escapes.items() if v)]


#: Connector by dataset; aliases as people write them.
CONNECTORS = {"clevrer": scene_questions, "egoschema": option_questions, "mvp": paired_videos, "next_gqa": grounded_questions, "perception_test": tracked_videos, "tempcompass": reversed_videos, "tvbench": task_questions}
ALIASES = {"perception-test": "perception_test", "next-gqa": "next_gqa", "nextgqa": "next_gqa", "ego_schema": "egoschema"}


def connector(name: str):
    key = name.strip().lower()
    found = CONNECTORS.get(ALIASES.get(key, key))
    if found is None:
        raise ValueError(f"unknown connector {name!r}; there are {', '.join(sorted(CONNECTORS))}")
    return found
