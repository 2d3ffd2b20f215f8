"""The shape of diagnostic base records: types, defaults, and expressions that read or build them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fields as X
from . import text as T
from .digests import quoted
from .scores import missing

SCHEMA_VERSION = "1.1"
#: Fixed values of the record schema.
FACT_FIELDS = ["static_facts", "unordered_events", "ordered_events", "temporal_relations", "state_changes", "relations", "intermediate"]
FAMILIES = ["static", "local_motion", "temporal_order", "metric_temporal", "binding_tracking", "causal_compositional", "long_range_selection"]
ROLES = ["standalone", "original", "counterfactual", "nuisance"]
UNITS = ["seconds", "normalized"]
SAFE_ACCESS = ["safe_visual_gt", "operator_only"]
UNSAFE_ACCESS = ["target", "target_semantic", "answer", "answer_key"]
LINEAGE = ["official_adapter", "audited_human_annotation", "audited_simulator_gt"]

SPAN = "struct<start:double,end:double,unit:string,role:string,event_id:string>"
#: payload: the fact's own fields as JSON, for equality and for hashes.
FACT = "struct<text:string,fact_id:string,event_id:string,subject:string,predicate:string,object:string,start_sec:double,end_sec:double,frame:double,access:string,source:string,lineage:string,payload:string>"
CLIP = "struct<unit:string,start:double,end:double,start_frame:int,end_frame_exclusive:int,expected_total_frames:int>"
ORACLES = "struct<" + ",".join(f"{f}:array<{FACT}>" for f in [*FACT_FIELDS, "operator"]) + ",answer_derived:boolean>"
DIAGNOSTIC = (
    "struct<schema_version:string,dataset:string,split:string,information_family:string,question_family:string,reasoning_depth:int,resampling_unit_id:string,pair_id:string,pair_role:string,"
    f"independent_unit_id:string,official_candidate_id:string,official_candidate_count:int,adapter_run_id:string,evidence_spans:array<{SPAN}>,media_clip:{CLIP},oracles:{ORACLES},provenance:map<string,string>>"
)
RECORD = f"id string, source string, benchmark string, task string, media_type string, media_path string, question string, choices array<string>, answer string, diagnostic {DIAGNOSTIC}"
METADATA = ["dataset", "split", "information_family", "question_family", "reasoning_depth", "resampling_unit_id", "pair_id", "pair_role", "independent_unit_id", "official_candidate_id", "official_candidate_count"]
NO_FACTS = f"array<{FACT}>"


def stable_id(dataset: str, *parts: Column) -> Column:
    """<dataset>:<20 hex digits of the SHA-256 of the JSON array of dataset and parts>; numbers unquoted, texts as JSON."""
    shown = [F.lit(f'"{dataset}"'), *parts]
    return F.concat(F.lit(f"{dataset}:"), F.substring(F.sha2(F.concat(F.lit("["), F.concat_ws(",", *shown), F.lit("]")), 256), 1, 20))


def json_text(c: Column) -> Column:
    return quoted(c)


def fact(text: Column, access: str = "safe_visual_gt", source: str = "official_adapter_annotation", lineage: str = "official_adapter", **more: Column) -> Column:
    """A fact with its defaults; further fields by name, payload the JSON of what it says apart from time."""
    said = {"text": text, **more}
    own = {k: said.get(k, F.lit(None)) for k in ("text", "fact_id", "event_id", "subject", "predicate", "object", "start_sec", "end_sec", "frame")}
    lasting = [c.cast("string").alias(k) for k, c in own.items() if k not in ("start_sec", "end_sec", "frame")]
    return F.struct(*(c.alias(k) for k, c in own.items()), F.lit(access).alias("access"), F.lit(source).alias("source"), F.lit(lineage).alias("lineage"), F.to_json(F.struct(*lasting)).alias("payload")).cast(FACT)


def oracles(**given: Column) -> Column:
    """All fact fields, empty where not given, and the literal that nothing is derived from the answer."""
    filled = [F.coalesce(given[f], F.array()).cast(NO_FACTS).alias(f) if f in given else F.array().cast(NO_FACTS).alias(f) for f in FACT_FIELDS]
    operator = given.get("operator", F.lit(None)).cast(NO_FACTS).alias("operator")
    return F.struct(*filled, operator, F.lit(False).alias("answer_derived")).cast(ORACLES)


def merged_facts(facts: Column, field: str) -> Column:
    """Facts with defaults for access, source and lineage."""
    fill = {"access": "operator_only" if field == "operator" else "safe_visual_gt", "source": "official_adapter_annotation", "lineage": "official_adapter"}
    names = [p.split(":")[0] for p in FACT[len("struct<"):-1].split(",")]
    return F.transform(facts, lambda f: F.struct(*(F.coalesce(f[n], F.lit(fill[n])).alias(n) if n in fill else f[n].alias(n) for n in names)))


def record(rows: DataFrame, values: dict[str, Column | str | int]) -> DataFrame:
    """rows -> base records. values: id, source, benchmark, media_path, question, choices, answer, dataset, split,
    information_family, question_family, reasoning_depth, resampling_unit_id, provenance, and what else applies."""
    # values first, under names of their own: in one select a name inside a lambda may mean another value of it
    rows = rows.select(*((c if isinstance(c, Column) else F.lit(c)).alias(f"__{k}") for k, c in values.items()))
    v = {k: F.col(f"__{k}") for k in values}
    get = lambda k, kind: v.get(k, F.lit(None)).cast(kind)
    diagnostic = F.struct(
        F.lit(SCHEMA_VERSION).alias("schema_version"), *(v[k].alias(k) for k in ("dataset", "split", "information_family", "question_family")), v["reasoning_depth"].cast("int").alias("reasoning_depth"), v["resampling_unit_id"].alias("resampling_unit_id"),
        F.coalesce(get("pair_id", "string"), F.concat(F.lit("standalone:"), v["id"])).alias("pair_id"), F.coalesce(get("pair_role", "string"), F.lit("standalone")).alias("pair_role"),
        get("independent_unit_id", "string").alias("independent_unit_id"), get("official_candidate_id", "string").alias("official_candidate_id"), get("official_candidate_count", "int").alias("official_candidate_count"), get("adapter_run_id", "string").alias("adapter_run_id"),
        F.coalesce(get("evidence_spans", f"array<{SPAN}>"), F.array().cast(f"array<{SPAN}>")).alias("evidence_spans"), get("media_clip", CLIP).alias("media_clip"), (v["oracles"] if "oracles" in v else oracles()).alias("oracles"), v["provenance"].cast("map<string,string>").alias("provenance"),
    )
    return rows.select(
        v["id"].alias("id"), v["source"].alias("source"), v["benchmark"].alias("benchmark"), v.get("task", F.lit("mcq")).alias("task"), F.lit("video").alias("media_type"), v["media_path"].alias("media_path"),
        F.trim(v["question"]).alias("question"), v["choices"].cast("array<string>").alias("choices"), v["answer"].alias("answer"), diagnostic.cast(DIAGNOSTIC).alias("diagnostic"), *([v["problems"].alias("problems")] if "problems" in v else []),
    )


def metadata(record: str = "diagnostic") -> list[Column]:
    return [F.col(f"{record}.{k}").alias(k) for k in METADATA]


def first_of(rows: DataFrame, *paths: str) -> Column:
    """The first of dotted paths that rows have and that is neither null nor blank."""
    found = []
    for path in paths:
        kind = rows.schema
        for part in path.split("."):
            names = getattr(kind, "names", [])
            if part not in names:
                kind = None
                break
            kind = kind[part].dataType
        if kind is not None:
            found.append(F.col(path).cast("string"))
    return X.present(*found) if found else F.lit(None).cast("string")


def visual_source(diagnostic: str = "diagnostic", record_id: Column | None = None, benchmark: Column | None = None) -> Column:
    """struct(dataset, field, value): the first provenance key that names the source of a record's pixels, else its id."""
    keys = ["source_video_id", "raw_video_id", "video_id", "video_key", "scene_index", "raw_video", "q_uid", "source_id"]
    p = F.col(f"{diagnostic}.provenance")
    value = lambda k: F.try_element_at(p, F.lit(k))
    filled = lambda k: value(k).isNotNull() & (value(k) != "")
    field, found = F.lit("base_id"), record_id if record_id is not None else F.col("id")
    for k in reversed(keys):
        field, found = F.when(filled(k), k).otherwise(field), F.when(filled(k), value(k)).otherwise(found)
    dataset = F.coalesce(F.col(f"{diagnostic}.dataset"), benchmark if benchmark is not None else F.lit(None), F.lit("unknown"))
    return F.struct(dataset.alias("dataset"), field.alias("field"), found.alias("value"))


def portable(provenance: Column) -> Column:
    """Provenance without fields that name places on one machine."""
    return F.map_filter(provenance, lambda k, v: ~F.lower(k).rlike(r"^raw_location$|(^|_)(path|paths|file|files|root|dir|directory|directories)$"))


def safe_facts(facts: Column) -> Column:
    """Facts that may enter a clue: safe access, known lineage, a named source."""
    norm = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.filter(F.coalesce(facts, F.array().cast(NO_FACTS)), lambda f: norm(f["access"]).isin(*SAFE_ACCESS) & norm(f["lineage"]).isin(*LINEAGE) & (F.trim(F.coalesce(f["source"], F.lit(""))) != ""))


def fact_text(f: Column, field: str) -> Column:
    """A fact as a sentence: its text, else its parts; ordered events lead with their time or frame."""
    parts = F.concat_ws(" ", *(F.when(F.trim(F.coalesce(f[k], F.lit(""))) != "", F.trim(f[k])) for k in ("subject", "predicate", "object")))
    said = F.coalesce(F.when(~missing(f["text"]), X.collapsed(f["text"])), F.when(parts != "", parts), f["payload"])
    if field != "ordered_events":
        return said
    start, end = T.time_text(f["start_sec"]), T.time_text(f["end_sec"])
    at = F.when(start.isNotNull(), F.concat(F.lit("[t="), start, F.when(end.isNotNull(), F.concat(F.lit("-"), end)).otherwise(""), F.lit("s] ")))
    return F.concat(F.coalesce(at, F.when(f["frame"].isNotNull(), F.concat(F.lit("[frame="), F.format_string("%.0f", f["frame"]), F.lit("] "))), F.lit("")), said)


def timestamp_sham(f: Column, atomic: Column) -> Column:
    """The form of a timed event without its time."""
    timed = F.when(f["end_sec"].isNull(), "[t=000.000s] ").otherwise("[t=000.000-000.000s] ")
    return F.concat(F.when(f["start_sec"].isNotNull(), timed).when(f["frame"].isNotNull(), "[frame=000000] ").otherwise(""), atomic)


def event_order(f: Column, otherwise: Column) -> Column:
    """Timed events first, by start or frame, then by a rank that says nothing about time."""
    at = F.coalesce(f["start_sec"], f["frame"])
    return F.struct(at.isNull().alias("untimed"), F.coalesce(at, F.lit(0.0)).alias("at"), otherwise.alias("rank"))


def event_id(f: Column) -> Column:
    return X.present(f["fact_id"], f["event_id"])


def program_text(question_program: Column, choice_program: Column, composition: Column) -> Column:
    """An operator fact as text: the candidate's and the question's steps, and how they compose."""
    steps = lambda p: F.when(F.size(p) > 0, F.array_join(F.transform(p, lambda s: X.collapsed(F.replace(s, F.lit("_"), F.lit(" ")))), " -> "))
    said = F.concat_ws("; ", F.concat(F.lit("candidate program: "), steps(choice_program)), F.concat(F.lit("question program: "), steps(question_program)))
    whole = F.concat_ws("; ", said, F.when(~missing(composition), F.concat(F.lit("composition rule: "), X.collapsed(composition))))
    return F.when(said != "", whole)
