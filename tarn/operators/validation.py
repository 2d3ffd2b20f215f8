"""Validation of base records: every issue of every record, and of the manifest as a whole, as rows (level, path, message, record_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fields as X
from ..functions import records as R
from ..functions import text as T
from ..functions.scores import missing

ISSUE = "struct<level:string,path:string,message:string>"


def issue(path: Column | str, message: str, level: str = "error") -> Column:
    return F.struct(F.lit(level).alias("level"), (path if isinstance(path, Column) else F.lit(path)).alias("path"), F.lit(message).alias("message")).cast(ISSUE)


def _when(*rules: tuple[Column, Column | str, str]) -> Column:
    return F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(True)), issue(path, message)) for test, path, message in rules)))


def _each(items: Column, rules) -> Column:
    """Issues of every element: rules(element, place) gives (test, path, message) triples."""
    return F.flatten(F.transform(F.coalesce(items, F.array()), lambda x, i: _when(*rules(x, i))))


def _at(prefix: str, i: Column, suffix: str = "") -> Column:
    return F.concat(F.lit(f"{prefix}["), i.cast("string"), F.lit(f"]{suffix}"))


def span_issues(spans: Column) -> Column:
    p = "diagnostic.evidence_spans"
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    def rules(s: Column, i: Column):
        sound = finite(s["start"]) & finite(s["end"])
        return [
            (~sound, _at(p, i), "span bounds must be finite"), (sound & (s["start"] < 0), _at(p, i, ".start"), "must be >= 0"), (sound & (s["end"] <= s["start"]), _at(p, i, ".end"), "must be greater than start"),
            (sound & ~F.coalesce(s["unit"], F.lit("seconds")).isin(*R.UNITS), _at(p, i, ".unit"), "must be seconds or normalized"),
            (sound & (F.coalesce(s["unit"], F.lit("seconds")) == "normalized") & (s["end"] > 1), _at(p, i, ".end"), "normalized bounds must be <= 1"),
        ]

    return _each(spans, rules)


def oracle_issues(oracles: Column) -> Column:
    """Access, source and lineage of every fact, missing lists, and the answer_derived literal."""
    def rules(field: str):
        p = f"diagnostic.oracles.{field}"

        def of(f: Column, i: Column):
            access = F.coalesce(f["access"], F.lit(""))
            return [
                (~access.isin(*R.SAFE_ACCESS, *R.UNSAFE_ACCESS), _at(p, i, ".access"), "must be a known access"),
                (access != "operator_only" if field == "operator" else access == "operator_only", _at(p, i, ".access"), "operator_only is the access of operator facts, and of them alone"),
                *((missing(f[k]), _at(p, i, f".{k}"), "must be a non-empty string") for k in ("source", "lineage")),
                (f["lineage"].isNotNull() & ~f["lineage"].isin(*R.LINEAGE), _at(p, i, ".lineage"), "must be a known lineage"),
            ]

        return of

    lists = [_when((oracles[f].isNull(), f"diagnostic.oracles.{f}", "must be a list")) for f in R.FACT_FIELDS]
    facts = [_each(oracles[f], rules(f)) for f in [*R.FACT_FIELDS, "operator"]]
    derived = _when((~F.coalesce(~oracles["answer_derived"], F.lit(False)), "diagnostic.oracles.answer_derived", "must be explicitly present and false"))
    return F.concat(*lists, *facts, derived)


def clip_issues(clip: Column) -> Column:
    unit = F.coalesce(clip["unit"], F.lit("seconds"))
    start, first = F.coalesce(clip["start"], F.lit(0.0)), F.coalesce(clip["start_frame"], F.lit(0))
    seconds = clip["end"].isNull() | F.isnan(clip["end"]) | F.isnan(start) | (start < 0) | (clip["end"] <= start)
    last, total = clip["end_frame_exclusive"], clip["expected_total_frames"]
    frames = last.isNull() | total.isNull() | (first < 0) | (last <= first) | (total < last)
    bad = F.when(unit == "seconds", seconds).when(unit == "frames", frames).otherwise(True)
    return F.when(clip.isNull(), F.array().cast(f"array<{ISSUE}>")).otherwise(_when((bad, "diagnostic.media_clip", "invalid media clip")))


def record_issues(strict: bool = True) -> Column:
    """All issues of a record (columns as functions.records.RECORD): an array."""
    d = F.col("diagnostic")
    choices = F.coalesce(F.col("choices"), F.array().cast("array<string>"))
    shown = F.transform(choices, lambda c: F.trim(F.coalesce(c, F.lit(""))))
    sized = F.size(choices).between(2, 26)
    top = _when(
        *((missing(F.col(k)), k, "must be a non-empty string") for k in ("id", "media_type", "media_path", "question")),
        (~F.coalesce(F.col("media_type"), F.lit("")).isin("video", "image"), "media_type", "must be 'video' or 'image'"),
        (~sized, "choices", "must contain 2..26 options"),
        (sized & F.exists(shown, lambda c: c == ""), "choices", "options must be non-empty"),
        (sized & (F.size(F.array_distinct(F.transform(shown, X.folded))) != F.size(shown)), "choices", "contains duplicate normalized options"),
        (sized & T.normalized_answer(F.coalesce(F.col("answer"), F.lit("None")), shown).isNull(), "answer", "does not match exactly one option"),
    )
    run = d["adapter_run_id"]
    inner = _when(
        (F.coalesce(d["schema_version"], F.lit("")) != R.SCHEMA_VERSION, "diagnostic.schema_version", "must equal the schema version"),
        *((missing(d[k]), f"diagnostic.{k}", "must be a non-empty string") for k in ("dataset", "split", "information_family", "question_family", "pair_id", "pair_role")),
        (~F.coalesce(d["information_family"], F.lit("")).isin(*R.FAMILIES), "diagnostic.information_family", "must be a known family"),
        (~F.coalesce(d["pair_role"], F.lit("")).isin(*R.ROLES), "diagnostic.pair_role", "must be a known role"),
        (~F.coalesce(d["reasoning_depth"].between(0, 3), F.lit(False)), "diagnostic.reasoning_depth", "must be an integer in [0, 3]"),
        (missing(d["resampling_unit_id"]), "diagnostic.resampling_unit_id", "must identify the raw source video, scene, or paired-video family"),
        (d["independent_unit_id"].isNotNull() & missing(d["independent_unit_id"]), "diagnostic.independent_unit_id", "must be a non-empty string when provided"),
        (run.isNotNull() & ~F.lower(run).rlike("^adapter-run::[0-9a-f]{64}$"), "diagnostic.adapter_run_id", "must be adapter-run::<64 hexadecimal SHA256> when provided"),
        (d["official_candidate_id"].isNotNull() & missing(d["official_candidate_id"]), "diagnostic.official_candidate_id", "must be a non-empty string when supplied"),
        (F.coalesce(d["official_candidate_count"], F.lit(1)) < 1, "diagnostic.official_candidate_count", "must be a positive integer when supplied"),
        (d["official_candidate_id"].isNull() != d["official_candidate_count"].isNull(), "diagnostic.official_candidate_id", "official candidate ID and count must be supplied together"),
        (d["provenance"].isNull(), "diagnostic.provenance", "must be an object"),
        (d["provenance"].isNotNull() & missing(F.try_element_at(d["provenance"], F.lit("source_id"))), "diagnostic.provenance.source_id", "must identify the raw annotation"),
    )
    level = "error" if strict else "warning"
    deep = F.concat(inner, span_issues(d["evidence_spans"]), oracle_issues(d["oracles"]), clip_issues(d["media_clip"]))
    return F.concat(top, F.when(d.isNull(), F.array(issue("diagnostic", "must be an object", level))).otherwise(deep))


def record_report(records: DataFrame, strict: bool = True) -> DataFrame:
    """One row an issue: record_id, level, path, message."""
    return records.select(F.col("id").alias("record_id"), F.explode(record_issues(strict)).alias("i")).select("record_id", "i.*")


def has_errors(issues: Column) -> Column:
    return F.exists(issues, lambda i: i["level"] == "error")


def _crossing(rows: DataFrame, unit: Column, path: str, message: str) -> DataFrame:
    """Units that live in several splits."""
    split = F.col("diagnostic.split")
    found = rows.where(unit.isNotNull() & (split != "")).groupBy(unit.alias("record_id")).agg(F.min("diagnostic.split").alias("a"), F.max("diagnostic.split").alias("b")).where("a <> b")
    return found.select("record_id", F.lit("error").alias("level"), F.lit(path).alias("path"), F.lit(message).alias("message"))


def manifest_issues(records: DataFrame) -> DataFrame:
    """Issues between records: repeated ids, units and media that cross splits, torn units, faulty pair families."""
    d = F.col("diagnostic")
    namespace = F.coalesce(d["dataset"], F.col("benchmark"), F.lit("unknown"))
    named = lambda c: F.when(c.isNotNull() & (c != ""), F.concat(namespace, F.lit("::"), c))
    p = d["provenance"]
    video = F.coalesce(*(F.when(F.try_element_at(p, F.lit(k)) != "", F.try_element_at(p, F.lit(k))) for k in ("source_video_id", "raw_video_id", "video_id")))
    error = lambda path, message: (F.lit("error").alias("level"), F.lit(path).alias("path"), F.lit(message).alias("message"))
    repeated = records.where("id <> ''").groupBy(F.col("id").alias("record_id")).count().where("count > 1").select("record_id", *error("id", "duplicate id"))
    torn = records.where(named(d["independent_unit_id"]).isNotNull() & (d["resampling_unit_id"] != "")).groupBy(named(d["independent_unit_id"]).alias("record_id")).agg(F.min("diagnostic.resampling_unit_id").alias("a"), F.max("diagnostic.resampling_unit_id").alias("b")).where("a <> b").select(
        "record_id", *error("diagnostic.resampling_unit_id", "one official aggregation unit maps to multiple resampling families"))
    out = repeated.unionByName(torn)
    for unit, path, message in (
        (F.when(F.col("media_path") != "", F.col("media_path")), "diagnostic.split", "same media appears in multiple splits"),
        (named(video), "diagnostic.provenance.source_video_id", "source video appears in multiple splits"),
        (named(d["independent_unit_id"]), "diagnostic.independent_unit_id", "independent analysis unit crosses splits"),
        (named(d["resampling_unit_id"]), "diagnostic.resampling_unit_id", "resampling family crosses splits"),
    ):
        out = out.unionByName(_crossing(records, unit, path, message))
    return out.unionByName(pair_issues(records))


def pair_issues(records: DataFrame) -> DataFrame:
    """Issues of pair families: their roles, resampling units and splits, and what a counterfactual or a nuisance must change or keep."""
    d = F.col("diagnostic")
    rows = records.where(d["pair_id"] != "").select(
        "id", d["pair_id"].alias("pair"), d["pair_role"].alias("role"), F.when(d["resampling_unit_id"] != "", d["resampling_unit_id"]).alias("unit"), F.coalesce(d["split"], F.lit("")).alias("split"),
        X.collapsed(F.col("question")).alias("question"), F.transform("choices", X.collapsed).alias("options"), T.answer_text(F.col("answer"), F.col("choices")).alias("said"),
    )
    is_original = F.col("role") == "original"
    family = rows.groupBy("pair").agg(
        F.count("*").alias("n"), F.count_if(F.col("role") == "standalone").alias("alone"), F.count_if(is_original).alias("originals"), F.count_if(F.col("role").isin("counterfactual", "nuisance")).alias("others"),
        F.min("unit").alias("u1"), F.max("unit").alias("u2"), F.min("split").alias("s1"), F.max("split").alias("s2"),
        F.first(F.when(is_original, F.struct("question", "options", "said")), True).alias("o"),
    )
    whole = _when(
        ((F.col("alone") > 0) & (F.col("n") != 1), "diagnostic.pair_id", "standalone pair has multiple rows"), (F.coalesce(F.col("u1") != F.col("u2"), F.lit(False)), "diagnostic.resampling_unit_id", "pair family maps to multiple resampling families"),
        ((F.col("others") > 0) & (F.col("originals") != 1), "diagnostic.pair_role", "paired family must contain exactly one original"), (F.col("s1") != F.col("s2"), "diagnostic.split", "pair family crosses splits"),
    )
    out = family.select(F.col("pair").alias("record_id"), F.explode(whole).alias("i")).select("record_id", "i.*")
    both = rows.where(F.col("role").isin("counterfactual", "nuisance")).join(family.where("originals = 1 AND o.said IS NOT NULL").select("pair", "o"), "pair")
    moved = F.col("role") == "counterfactual"
    warn = lambda test, path, message: F.when(F.coalesce(test, F.lit(False)), issue(path, message, "warning"))
    fail = lambda test, message: F.when(F.coalesce(test, F.lit(False)), issue("answer", message))
    each = F.array_compact(F.array(
        warn(moved & (F.col("question") != F.col("o.question")), "question", "counterfactual question differs from original"), warn(moved & (F.col("options") != F.col("o.options")), "choices", "counterfactual options differ from original"),
        fail(moved & (F.col("said") == F.col("o.said")), "counterfactual must change the semantic answer"), fail(~moved & (F.col("said") != F.col("o.said")), "nuisance variant must preserve the semantic answer"),
    ))
    return out.unionByName(both.select(F.col("id").alias("record_id"), F.explode(each).alias("i")).select("record_id", "i.*"))


def coverage(records: DataFrame) -> DataFrame:
    """field, value, rows: histograms of a manifest, its pairs, units, and evidence."""
    d = F.col("diagnostic")
    name = F.coalesce(d["dataset"], F.col("benchmark"), F.lit("unknown"))
    spans = F.coalesce(F.size(F.coalesce(d["evidence_spans"], F.array().cast(f"array<{R.SPAN}>"))), F.lit(0))
    pairs = F.array(
        F.struct(F.lit("dataset").alias("field"), name.alias("value"), F.lit(1).alias("n")), F.struct(F.lit("information_family").alias("field"), F.coalesce(d["information_family"], F.lit("unknown")).alias("value"), F.lit(1).alias("n")),
        F.struct(F.lit("answer_position").alias("field"), F.upper(F.trim("answer")).alias("value"), F.lit(1).alias("n")), F.struct(F.lit("pair_rows").alias("field"), F.when(d["pair_role"].isin("counterfactual", "nuisance"), d["pair_role"]).alias("value"), F.lit(1).alias("n")),
        F.struct(F.lit("records_with_evidence").alias("field"), F.when(spans > 0, name).alias("value"), F.lit(1).alias("n")), F.struct(F.lit("evidence_spans").alias("field"), F.when(spans > 0, name).alias("value"), spans.alias("n")),
    )
    counts = records.select(F.explode(pairs).alias("x")).where("x.value IS NOT NULL").groupBy("x.field", "x.value").agg(F.sum("x.n").alias("rows"))
    units = records.select(F.explode(F.array(*(F.struct(F.lit(k).alias("field"), F.when(d[k] != "", F.concat(name, F.lit("::"), d[k])).alias("unit")) for k in ("independent_unit_id", "resampling_unit_id")))).alias("x")).where("x.unit IS NOT NULL")
    return counts.unionByName(units.groupBy("x.field").agg(F.count_distinct("x.unit").alias("rows")).select("field", F.lit("units").alias("value"), "rows"))


def shared_identities(training: DataFrame, evaluation: DataFrame, unit: str, media_digest: str) -> DataFrame:
    """What training and evaluation rows share: kind (unit or media) and the value. There must be no row."""
    def values(rows: DataFrame) -> DataFrame:
        return rows.select(F.explode(F.array(F.struct(F.lit("unit").alias("kind"), F.trim(F.col(unit)).alias("value")), F.struct(F.lit("media").alias("kind"), F.col(media_digest).alias("value")))).alias("x")).select("x.*").where("value <> ''").distinct()

    return values(training).join(values(evaluation), ["kind", "value"], "left_semi")
