"""Verbs over files: validate, adapt, build-trials, lock-data, verify-lock, analyze, finalize-protocol.

python -m tarn.cli <verb> --help. Tables are Parquet folders, manifests JSON lines; reports are one JSON file.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import protocol as P
from .functions import records as R
from .operators import locks, preparation, reports, trials, validation
from .sources import connectors, files, sinks

SCHEMAS = {"semantic": "tarn.semantic_records.1", "media": "tarn.media_bindings.1", "units": "tarn.unit_membership.1", "release": "tarn.data_release.1", "lock": "tarn.data_lock.1"}
#: Columns of scored rows as they come from a scorer.
PREDICTIONS = (
    "id string, trial_id string, base_id string, visual_id string, dataset string, information_family string, question_family string, reasoning_depth string, resampling_unit_id string, pair_id string, pair_role string, independent_unit_id string, "
    "condition string, input_channel string, requested_dose string, effective_dose string, permutation_index string, choices array<string>, prediction string, prediction_text string, answer string, answer_text string, correct string, "
    "choice_probability map<string,double>, choice_nll map<string,double>, gold_nll double, best_distractor_nll double, gold_margin double, trial_content_sha256 string, data_release_sha256 string, trial_build_attestation_sha256 string, "
    "result_content_sha256 string, scoring_run_signature_sha256 string, scoring_global_signature_sha256 string, token_source string, original_visual_tokens int, effective_visual_tokens int, official_candidate_id string, official_candidate_count int"
)
_SCORES = ("prediction", "prediction_text", "correct", "choice_probability", "choice_nll", "gold_nll", "best_distractor_nll", "gold_margin", "result_content_sha256", "scoring_run_signature_sha256", "scoring_global_signature_sha256", "token_source", "original_visual_tokens", "effective_visual_tokens")
MANIFEST = ", ".join(c for c in PREDICTIONS.split(", ") if c.split()[0] not in _SCORES)


def records(spark: SparkSession, path: str) -> DataFrame:
    return files.jsonl(spark, path, R.RECORD)


def validate(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = records(spark, a.manifest)
    issues = validation.record_report(rows).unionByName(validation.manifest_issues(rows).select("record_id", "level", "path", "message"))
    counts = {r.level: r.n for r in issues.groupBy("level").agg(F.count("*").alias("n")).collect()}
    kinds = [r.asDict() for r in issues.groupBy("level", "path", "message").agg(F.count("*").alias("n"), F.min("record_id").alias("example")).orderBy("level", "path", "message").collect()]
    covered = [r.asDict() for r in validation.coverage(rows).orderBy("field", "value").collect()]
    sinks.json_file(a.report, {"valid": not counts.get("error"), "issue_counts": counts, "issues": kinds, "coverage": covered, "num_records": rows.count()})
    return 1 if counts.get("error") else 0


def adapt(spark: SparkSession, a: argparse.Namespace) -> int:
    """Annotations of the connectors that read one table (paired videos, tasks, scenes) to a manifest."""
    sinks.reject_aliases({"out": a.out, "report": a.report}, {"annotations": a.annotations})
    shapes = {"mvp": connectors.PAIRED_SHAPE, "tvbench": connectors.TASKS_SHAPE + ", task string", "clevrer": connectors.SCENES_SHAPE}
    found = connectors.connector(a.dataset)
    out = found(connectors.annotations(spark, a.annotations, shapes[a.dataset]), a.media_root, a.split)
    issues: list[dict] = []
    if a.exclusions:
        out, wrong = connectors.excluded(out, connectors.annotations(spark, a.exclusions, connectors.EXCLUSION), a.dataset)
        issues += [r.asDict() for r in wrong.collect()]
    issues += [{"kind": r.problem, "n": r.n} for r in out.select(F.explode("problems").alias("problem")).groupBy("problem").agg(F.count("*").alias("n")).collect()]
    sinks.json_file(a.report, {"dataset": a.dataset, "issues": issues, "eligibility_issues": connectors.eligibility_issues(False, True), "coverage": [r.asDict() for r in connectors.coverage(out).collect()]})
    if issues:
        return 1
    sinks.one_jsonl(connectors.loaded(out), a.out, ["id"])
    return 0


def build_trials(spark: SparkSession, a: argparse.Namespace) -> int:
    conditions, options = P.conditions(a.conditions)
    made, skipped = trials.expanded(records(spark, a.manifest), conditions, a.seed, a.option_permutations or options.get("option_permutations", 1))
    made.write.mode("errorifexists").parquet(a.out)
    done = spark.read.parquet(a.out)
    sinks.json_file(a.report, {"trials": done.count(), "unique_visual_inputs": done.select("visual_id").where("visual_id IS NOT NULL").distinct().count(), "skipped": [r.asDict() for r in trials.skip_report(skipped).orderBy("condition", "reason").collect()], "seed": a.seed, "conditions": [c.name for c in conditions]})
    return 0


def lock_data(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = records(spark, a.manifest)
    media = locks.media_identity(rows.select("id", "media_path"), spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(a.media_root).withColumn("path", F.regexp_replace("path", "^file:/*", "/")))
    sinks.json_file(a.out, locks.data_lock(rows, media, SCHEMAS))
    return 0


def verify_lock(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = records(spark, a.manifest)
    media = locks.media_identity(rows.select("id", "media_path"), spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(a.media_root).withColumn("path", F.regexp_replace("path", "^file:/*", "/")))
    wrong = locks.lock_issues(locks.read_lock(a.lock), rows, media, SCHEMAS)
    print("\n".join(wrong) or "the lock holds")
    return 1 if wrong else 0


def analyze(spark: SparkSession, a: argparse.Namespace) -> int:
    """Five tables and a report; with --require-complete a faulty run fails after they are written."""
    names = ("summary", "comparisons", "confirmatory", "dose_curves", "issues")
    outputs = {n: f"{a.out}/{n}.csv" for n in names} | {"report": f"{a.out}/report.json"}
    sinks.reject_aliases(outputs, {"predictions": a.predictions, "manifest": a.manifest})
    sinks.refuse_overwrite(outputs.values(), a.overwrite)
    settings = P.resolve({"bootstrap_replicates": 2000, "seed": 42, "confidence_level": 0.95, "reference_condition": "full_video", "confirmatory_comparisons": []}, P.analysis_settings(P.read_mapping(a.config)) if a.config else {}, {"bootstrap_replicates": a.replicates, "seed": a.seed}, a.locked)
    predictions = preparation.flattened(files.jsonl(spark, a.predictions, PREDICTIONS))
    manifest = preparation.flattened(files.jsonl(spark, a.manifest, MANIFEST)) if a.manifest else None
    observed, expected, issues = preparation.prepared(predictions, manifest)
    common = {"replicates": settings["bootstrap_replicates"], "seed": settings["seed"], "level": settings["confidence_level"]}
    tables = {
        "summary": reports.summary(observed, expected, **common), "comparisons": reports.comparisons(observed, expected, settings["reference_condition"], **common),
        "confirmatory": reports.confirmatory(observed, expected, settings["confirmatory_comparisons"], **common),
        "dose_curves": reports.dose_curves(observed, expected, settings["reference_condition"], **common), "issues": preparation.issue_counts(issues),
    }
    orders = {"summary": reports.GROUP, "comparisons": [*reports.STRATA, "comparison_type", "contrast", "requested_dose"], "confirmatory": ["contrast", *reports.CONFIRMATORY], "dose_curves": [*reports.STRATA, "condition", "dose_index"], "issues": ["kind"]}
    for name, table in tables.items():
        sinks.one_csv(table, outputs[name], orders[name], orders[name])
    wanted = expected.count() if expected is not None else 0
    counts = spark.createDataFrame([(wanted, observed.count(), 0, 0, observed.select("resampling_unit_id").distinct().count())], "expected long, joined long, unexpected long, duplicates long, units long")
    reasons = [r.reason for r in preparation.failures(tables["issues"], counts if expected is not None else None, expected is not None).orderBy("reason").collect()]
    sinks.json_file(outputs["report"], {"settings": settings, "expected_trials": wanted, "joined_prediction_trials": observed.count(), "failures": reasons})
    return 1 if a.require_complete and reasons else 0


def finalize_protocol(spark: SparkSession | None, a: argparse.Namespace) -> int:
    done = P.with_projector(P.read_mapping(a.protocol), P.read_mapping(a.projector_lock), a.schema)
    sinks.yaml_file(a.out, done, lambda path: P.checked(None, P.role_faults(P.read_mapping(path))))
    return 0


VERBS = {
    "validate": (validate, ["manifest", "report"], []), "adapt": (adapt, ["dataset", "annotations", "media-root", "split", "out", "report"], ["exclusions"]), "build-trials": (build_trials, ["manifest", "conditions", "out", "report"], ["option-permutations"]),
    "lock-data": (lock_data, ["manifest", "media-root", "out"], []), "verify-lock": (verify_lock, ["manifest", "media-root", "lock"], []), "analyze": (analyze, ["predictions", "out"], ["manifest", "config"]),
    "finalize-protocol": (finalize_protocol, ["protocol", "projector-lock", "out"], []),
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tarn")
    verbs = out.add_subparsers(dest="verb", required=True)
    for name, (f, needed, optional) in VERBS.items():
        p = verbs.add_parser(name, help=(f.__doc__ or "").split("\n")[0])
        for x in needed:
            p.add_argument(f"--{x}", required=True)
        for x in optional:
            p.add_argument(f"--{x}")
        if name in ("build-trials", "analyze"):
            p.add_argument("--seed", type=int, default=42 if name == "build-trials" else None)
        if name == "analyze":
            p.add_argument("--replicates", type=int)
            for flag in ("overwrite", "locked", "require-complete"):
                p.add_argument(f"--{flag}", action="store_true")
        if name == "finalize-protocol":
            p.add_argument("--schema", default="tarn.projector_lock.1")
    return out


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    run = VERBS[a.verb][0]
    if a.verb == "finalize-protocol":
        return run(None, a)
    return run(spark or SparkSession.builder.appName("tarn").getOrCreate(), a)


if __name__ == "__main__":
    sys.exit(main())
