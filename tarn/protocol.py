"""Protocols: what a confirmatory run fixes beforehand, read from YAML or JSON and checked on the driver.

Checks collect all faults; `checked` raises them together.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Mapping, Sequence
from pathlib import Path
from typing import Any

from .functions.digests import canonical_digest
from .functions.records import FAMILIES

LATE_BOUND = ("projector",)
DTYPES = ("bf16", "fp16", "fp32")
OVERFLOW = ("error", "truncate_visual")
RUN_ID = re.compile(r"^adapter-run::[0-9a-f]{64}$")
_SHA = re.compile(r"^[0-9a-f]{64}$")
PROJECTOR_DIGESTS = [
    "checkpoint_sha256", "metadata_sha256", "training_manifest_sha256", "evaluation_manifest_sha256", "training_feature_index_sha256", "training_feature_metadata_sha256", "training_feature_artifact_root_sha256",
    "evaluation_feature_index_sha256", "evaluation_feature_metadata_sha256", "evaluation_feature_artifact_root_sha256", "evaluation_trial_matrix_closure_sha256", "evaluation_trial_set_root_sha256",
    "encoder_extraction_pipeline_identity_sha256", "llm_pretrained_identity_sha256",
]


class Faults(ValueError):
    def __init__(self, faults: Sequence[str]):
        super().__init__("; ".join(faults))
        self.faults = list(faults)


def checked(value: Any, faults: Sequence[str]) -> Any:
    if faults:
        raise Faults(faults)
    return value


def read_mapping(path: str | Path) -> dict:
    """A JSON or YAML file that holds a mapping."""
    text = Path(path).read_text(encoding="utf-8")
    try:
        value = json.loads(text)
    except json.JSONDecodeError:
        import yaml

        value = yaml.safe_load(text) or {}
    if not isinstance(value, Mapping):
        raise Faults([f"{path} holds no mapping"])
    return dict(value)


def file_sha256(path: str | Path) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


def load(path: str | Path) -> tuple[dict, dict]:
    """(protocol, {path, sha256, schema_version}) of a file with a schema version and sound dataset roles."""
    protocol = read_mapping(path)
    version = str(protocol.get("schema_version", "")).strip()
    checked(protocol, [*(["no schema_version"] if not version else []), *role_faults(protocol)])
    return protocol, {"path": str(Path(path).resolve()), "sha256": file_sha256(path), "schema_version": version}


def section(protocol: Mapping, name: str) -> dict:
    value = protocol.get(name)
    return dict(checked(value, [] if isinstance(value, Mapping) else [f"section {name!r} is no mapping"]))


def analysis_settings(value: Mapping) -> dict:
    """The analysis section of a protocol, or the mapping itself, with its confirmatory comparisons."""
    inner = value.get("analysis")
    out = dict(inner) if isinstance(inner, Mapping) else {k: v for k, v in value.items() if k != "confirmatory_comparisons"}
    pairs = value.get("confirmatory_comparisons", out.get("confirmatory_comparisons"))
    if pairs is not None:
        out["confirmatory_comparisons"] = comparisons(pairs)
    return out


def comparisons(value: Any) -> list[tuple[str, str]]:
    """Pairs of different condition names, each pair once."""
    faults, out = [], []
    for i, pair in enumerate(value if isinstance(value, (list, tuple)) else [None]):
        if not isinstance(pair, (list, tuple)) or len(pair) != 2 or any(not str(x).strip() for x in pair) or str(pair[0]).strip() == str(pair[1]).strip():
            faults.append(f"comparison {i} is no pair of different conditions")
        elif (p := (str(pair[0]).strip(), str(pair[1]).strip())) in out:
            faults.append(f"comparison {i} occurs twice")
        else:
            out.append(p)
    return checked(out, faults)


def resolve(defaults: Mapping, config: Mapping, given: Mapping, locked: bool) -> dict:
    """Settings: given ones over configured ones over defaults; a locked run refuses a given one that differs."""
    out = {k: config.get(k, v) for k, v in defaults.items()}
    faults = [f"{k} is locked" for k, v in given.items() if locked and v is not None and v != out.get(k)]
    return checked({**out, **({} if locked else {k: v for k, v in given.items() if v is not None})}, faults)


def role_faults(protocol: Mapping) -> list[str]:
    roles = protocol.get("dataset_roles")
    if not isinstance(roles, Mapping) or not roles:
        return ["dataset_roles must be a non-empty mapping"]
    out = []
    for name, role in roles.items():
        families = role.get("information_families") if isinstance(role, Mapping) else None
        if not str(name).strip() or not isinstance(role, Mapping) or not isinstance(families, (list, tuple)) or not families:
            out.append(f"dataset_roles.{name}: information_families must be a non-empty list")
            continue
        clean = [str(f).strip() for f in families]
        out += [f"dataset_roles.{name}: {m}" for bad, m in ((set(clean) - set(FAMILIES), "unknown information family"), (len(set(clean)) != len(clean), "repeated information family"), (not str(role.get("primary_use", "")).strip(), "no primary_use")) if bad]
    return out


def sha_faults(value: Mapping, names: Sequence[str], where: str) -> list[str]:
    return [f"{where}.{n} is no SHA-256" for n in names if not _SHA.match(str(value.get(n) or "").strip().lower())]


def data_faults(protocol: Mapping) -> list[str]:
    """Faults of the data section: digests, required datasets, and the coverage contract of each."""
    data = protocol.get("data")
    if not isinstance(data, Mapping):
        return ["section 'data' is no mapping"]
    out = sha_faults(data, ["data_release_sha256", "conditions_sha256"], "data") + role_faults(protocol)
    required = [str(x).strip() for x in data.get("required_datasets") or []]
    contract = data.get("coverage_contract")
    datasets = contract.get("datasets") if isinstance(contract, Mapping) else None
    if not required or len(set(required)) != len(required) or not all(required):
        out.append("data.required_datasets must be different names")
    if not isinstance(datasets, Mapping) or set(map(str, datasets)) != set(required):
        return [*out, "coverage_contract.datasets must name the required datasets"]
    roles = protocol.get("dataset_roles") or {}
    for name in required:
        c, where = datasets[name], f"coverage_contract.{name}"
        if name not in roles:
            out.append(f"{name} has no dataset role")
        ids = [str(x).strip() for x in c.get("required_adapter_run_ids") or []]
        if not isinstance(c.get("required_adapter_runs"), int) or c["required_adapter_runs"] < 1 or len(ids) != c["required_adapter_runs"] or len(set(ids)) != len(ids) or not all(map(RUN_ID.match, ids)):
            out.append(f"{where}: adapter runs")
        for key, empty in (("required_splits", False), ("required_information_families", False), ("required_question_families", True), ("required_source_roles", False)):
            values = c.get(key)
            if not isinstance(values, list) or (not values and not empty) or len(set(map(str, values))) != len(values) or any(not str(v).strip() or "REPLACE_" in str(v) for v in values):
                out.append(f"{where}.{key}")
        if set(map(str, c.get("required_information_families") or [])) - set((roles.get(name) or {}).get("information_families") or []):
            out.append(f"{where}: families outside the dataset role")
        out += [f"{where}.{k}" for k in ("minimum_records", "minimum_records_with_evidence", "minimum_records_with_safe_oracles") if isinstance(c.get(k, 0), bool) or not isinstance(c.get(k, 0), int) or c.get(k, 0) < 0]
    return out


def model_faults(protocol: Mapping) -> list[str]:
    model = protocol.get("model")
    if not isinstance(model, Mapping):
        return ["section 'model' is no mapping"]
    tests = [
        *((model.get(k) is not True, f"model.{k} must be true") for k in ("llm_frozen", "visual_encoder_frozen", "projector_frozen_during_evaluation")), (not str(model.get("llm_id", "")).strip(), "model.llm_id"),
        (not re.fullmatch(r"[0-9a-f]{40,64}", str(model.get("llm_revision") or "").strip().lower()), "model.llm_revision must pin a commit"), (not str(model.get("max_length", "")).isdigit() or int(model["max_length"]) < 1, "model.max_length"),
        (model.get("overflow_policy") not in OVERFLOW, "model.overflow_policy"), (str(model.get("dtype", "")).lower() not in DTYPES, "model.dtype"),
    ]
    return [m for bad, m in tests if bad]


def projector_faults(protocol: Mapping, metadata: Mapping, checkpoint_sha256: str, metadata_sha256: str) -> list[str]:
    """Where a projector and its metadata are not what the protocol locked."""
    locked = protocol.get("projector")
    if not isinstance(locked, Mapping):
        return ["section 'projector' is no mapping"]
    actual = {**{k: str(metadata.get(k, "")).lower() for k in PROJECTOR_DIGESTS}, "checkpoint_sha256": checkpoint_sha256.lower(), "metadata_sha256": metadata_sha256.lower()}
    out = sha_faults(locked, PROJECTOR_DIGESTS, "projector")
    out += [f"projector.{k} differs" for k in PROJECTOR_DIGESTS if str(locked.get(k) or "").strip().lower() != actual[k]]
    for key, own in (("training_dtype", "dtype"), ("training_max_length", "max_length"), ("training_seed", "seed"), ("evaluation_trial_count", "evaluation_trial_count")):
        if isinstance(locked.get(key), bool) or locked.get(key) is None or str(locked[key]).lower() != str(metadata.get(own)).lower():
            out.append(f"projector.{key} differs")
    closure = metadata.get("evaluation_trial_matrix_closure")
    body = {k: v for k, v in closure.items() if k != "closure_sha256"} if isinstance(closure, Mapping) else {}
    if body.get("status") != "exact" or canonical_digest(body) != str(closure.get("closure_sha256", "")).lower() or str(body.get("trial_set_root_sha256", "")).lower() != actual["evaluation_trial_set_root_sha256"] or body.get("trial_count") != metadata.get("evaluation_trial_count"):
        out.append("the trial matrix closure is missing or inconsistent")
    return out


def build_sha256(protocol: Mapping, schema: str) -> str:
    """The digest of what a protocol commits to before late-bound sections are known."""
    kept = {str(k): v for k, v in protocol.items() if str(k) not in LATE_BOUND}
    return canonical_digest(checked({"schema_version": schema, "excluded_late_bound_sections": sorted(LATE_BOUND), "protocol": kept}, [] if kept else ["nothing is committed"]))


def with_projector(protocol: Mapping, lock: Mapping, schema: str) -> dict:
    """The protocol with its projector section filled in; the fields must be the template's."""
    template, filled = protocol.get("projector"), {k: v for k, v in lock.items() if k != "schema_version"}
    faults = [] if isinstance(template, Mapping) and template else ["the protocol has no projector template"]
    faults += [] if lock.get("schema_version") == schema else ["another projector lock schema"]
    if not faults and set(filled) != set(template):
        faults.append(f"other fields: {sorted(set(filled) ^ set(template))}")
    return checked({**protocol, "projector": filled}, faults)


def coverage_faults(contract: Mapping, coverage: Sequence[Mapping], runs: Sequence[Mapping]) -> list[str]:
    """Where a release is not what its contract says.

    coverage: rows of connectors.coverage (one a dataset, split and family); runs: dataset, adapter_run_id,
    canonical_split, source_roles.
    """
    out, wanted = [], set(contract)
    if {r["dataset"] for r in coverage} != wanted or {r["dataset"] for r in runs} != wanted:
        return ["the datasets are not the required ones"]
    for name in sorted(wanted):
        c, rows, own = contract[name], [r for r in coverage if r["dataset"] == name], [r for r in runs if r["dataset"] == name]
        values = lambda k: {r[k] for r in rows}
        questions, asked = values("question_family"), set(c["required_question_families"])
        tests = [
            ({r["adapter_run_id"] for r in own} != set(c["required_adapter_run_ids"]), "adapter runs"), (values("split") != set(c["required_splits"]) or {r["canonical_split"] for r in own} != set(c["required_splits"]), "splits"),
            (values("information_family") != set(c["required_information_families"]), "information families"), (questions != asked if c.get("exact_question_family_set") is True else not asked <= questions, "question families"),
            (not set(c["required_source_roles"]) <= {x for r in own for x in r["source_roles"]}, "source roles"),
            *((sum(r[column] for r in rows) < c.get(key, 0), key) for key, column in (("minimum_records", "rows"), ("minimum_records_with_evidence", "with_evidence"), ("minimum_records_with_safe_oracles", "with_safe_facts"))),
        ]
        out += [f"{name}: {m}" for bad, m in tests if bad]
    return out


def partition_faults(value: Any, schema: str, algorithm: str) -> list[str]:
    """Faults of a signed score partition."""
    if not isinstance(value, Mapping) or set(value) != {"schema_version", "algorithm", "worker_count", "worker_index"}:
        return ["a partition has schema_version, algorithm, worker_count and worker_index"]
    n, i = value["worker_count"], value["worker_index"]
    whole = all(isinstance(x, int) and not isinstance(x, bool) for x in (n, i))
    return [m for bad, m in ((value["schema_version"] != schema, "schema_version"), (value["algorithm"] != algorithm, "algorithm"), (not whole or n < 1 or not 0 <= i < n, "worker coordinates")) if bad]


def selection_faults(selection: Mapping, contract: Mapping, records: int, unit_set_sha256: str) -> list[str]:
    """Where a sampling report is not the contract's population and size."""
    want = {**{k: contract[k] for k in ("sample_size", "seed", "population_record_count", "population_unit_count")}, "population_unit_set_sha256": unit_set_sha256, "selected_record_count": records}
    return [f"{k}: {selection.get(k)!r}, not {v!r}" for k, v in want.items() if selection.get(k) != v]


def encoders(path: str | Path) -> list[dict]:
    """Rows of an encoder registry: name with its settings; a pinned revision must be a commit."""
    value = read_mapping(path)
    table = value.get("encoders", value)
    rows = [{"name": str(n), **dict(s)} for n, s in table.items()] if isinstance(table, Mapping) else [dict(s) for s in table]
    faults = [f"{r.get('name')}: revision" for r in rows if r.get("revision") and not re.fullmatch(r"[0-9a-fA-F]{7,64}", str(r["revision"]))]
    return checked(rows, [*faults, *(["encoder names must differ"] if len({r.get("name") for r in rows}) != len(rows) else [])])


def conditions(path: str | Path):
    """Conditions of a configuration file, checked, with different names; and its options."""
    from .operators.trials import Condition

    value = read_mapping(path)
    rows = value.get("conditions")
    out = [Condition.of(dict(r)) for r in checked(rows, [] if isinstance(rows, list) and rows else ["no conditions"])]
    return checked(out, [] if len({c.name for c in out}) == len(out) else ["condition names must differ"]), dict(value.get("options") or {})
