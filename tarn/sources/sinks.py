"""Sinks with guards: no path is both read and written, nothing is overwritten unasked, small files appear whole.

Tables are written by Spark's commit protocol. One-file forms (`one_jsonl`, `one_csv`, `json_file`, `yaml_file`) are for
reports of bounded size; their bytes depend on the rows alone.
"""

from __future__ import annotations

import csv
import gzip
import io
import json
import os
import tempfile
from collections.abc import Callable, Iterable, Mapping
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_ROWS = 1_000_000  # rows of a one-file report


def reject_aliases(outputs: Mapping[str, str | None], inputs: Mapping[str, str | None] = {}) -> None:
    """Raises ValueError where two outputs, or an output and an input, are one file."""
    seen: dict[str, str] = {}
    for name, path in inputs.items():
        if path:
            seen.setdefault(os.path.realpath(path), name)
    for name, path in outputs.items():
        if path:
            if other := seen.get(os.path.realpath(path)):
                raise ValueError(f"{name} and {other} are the same file: {path}")
            seen[os.path.realpath(path)] = name


def refuse_overwrite(paths: Iterable[str], overwrite: bool = False) -> None:
    there = [p for p in paths if os.path.exists(p)]
    if there and not overwrite:
        raise FileExistsError(f"would overwrite {', '.join(there)}")


def atomic_bytes(path: str, data: bytes, check: Callable[[Path], None] | None = None) -> None:
    """The file appears whole or not at all; check may refuse it before it does."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(prefix=f".{target.name}.", suffix=".tmp", dir=target.parent)
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        if check is not None:
            check(Path(name))
        os.replace(name, target)
    finally:
        Path(name).unlink(missing_ok=True)


def json_file(path: str, value: object) -> None:
    atomic_bytes(path, (json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True, allow_nan=False) + "\n").encode())


def yaml_file(path: str, value: Mapping, check: Callable[[Path], None] | None = None) -> None:
    import yaml

    atomic_bytes(path, yaml.safe_dump(dict(value), sort_keys=False, allow_unicode=True).encode(), check)


def _rows(df: DataFrame, order: list[str]) -> Iterable[dict]:
    df = df.orderBy(*order) if order else df
    for n, row in enumerate(df.toLocalIterator()):
        if n >= MOST_ROWS:
            raise ValueError(f"more than {MOST_ROWS} rows: write a table instead")
        yield row.asDict(recursive=True)


def one_jsonl(df: DataFrame, path: str, order: list[str]) -> None:
    """Rows in order, keys sorted at every level, gzip by suffix without a time stamp: the same rows give the same bytes."""
    text = "".join(json.dumps(r, ensure_ascii=False, sort_keys=True, default=str) + "\n" for r in _rows(df, order)).encode()
    if path.endswith(".gz"):
        buffer = io.BytesIO()
        with gzip.GzipFile(filename="", mode="wb", fileobj=buffer, mtime=0) as f:
            f.write(text)
        text = buffer.getvalue()
    atomic_bytes(path, text)


def csv_text(rows: Iterable[Mapping], preferred: list[str] = [], fields: list[str] | None = None) -> str:
    """Preferred columns first, then all others in the order in which they are met; empty without rows and fields."""
    rows = list(rows)
    names = fields if fields is not None else list(dict.fromkeys([*(p for p in preferred if any(p in r for r in rows)), *(k for r in rows for k in r)]))
    if not names:
        return ""
    out = io.StringIO()
    writer = csv.DictWriter(out, names, extrasaction="ignore", lineterminator="\n")
    writer.writeheader()
    writer.writerows({k: json.dumps(v, ensure_ascii=False, sort_keys=True) if isinstance(v, (dict, list)) else v for k, v in r.items()} for r in rows)
    return out.getvalue()


def one_csv(df: DataFrame, path: str, order: list[str], preferred: list[str] = [], fields: list[str] | None = None) -> None:
    atomic_bytes(path, csv_text(_rows(df, order), preferred, fields).encode())


def vectors_table(df: DataFrame, path: str, key: str = "visual_id", shards: int = 64) -> None:
    """A table of tensors (array columns), dealt by key: one row a view."""
    df.repartition(shards, key).sortWithinPartitions(key).write.mode("errorifexists").parquet(path)


def append_new(results: DataFrame, path: str, key: str = "trial_id") -> None:
    """Appends rows whose key the table does not have yet: a run that is started again adds what is missing and nothing twice."""
    spark = results.sparkSession
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path)
    rows = results.dropDuplicates([key])
    if there:
        rows = rows.join(spark.read.parquet(path).select(F.col(key).alias("__done")), F.col(key) == F.col("__done"), "left_anti")
    rows.write.mode("append").parquet(path)


def streamed(results: DataFrame, path: str, checkpoint: str, key: str = "trial_id"):
    """The same for a stream: batches are appended under a checkpoint, each key once even if a batch is repeated."""
    return results.writeStream.foreachBatch(lambda batch, _: append_new(batch, path, key)).option("checkpointLocation", checkpoint).start()
