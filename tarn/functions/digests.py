"""Digest arithmetic: work assignment by content and identities of sets of rows."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def hex_mod(digest: Column, n: int) -> Column:
    """A hexadecimal number of any length modulo n, digit by digit."""
    digits = F.filter(F.split(digest, ""), lambda c: c != "")
    return F.aggregate(digits, F.lit(0).cast("bigint"), lambda a, c: (a * 16 + F.instr(F.lit("0123456789abcdef"), c) - 1) % n)


def worker(digest: Column, n: int) -> Column:
    """The worker of a content digest: the whole digest modulo n."""
    return hex_mod(digest, n)


def shard(key: Column, n: int) -> Column:
    """The shard of a key: the first eight bytes of its SHA-256 modulo n."""
    return hex_mod(F.substring(F.sha2(key.cast("string"), 256), 1, 16), n)


def set_identity(rows: DataFrame, digest: str, fan: int = 4) -> DataFrame:
    """root and members of a set of SHA-256 digests, whatever the order of rows.

    Digests are grouped by their first `fan` hexadecimal digits, so no task holds more than that share of the set; the
    root is taken over the sorted digests of the groups, 16 ** fan at most. Repeated digests count once.
    """
    parts = rows.select(F.col(digest).alias("d")).distinct().groupBy(F.substring("d", 1, fan).alias("p")).agg(
        F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ","), 256).alias("h"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda s: s.h)
    return parts.agg(F.sha2(F.array_join(whole, ","), 256).alias("root"), F.coalesce(F.sum("n"), F.lit(0)).alias("members"))


@F.pandas_udf(StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """JSON text with sorted keys, no white space and no NaN: Arrow batches, since number texts follow the shortest round trip."""
    said = lambda t: json.dumps(json.loads(t), ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)
    return texts.map(lambda t: None if t is None else said(t))


def canonical_sha256(value: Column) -> Column:
    """SHA-256 of the canonical JSON of a struct, map or array; null fields are kept."""
    return F.sha2(canonical_json(F.to_json(value, {"ignoreNullFields": "false"})).cast("binary"), 256)


def canonical_digest(value: object) -> str:
    """The same on the driver, for configuration."""
    return hashlib.sha256(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


def quoted(c: Column) -> Column:
    """A text as a JSON string."""
    return F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2)


#: Bytes of text in a piece of a listed root.
PIECE = 1 << 14


def listed_root(leaves: DataFrame, order: list[str], leaf: Column, name: str, schema: str) -> DataFrame:
    """root and members: SHA-256 of {"<name>":[leaves in order],"schema_version":"<schema>"}, the canonical form of a set.

    A SHA-256 is one stream over its text, so a root of this form needs the ordered text in one place, yet not at once:
    rows are dealt by ranges and put in order there, tasks pack the text of their leaves into small pieces, and one task
    hashes the pieces as it reads them. It holds a batch of pieces, whatever the set. Digests travel as 32 bytes. Use
    set_identity where the form is free.
    """
    import pyarrow as pa
    from pyspark import TaskContext

    before, after = (f'{{"{name}":[', f'],"schema_version":"{schema}"}}')
    if name > "schema_version":
        before, after = f'{{"schema_version":"{schema}","{name}":[', "]}"

    def packed(batches):
        task, n, held, rows, size = TaskContext.get().partitionId(), 0, [], 0, 0
        kinds = {"task": pa.int32(), "n": pa.int64(), "rows": pa.int64(), "size": pa.int64(), "data": pa.binary()}
        out = lambda r: pa.RecordBatch.from_arrays([pa.array([x[i] for x in r], t) for i, t in enumerate(kinds.values())], list(kinds))
        whole = lambda: (task, n, rows, len(text := b",".join(held)), pa.compress(text, "zstd", asbytes=True) if held else None)
        for batch in batches:
            ready = []
            for text in batch.column("__leaf").cast(pa.binary()).to_pylist():
                rows += 1
                if text is not None:
                    held.append(text)
                    size += len(text) + 1
                if size >= PIECE:
                    ready.append(whole())
                    n, held, rows, size = n + 1, [], 0, 0
            if ready:
                yield out(ready)
        if rows:
            yield out([whole()])

    def hashed(batches):
        sha, members, begun = hashlib.sha256(before.encode()), 0, False
        for batch in batches:
            for rows, size, data in zip(*(batch.column(c) for c in ("rows", "size", "data"))):
                members += rows.as_py()
                if data.is_valid:
                    sha.update(b"," if begun else b"")
                    sha.update(pa.decompress(data.as_buffer(), size.as_py(), "zstd"))
                    begun = True
        sha.update(after.encode())
        yield pa.RecordBatch.from_pydict({"root": [sha.hexdigest()], "members": pa.array([members], pa.int64())})

    texts = [c for c, kind in leaves.dtypes if kind == "string" and c not in order]
    short = {f"__b{i}": F.when(F.col(c).rlike(r"\A[0-9a-f]{64}\z"), F.unhex(c)) for i, c in enumerate(texts)}
    rest = {f"__t{i}": F.when(~F.coalesce(F.col(c).rlike(r"\A[0-9a-f]{64}\z"), F.lit(False)), F.col(c)) for i, c in enumerate(texts)}
    rows = leaves.withColumns(short | rest).drop(*texts) if texts else leaves
    rows = rows.repartitionByRange(*order).withColumns({c: F.coalesce(F.lower(F.hex(f"__b{i}")), F.col(f"__t{i}")) for i, c in enumerate(texts)})
    rows = rows.select(*order, leaf.alias("__leaf")).sortWithinPartitions(*order, "__leaf").select("__leaf")
    pieces = rows.mapInArrow(packed, "task int, n long, rows long, size long, data binary")
    none = leaves.sparkSession.range(1).select(F.lit(-1).alias("task"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("rows"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("binary").alias("data"))  # a set may be empty
    return none.unionByName(pieces).repartition(1).sortWithinPartitions("task", "n").mapInArrow(hashed, "root string, members long")


def numbered(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows with `number`, their place from 0 in the order of `by`: counted in ranges, so no task gets them all.

    The ranges are those of a range partitioning, whose boundaries come from a sample and decide on tasks only.
    """
    rows = rows.repartitionByRange(*by)
    tagged = rows.withColumn("__task", F.spark_partition_id())
    tagged = tagged.withColumn("__row", F.row_number().over(Window.partitionBy("__task").orderBy(*by)))
    sizes = tagged.groupBy("__task").agg(F.count("*").alias("__size"))
    first = sizes.select("__task", (F.sum("__size").over(Window.orderBy("__task")) - F.col("__size")).alias("__first"))  # a row a task
    return tagged.join(F.broadcast(first), "__task").withColumn("number", F.col("__first") + F.col("__row") - 1).drop("__task", "__row", "__first")
