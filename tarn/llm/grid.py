"""Vector tables in blocks: every query block meets every shard once, in a task of bounded size."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

QUERY_EVERY, TOP = 100, 10
QUERY_BLOCK = 32_768
SHARD_LEAST, SHARD_MOST = 1024, 32_768  # vectors in a shard


def valid(vectors: DataFrame, zero: bool) -> DataFrame:
    """vec_id, embedding array<double>, one row an id (of rows that share one, the smallest vector); left out: null ids, null or empty vectors, null or non-finite components, and zero vectors unless `zero`."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~F.coalesce(F.exists("embedding", odd), F.lit(True)))
    if not zero:
        rows = rows.where(F.exists("embedding", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def crossed(index: DataFrame, queries: DataFrame, score: Callable[[float], Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """score(share)(queries, shard) for every block of queries and every shard of the index, share being 1 / shards.

    Both are dealt by a hash of vec_id: the index into shards of about SHARD_LEAST to SHARD_MOST rows, copied once for
    each query block, the queries into blocks of about QUERY_BLOCK rows, copied once for each shard. A block is as large
    as a task's memory allows, since the index travels once for each.
    """
    n, m = index.count(), queries.count()
    shard_rows = min(SHARD_MOST, max(SHARD_LEAST, n // 64))
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-m // QUERY_BLOCK))
    at = lambda k, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(k)).cast("int")
    left = queries.withColumn("block", at(blocks, 1)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = index.withColumn("shard", at(shards, 2)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(score(1 / shards), schema)


def best(found: DataFrame, descending: bool) -> DataFrame:
    """query_id, rank, vec_id, score: the TOP best of each query, ties to the smaller vec_id."""
    order = F.desc("score") if descending else F.asc("score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(order, "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= TOP).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def same_length(queries: pd.DataFrame, shard: pd.DataFrame):
    """(query ids, query matrix, ids, matrix) for each vector length both sides have."""
    ql, sl = queries["embedding"].map(len).to_numpy(), shard["embedding"].map(len).to_numpy()
    for d in np.intersect1d(ql, sl):
        q, s = queries[ql == d], shard[sl == d]
        yield q, np.stack(q["embedding"].to_numpy()), s, np.stack(s["embedding"].to_numpy())


__all__ = ["QUERY_EVERY", "TOP", "best", "crossed", "same_length", "stored", "valid"]
