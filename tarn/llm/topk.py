"""Exact top-k search by integer inner product, with block-at-a-time pruning.

A shard's vectors are put in order and cut into ranges of `BLOCK` documents. A block keeps each term's (dimension's)
largest and smallest weight; a query's bound for a block is the sum over its terms of weight times that extreme. Each
query takes blocks by falling bound and scores them whole through the block's rows, until the bound is below its k-th
score. Ties with the k-th are scored, since a smaller id wins.

Defined results: vectors that are null, empty or hold null or non-finite components take no part; a query meets only
vectors of its own length, and not its own id; of rows that share an id the smallest vector counts; scores beyond a
long are held at its limits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grid import QUERY_EVERY, TOP, best, crossed, same_length, stored, valid

BLOCK, QUERIES = 64, 2048  # documents of a block, queries whose bounds are held at once
_LOW, _HIGH = -(2**63), 2**63 - 1


def _products(q: np.ndarray, block: np.ndarray, exact_float: bool) -> np.ndarray:
    if exact_float:
        return (q @ block.T).astype(np.int64)
    whole = q.astype(object) @ block.T.astype(object)  # Python integers: any size
    return np.clip(np.frompyfunc(int, 1, 1)(whole), _LOW, _HIGH).astype(np.int64)


def search_shard(qid: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int = TOP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, id, score) of each query's k best in the shard; q and x hold whole numbers."""
    order = np.lexsort((ids, x.max(1), np.argmax(np.abs(x), 1)))  # alike vectors side by side, so bounds are tight
    ids, x = ids[order], x[order]
    starts = np.arange(0, len(ids), BLOCK)
    most, least = np.maximum.reduceat(x, starts), np.minimum.reduceat(x, starts)
    exact_float = bool(np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1] < 2**52)
    bound = np.maximum(q, 0) @ most.T + np.minimum(q, 0) @ least.T
    if not exact_float:
        bound = bound + np.abs(bound) * 1e-12 + 1
    by = np.argsort(-bound, axis=1, kind="stable")
    top_s = np.full((len(q), k), _LOW, np.int64)
    top_i = np.full((len(q), k), _HIGH, np.int64)
    filled = np.zeros(len(q), int)
    live = np.arange(len(q))
    for step in range(len(starts)):
        b = by[live, step]
        going = (filled[live] < k) | (bound[live, b] >= top_s[live, k - 1])
        live, b = live[going], b[going]
        if not len(live):
            break
        for one in np.unique(b):
            rows = live[b == one]
            lo, hi = starts[one], min(starts[one] + BLOCK, len(ids))
            s = _products(q[rows], x[lo:hi], exact_float)
            own = qid[rows][:, None] == ids[None, lo:hi]
            all_s = np.concatenate([top_s[rows], np.where(own, _LOW, s)], 1)
            all_i = np.concatenate([top_i[rows], np.where(own, _HIGH, ids[None, lo:hi])], 1)
            sort = np.lexsort((all_i, -all_s.astype(np.float64) if exact_float else ~all_s))[:, :k]
            top_s[rows], top_i[rows] = np.take_along_axis(all_s, sort, 1), np.take_along_axis(all_i, sort, 1)
            filled[rows] = np.minimum(k, filled[rows] + (~own).sum(1))
    keep = np.arange(k)[None, :] < filled[:, None]
    return np.nonzero(keep)[0], top_i[keep], top_s[keep]


def _score(queries: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
    out = []
    for q, qm, s, sm in same_length(queries, shard):
        qid = q["vec_id"].to_numpy()
        x = np.floor(1024.0 * sm)
        for lo in range(0, len(qid), QUERIES):
            own = qid[lo : lo + QUERIES]
            row, ids, score = search_shard(own, np.floor(1024.0 * qm[lo : lo + QUERIES]), s["vec_id"].to_numpy(), x)
            out.append(pd.DataFrame({"query_id": own[row], "vec_id": ids, "score": score}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")


def searched(vectors: DataFrame) -> DataFrame:
    """query_id, rank, vec_id, score for every id divisible by QUERY_EVERY against all rows."""
    index = stored(valid(vectors, zero=True), "vectors")
    found = crossed(index, index.where(F.col("vec_id") % QUERY_EVERY == 0), lambda share: _score, "query_id long, vec_id long, score long")
    return best(found, descending=True)
