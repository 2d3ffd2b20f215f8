"""Approximate nearest neighbours by additive quantisation with exact reranking.

A vector is approximated by the sum of one full-dimensional word from each of `BOOKS` codebooks. The books are fitted as
residual k-means on a bounded sample (`SAMPLE` vectors, by hash of the id; refitting them jointly by least squares was
measured and gains under one point of recall) and every row is encoded by beam search. The index row holds the codes and
the squared norm of the approximation, no vector. A query builds a table of its inner products with all words;
|q - x|^2 is |q|^2 - 2 * sum of table entries + stored norm. The shards' best are merged, and the `RERANK` best of each
query in all are measured again on the original vectors, which are fetched for them alone, in double precision.

Shards are dealt by hash, so of a query's RERANK best a shard holds its even share and some spread: it reports its share
plus `SPREAD` standard deviations of it, and everything where that is fewer than its rows.
Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part; a query meets
only vectors of its own length, and not its own id; of rows that share an id the smallest vector counts. Lengths that
the sample lacks get books of zeros, so all their vectors tie, the smaller ids win, and the exact rerank decides among those.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, stored
from .grid import QUERY_EVERY, TOP, best, crossed, valid

BOOKS, WORDS, BEAM = 32, 256, 4
SAMPLE, ROUNDS, RERANK, SPREAD = 16_384, 6, 100, 6.0
CELLS = 2 << 20  # (query, row) pairs scored at once


def fit(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Codebooks (BOOKS, WORDS, dimensions): k-means on what the books before leave over."""
    rng = np.random.default_rng(seed)
    rest, books = x.astype(np.float32).copy(), np.zeros((BOOKS, WORDS, x.shape[1]), np.float32)
    for m in range(BOOKS):
        words = rest[rng.choice(len(rest), WORDS, replace=len(rest) < WORDS)]
        for _ in range(ROUNDS):
            near = _nearest(rest, words)
            order = np.argsort(near, kind="stable")
            found, at = np.unique(near[order], return_index=True)
            words = rest[rng.choice(len(rest), WORDS)]  # a word that is nobody's nearest starts anew
            words[found] = np.add.reduceat(rest[order], at) / np.diff(np.append(at, len(rest)))[:, None]
        words[0] = 0  # a book may add nothing
        books[m] = words
        rest -= words[_nearest(rest, words)]
    return books


def _nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmin((words**2).sum(1) - 2 * part @ words.T, 1) for part in np.array_split(x, -(-len(x) // 4096))])


def encode(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared norms of the approximations): the best of BEAM partial sums, book by book."""
    n = len(x)
    rest, codes = x[:, None, :].astype(np.float32), np.zeros((n, 1, 0), np.uint8)
    error = (rest**2).sum(2)
    for words in books:
        flat = (error[:, :, None] + (words**2).sum(1) - 2 * rest @ words.T).reshape(n, -1)
        beam = min(BEAM, flat.shape[1])
        pick = np.argpartition(flat, beam - 1, 1)[:, :beam]
        old, word, error = pick // WORDS, pick % WORDS, np.take_along_axis(flat, pick, 1)
        rest = np.take_along_axis(rest, old[:, :, None], 1) - words[word]
        codes = np.concatenate([np.take_along_axis(codes, old[:, :, None], 1), word[:, :, None].astype(np.uint8)], 2)
    codes = codes[np.arange(n), np.argmin((rest**2).sum(2), 1)]
    return codes, (sum(books[m][codes[:, m]] for m in range(len(books))) ** 2).sum(1, dtype=np.float64)


def _no_books(length: int) -> np.ndarray:
    return np.zeros((BOOKS, WORDS, length), np.float32)


def _encoder(books: dict[int, np.ndarray]):
    def run(batches):
        for b in batches:
            codes, norms = [None] * len(b), np.zeros(len(b))
            size = b["embedding"].map(len).to_numpy()
            for d in np.unique(size):
                rows = np.flatnonzero(size == d)
                for part in np.array_split(rows, -(-len(rows) // 1024)):
                    x = np.stack(b["embedding"].to_numpy()[part])
                    c, norms[part] = encode(x, books.get(int(d), _no_books(int(d))))
                    for i, row in zip(part, c):
                        codes[i] = row.tobytes()
            yield pd.DataFrame({"vec_id": b["vec_id"], "size": size.astype(np.int32), "codes": codes, "norm": norms})

    return run


def _scorer(books: dict[int, np.ndarray], share: float):
    """The best of a shard by approximation: its share of RERANK and some more."""

    def score(queries: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        out = []
        lengths = queries["embedding"].map(len).to_numpy()
        for d in np.intersect1d(lengths, shard["size"].to_numpy()):
            s = shard[shard["size"] == d].sort_values("vec_id")
            q = queries[lengths == d]
            own_books = books.get(int(d), _no_books(int(d)))
            codes = np.ascontiguousarray(np.frombuffer(b"".join(s["codes"]), np.uint8).reshape(len(s), BOOKS).T)
            ids, norm, qid = s["vec_id"].to_numpy(), s["norm"].to_numpy().astype(np.float32), q["vec_id"].to_numpy()
            qm = np.stack(q["embedding"].to_numpy()).astype(np.float32)
            expected = RERANK * share
            take = min(len(ids), int(expected + SPREAD * expected**0.5) + TOP)
            step = max(1, CELLS // len(ids))
            for lo in range(0, len(q), step):
                part = qm[lo : lo + step]
                near = np.repeat(norm[None], len(part), 0)
                for m in range(BOOKS):
                    near -= np.take(2 * (part @ own_books[m].T), codes[m], axis=1)
                near[qid[lo : lo + step][:, None] == ids[None]] = np.inf
                order = np.argpartition(near, take - 1, 1)[:, :take]
                value = np.take_along_axis(near, order, 1)
                keep = np.isfinite(value)
                out.append(pd.DataFrame({"query_id": np.repeat(qid[lo : lo + step], keep.sum(1)), "vec_id": ids[order[keep]], "score": value[keep].astype(np.float64)}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": np.zeros(0, int), "vec_id": np.zeros(0, int), "score": np.zeros(0)})

    return score


def _measured(batches):
    """Distances of pairs (query_id, vec_id, q, x) in double precision."""
    for b in batches:
        score = np.zeros(len(b))
        size = b["q"].map(len).to_numpy()
        for d in np.unique(size):
            rows = np.flatnonzero(size == d)
            for part in np.array_split(rows, -(-len(rows) // 4096)):
                score[part] = np.sqrt(((np.stack(b["q"].to_numpy()[part]) - np.stack(b["x"].to_numpy()[part])) ** 2).sum(1))
        yield pd.DataFrame({"query_id": b["query_id"], "vec_id": b["vec_id"], "score": score})


def searched(vectors: DataFrame) -> DataFrame:
    """query_id, rank, vec_id, score (distance) for every id divisible by QUERY_EVERY against all rows."""
    rows = stored(valid(vectors, zero=False), "vectors")
    n = max(1, rows.count())
    chance = int(min(1.0, SAMPLE / n) * 1_000_000)
    sample = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(1_000_000)) < chance).select("embedding").limit(2 * SAMPLE).toArrow()
    flat, size = sample["embedding"].combine_chunks().flatten().to_numpy(), pc.list_value_length(sample["embedding"]).to_numpy()
    at = np.concatenate([[0], np.cumsum(size)])
    books = {int(d): fit(np.stack([flat[at[i] : at[i + 1]] for i in np.flatnonzero(size == d)])) for d in np.unique(size)}
    index = stored(rows.mapInPandas(lean(_encoder(books)), "vec_id long, size int, codes binary, norm double"), "codes")
    queries = rows.where(F.col("vec_id") % QUERY_EVERY == 0)
    near = crossed(index, queries, lambda share: _scorer(books, share), "query_id long, vec_id long, score double")
    first = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    near = near.withColumn("rank", first).where(F.col("rank") <= RERANK).select("query_id", "vec_id")
    pairs = near.join(rows.select("vec_id", F.col("embedding").alias("x")).hint("merge"), "vec_id")
    pairs = pairs.join(queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")).hint("merge"), "query_id")
    found = pairs.select("query_id", "vec_id", "q", "x").mapInPandas(lean(_measured), "query_id long, vec_id long, score double")
    return best(found, descending=False)
