"""Mixture-controlled packing: documents of many sources are cut into sequences of a fixed length.

Every source is a queue of tokens. Deficit round-robin serves the queues window by window, in the order of their names:
in each window a queue's deficit grows by its target share of the window's tokens, the whole part is taken from its head
and the rest is carried to the next window. Carried deficits have a closed form (after w windows of a phase a queue has
given floor(w * rate) tokens), so every partition finds the place of its own documents from the totals before it and no
partition waits for another. When a queue with a target share is empty the shares of the others are scaled up: a new
phase starts. The windows' tokens, one after another, fill sequences of `length` tokens; only the last has padding.

Target shares are the corpus's own by default, so all queues end together; so do, after the queues with a target share,
those without one. A window has `window` tokens a queue, so a queue's part of it does not shrink with their number. A
task holds 16 bytes a source and the running sums of the few windows it works on; a source's number and first token
come with its rows by a join. Within a queue documents stand in the order of input partitions.

Defined results: a null text is empty; a document without tokens is its closing id alone; a null source is a queue of
its own; rows that share a doc_id are packed one after another, each with its own places; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import lean, stored

LENGTH, WINDOW = 1024, 16_384
BROADCAST_ROWS = 1_000_000  # (partition, queue) rows broadcast at most: 24 MB
TOKENS = "part int, queue string, before long, doc_id long, tokens long, ids binary"


def _tokens(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, model, given = TaskContext.get().partitionId(), bpe.loaded(path), {}
        for b in bpe.small_batches(batches):
            ids, at = model.ids(b["text"])
            queues, before, blobs = b["queue"].to_pylist(), [], []
            ids = ids.astype("<u2" if len(model.pieces) <= 65536 else "<u4")
            closing = np.zeros(1, ids.dtype).tobytes()
            for i, q in enumerate(queues):
                before.append(given.get(q, 0))
                given[q] = before[-1] + int(at[i + 1] - at[i]) + 1
                blobs.append(ids[at[i] : at[i + 1]].tobytes() + closing)
            yield pa.record_batch([pa.array(np.full(len(queues), part, np.int32)), b["queue"], pa.array(before, pa.int64()), b["doc_id"], pa.array(np.diff(at) + 1), pa.array(blobs, pa.binary())], names=["part", "queue", "before", "doc_id", "tokens", "ids"])

    return run


class _Phase:
    """Some queues from a state on: after w windows queue i has given base[i] + floor(w * per_window[i] / parts) tokens, as far as it has any."""

    def __init__(self, first: int, queues: np.ndarray, base: np.ndarray, room: np.ndarray, per_window: list[int] | np.ndarray, parts: int):
        self.first, self.queues, self.base, self.room, self.parts = first, queues, base, room, parts
        self.whole = np.array([x // parts for x in per_window], np.int64) if isinstance(per_window, list) else per_window // parts
        self.rest = np.array([x % parts for x in per_window], np.int64) if isinstance(per_window, list) else per_window % parts
        self.sums = lru_cache(maxsize=16)(self._sums)

    def given(self, i: int, w: int) -> int:
        return min(int(self.room[i]), w * int(self.whole[i]) + w * int(self.rest[i]) // self.parts)

    def all_given(self, w: int) -> np.ndarray:
        return np.minimum(self.room, w * self.whole + w * self.rest // self.parts)

    def _sums(self, w: int) -> tuple[np.ndarray, np.ndarray]:
        """What each queue has given before window w, and the place in the stream of its first token of it."""
        before = self.all_given(w)
        now = self.all_given(w + 1) - before
        return before, self.first + int(before.sum()) + np.cumsum(now) - now

    def window_of(self, i: int, x: int) -> int:
        """The window that has token x of queue i's part of the phase."""
        rate = int(self.whole[i]) * self.parts + int(self.rest[i])
        w = x * self.parts // rate
        while self.given(i, w + 1) <= x:
            w += 1
        while w and self.given(i, w) > x:
            w -= 1
        return w


class Schedule:
    """The round-robin over queues with given totals and target shares {queue: share} (None: in proportion to the totals)."""

    def __init__(self, totals: np.ndarray, shares: dict[int, float] | None = None, window: int = WINDOW):
        totals = np.asarray(totals, np.int64)
        window *= max(1, len(totals))
        given, done = np.zeros(len(totals), np.int64), 0
        self.phases: list[_Phase] = []
        most = sum(s for s in (shares or {}).values() if s > 0)
        # shares as whole numbers: products with window numbers stay within 64 bits
        weight = {q: max(1, round(s / most * (1 << 28))) for q, s in sorted((shares or {}).items()) if s > 0 and totals[q]}
        while weight:
            live = np.array(list(weight), np.int64)
            parts, per_window = sum(weight.values()), [window * w for w in weight.values()]
            phase = _Phase(done, live, given[live].copy(), totals[live] - given[live], per_window, parts)
            n = min(-(-int(room) * parts // rate) for room, rate in zip(phase.room, per_window))  # until a queue is empty
            given[live] += phase.all_given(n)
            done = int(given.sum())
            self.phases.append(phase)
            weight = {q: w for q, w in weight.items() if given[q] < totals[q]}
        left = totals - given
        if left.sum():
            self.phases.append(_Phase(done, np.arange(len(totals)), given, left, left, -(-int(left.sum()) // window)))
        self.starts = [{int(q): i for i, q in enumerate(p.queues)} if len(p.queues) < len(totals) else None for p in self.phases]

    def pieces(self, q: int, lo: int, hi: int) -> Iterator[tuple[int, int, int]]:
        """(from, to, place in the stream) of tokens lo to hi of queue q."""
        for phase, numbers in zip(self.phases, self.starts):
            i = q if numbers is None else numbers.get(q)
            if i is None:
                continue
            base, end = int(phase.base[i]), int(phase.base[i]) + self._part(phase, i)
            if lo >= end or hi <= base:
                continue
            x, stop = max(lo, base), min(hi, end)
            w = phase.window_of(i, x - base)
            while x < stop:
                before, place = phase.sums(w)
                y = min(stop, base + phase.given(i, w + 1))
                if y > x:
                    yield x, y, int(place[i]) + x - base - int(before[i])
                    x = y
                w += 1

    def _part(self, phase: _Phase, i: int) -> int:
        """How many tokens a queue gives in a phase."""
        at = bisect.bisect_right(self.phases, phase.first, key=lambda p: p.first)
        while at < len(self.phases):
            later, numbers = self.phases[at], self.starts[at]
            k = int(phase.queues[i]) if numbers is None else numbers.get(int(phase.queues[i]))
            if k is not None:
                return int(later.base[k]) - int(phase.base[i])
            at += 1
        return int(phase.room[i])


def _pieces(totals: np.ndarray, shares: dict[int, float] | None, length: int, window: int, wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Schedule(totals, shares, window)
        for whole in batches:
            for b in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
                out: list[tuple] = []
                for queue, before, offset, doc, n, blob in zip(*(b[c].to_pylist() for c in ("number", "before", "base", "doc_id", "tokens", "ids"))):
                    ids = np.frombuffer(blob, "<u4" if wide else "<u2").astype("<u4")
                    lo = before + offset
                    spans: list[list[int]] = []
                    for x, y, place in plan.pieces(queue, lo, lo + n):
                        if spans and spans[-1][2] + spans[-1][1] - spans[-1][0] == place:
                            spans[-1][1] = y
                        else:
                            spans.append([x, y, place])
                    for x, y, place in spans:
                        while x < y:
                            size = min(y - x, length - place % length)
                            out.append((doc, x - lo, size, zlib.crc32(ids[x - lo : x - lo + size].tobytes()), n, place // length, place % length))
                            x, place = x + size, place + size
                cols = list(zip(*out)) or [()] * 7
                yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def packed(docs: DataFrame, shares: dict[str, float] | None = None, length: int = LENGTH, window: int = WINDOW, path: str | None = None) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    shares: target share of each source's tokens (sources left out: 0, served after the others); None: the corpus's own.
    """
    path = path or bpe.vocabulary_path()
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", source.alias("queue"))
    tokens = stored(rows.mapInArrow(lean(_tokens(path)), TOKENS), "tokens")
    # what each (partition, queue) has; a running sum over partitions gives the place of a partition's first token
    own = stored(tokens.groupBy("part", "queue").agg(F.sum("tokens").alias("n")), "own")
    queues = own.groupBy("queue").agg(F.sum("n").alias("n"))
    queues = stored(numbered(queues, "queue"), "queues")
    base = own.select("part", F.col("queue").alias("q"), (F.sum("n").over(Window.partitionBy("queue").orderBy("part")) - F.col("n")).alias("base"))
    right = base.join(queues.select("queue", "number").hint("merge"), F.col("q").eqNullSafe(F.col("queue"))).select(F.col("part").alias("p"), "q", "base", "number")
    right = F.broadcast(right) if own.count() <= BROADCAST_ROWS else right.hint("merge")
    both = tokens.join(right, (F.col("part") == F.col("p")) & F.col("queue").eqNullSafe(F.col("q")))
    totals = queues.select("number", "n").toArrow().sort_by("number")["n"].to_numpy()
    asked = None
    if shares is not None:
        asked = {r.number: float(shares[r.queue]) for r in queues.where(F.col("queue").isin([k for k in shares if k is not None]) | (F.col("queue").isNull() & F.lit(None in shares))).collect()}
    wide = len(bpe.loaded(path).pieces) > 65536
    return both.select("number", "before", "base", "doc_id", "tokens", "ids").mapInArrow(
        lean(_pieces(totals, asked, length, window, wide)),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )


def numbered(rows: DataFrame, by: str) -> DataFrame:
    """rows with `number`, their place from 0 in the order of a unique column, nulls first: sorted by ranges, counted by task."""
    ordered = stored(rows.orderBy(F.asc_nulls_first(by)).withColumn("__task", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id()), "ordered")
    sizes = ordered.groupBy("__task").agg(F.count("*").alias("__size"), F.min("__row").alias("__least"))
    first = sizes.select("__task", "__least", (F.sum("__size").over(Window.orderBy("__task")) - F.col("__size")).alias("__first"))  # a row a task
    return ordered.join(F.broadcast(first), "__task").withColumn("number", F.col("__first") + F.col("__row") - F.col("__least")).drop("__task", "__row", "__least", "__first")
