"""Substring dedup: long word runs that occur again are removed, the first occurrence stays.

Edges of a De Bruijn graph are the `width`-word windows (token k-mers) of all texts. An edge is filed under its
minimizer, its smallest `seed`-word hash, so equal edges meet under one key. Consecutive edges of a text that share a
minimizer are a path; its row holds a 128-bit BLAKE2 digest of its words and its source coordinates (document, start).

1. `_paths` turns texts into path rows. Paths met before in the same block of texts are already known to be repeats
   and travel as removal ranges only, so a hot passage sends one row for each block.
2. A shuffle on the minimizer brings the paths of a key together. Equal paths are nonbranching repeats and stay
   compact: all but the first are removed whole. Keys under which different paths meet branch there. The commonest
   minimizers (`HOT_KEYS` at most, found on one document in `HOT_EVERY`; this decides on tasks only) are dealt by path
   as well and count as branching, so a passage in very many contexts is no task's burden.
3. The first occurrence of each path at a branching key is joined with its text by source coordinates and
   expanded to single edges; a second shuffle on the edges' digests finds the later ones.
4. Removal ranges are gathered by document and applied to its text.

What is removed has the same BLAKE2 digest of its words, taken from the text at its source coordinates; word hashes only
choose minimizers. Defined results: null or empty texts have no words and lose nothing; texts shorter than `width`
words lose nothing; repeated rows with one doc_id and one text are one document, so neither is removed because of the
other; rows with one doc_id and different texts are different documents, in the order of the texts' SHA-256; a null
doc_id takes no part and loses nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, as_long, lean, mixed, stored
from .words import digest128, hashes_at, run_hashes, single_spaced, word_places

BLOCK_BYTES = 1 << 20  # texts whose repeats are found before the first shuffle
HOT_EVERY, HOT_KEYS, HOT_ROWS = 16, 20_000, 32  # share of documents looked at, hot minimizers at most, their rows there
PATHS = "m long, c long, d long, doc_id long, copy int, start int, n int, dup boolean"
_PATHS = pa.schema([("m", pa.int64()), ("c", pa.int64()), ("d", pa.int64()), ("doc_id", pa.int64()), ("copy", pa.int32()), ("start", pa.int32()), ("n", pa.int32()), ("dup", pa.bool_())])
SPANS = "doc_id long, copy int, start int, n int, expand boolean"
_SPANS = pa.schema([("doc_id", pa.int64()), ("copy", pa.int32()), ("start", pa.int32()), ("n", pa.int32()), ("expand", pa.bool_())])


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with doc_id as a long in __doc, and __copy: which of the texts of its doc_id a row has (0 where ids are unique)."""
    rows = docs.withColumn("__doc", F.col("doc_id").cast("long"))
    twice = rows.groupBy("__doc").count().where("count > 1 AND __doc IS NOT NULL").select(F.col("__doc").alias("__twice"))
    if not twice.take(1):
        return rows.withColumn("__copy", F.lit(0))
    rows = rows.withColumn("__digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    texts = rows.join(twice.hint("merge"), F.col("__doc") == F.col("__twice"), "left_semi").select(F.col("__doc").alias("__d"), F.col("__digest").alias("__t")).distinct()
    number = texts.select("*", (F.row_number().over(Window.partitionBy("__d").orderBy("__t")) - 1).alias("__n"))
    both = rows.join(stored(number, "copies").hint("merge"), (F.col("__doc") == F.col("__d")) & (F.col("__digest") == F.col("__t")), "left")
    return both.withColumn("__copy", F.coalesce("__n", F.lit(0))).drop("__digest", "__d", "__t", "__n")


def _known(batches: Iterator[pa.RecordBatch], limit: int | None = None) -> Iterator[pa.Table]:
    """Rows with a doc_id, in blocks of about `limit` bytes of text, by document."""
    held, size, limit = [], 0, limit or BLOCK_BYTES
    by = [("doc_id", "ascending"), ("copy", "ascending")]
    for b in batches:
        b = b.filter(pc.is_valid(b["doc_id"]))
        step = max(1, int(b.num_rows * limit // max(limit, b.nbytes)))
        for i in range(0, b.num_rows, step):
            held.append(b.slice(i, step))
            size += b.nbytes * min(step, b.num_rows - i) // max(1, b.num_rows)
            if size >= limit:
                yield pa.Table.from_batches(held).sort_by(by)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).sort_by(by)


def _minimizers(h: np.ndarray, offs: np.ndarray, width: int, seed: int):
    """For every edge of every text: its text, first word, minimizer value and minimizer position."""
    k = run_hashes(h, seed)
    span = width - seed + 1
    n = len(h) - width + 1
    best, at = k[:n].copy(), np.zeros(n, np.int32)
    for j in range(1, span):
        less = k[j : j + n] < best
        np.copyto(best, k[j : j + n], where=less)
        at[less] = j
    lens = np.maximum(0, np.diff(offs) - width + 1)
    doc = np.repeat(np.arange(len(lens)), lens)
    first = np.arange(len(doc)) - np.repeat(np.cumsum(lens) - lens, lens) + offs[doc]
    return doc, first, best[first], at[first] + first


def _path_rows(block: pa.Table, doc, start, n, m, digest, salt: int) -> Iterator[pa.RecordBatch]:
    """Path rows of a block, by document and start. Later ones of equal paths become removal ranges under a spread key."""
    ids, copy = block["doc_id"].to_numpy()[doc], block["copy"].to_numpy()[doc]
    c, d = digest[:, 0], digest[:, 1]
    order = np.lexsort((d, c))  # stable: equal paths stay in order
    dup = np.zeros(len(c), bool)
    dup[order[1:]] = (c[order[1:]] == c[order[:-1]]) & (d[order[1:]] == d[order[:-1]])
    # the same place of a repeated row is not a later occurrence
    lead = order[np.maximum.accumulate(np.where(dup[order], 0, np.arange(len(order))))]
    gone = np.zeros(len(c), bool)
    gone[order] = dup[order] & (ids[order] == ids[lead]) & (copy[order] == copy[lead]) & (start[order] == start[lead])
    m = np.where(dup, mixed(ids.view(U64) + U64(salt)), m)
    c, d = np.where(dup, U64(0), c), np.where(dup, U64(0), d)
    out = pa.table([as_long(m), as_long(c), as_long(d), pa.array(ids), pa.array(copy), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(dup)], schema=_PATHS)
    yield from out.filter(pa.array(~gone)).combine_chunks().to_batches(max_chunksize=65536)


def _paths(width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _known(batches):
            raw, _, starts, ends, offs = word_places(block["text"])
            if len(starts) < width:
                continue
            doc, first, value, at = _minimizers(hashes_at(raw, starts, ends), offs, width, seed)
            if not len(doc):
                continue
            new = np.ones(len(doc), bool)
            new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
            head = np.flatnonzero(new)
            n = np.diff(np.append(head, len(doc)))
            a, doc, m = first[head], doc[head], value[head]
            line, begin, stop = single_spaced(raw, starts, ends)
            digest = digest128([line[x:y] for x, y in zip(begin[a].tolist(), stop[a + n + width - 2].tolist())])
            yield from _path_rows(block, doc, a - offs[doc], n, m, digest, 11)

    return run


def _compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Path rows sorted by (m, c, d, doc_id, copy, start): ranges to remove, and first occurrences to expand where a key branches."""

    def told(rows, at, expand):
        return pa.record_batch([*(pa.array(rows[x][at]) for x in ("doc_id", "copy", "start", "n")), pa.array(np.full(len(rows["n"][at]), expand))], schema=_SPANS)

    last = None  # the row before: its key, path and place of the path's first occurrence
    branched, first = False, None  # whether the last key is known to branch; else the first occurrence of its only path
    for b in batches:
        rows = {x: b[x].to_numpy(zero_copy_only=False) for x in ("m", "c", "d", "doc_id", "copy", "start", "n", "dup", "hot")}
        yield told(rows, rows["dup"], False)
        rows = {x: v[~rows["dup"]] for x, v in rows.items()}
        m, count = rows["m"], len(rows["m"])
        if not count:
            continue
        new_m = np.ones(count, bool)
        new_m[1:] = m[1:] != m[:-1]
        new_path = new_m.copy()
        new_path[1:] |= (rows["c"][1:] != rows["c"][:-1]) | (rows["d"][1:] != rows["d"][:-1])
        goes_on = last is not None and m[0] == last["m"]
        if goes_on:
            new_m[0] = False
            new_path[0] = rows["c"][0] != last["c"] or rows["d"][0] != last["d"]
        # later occurrences of a path
        lead = np.maximum.accumulate(np.where(new_path, np.arange(count), -1))
        lead_of = {x: np.where(lead < 0, last[x] if last else 0, rows[x][lead]) for x in ("doc_id", "copy", "start")}
        later = ~new_path & np.logical_or.reduce([rows[x] != lead_of[x] for x in lead_of])
        yield told(rows, later, False)
        # first occurrences at keys with more than one path
        group = np.cumsum(new_m)  # 0: goes on from the batch before
        paths = np.bincount(group, weights=new_path + 2 * (rows["hot"] & new_m), minlength=group[-1] + 1)
        if goes_on:
            if not branched and paths[0] > 0:
                yield told(first, slice(None), True)
                branched = True
            paths[0] = 2 if branched else 0
        yield told(rows, new_path & (paths[group] > 1), True)
        if group[-1] > 0:
            i = int(np.flatnonzero(new_m)[-1])
            branched, first = bool(paths[group[-1]] > 1), {x: v[i : i + 1] for x, v in rows.items()}
        last = {x: rows[x][-1] for x in ("m", "c", "d")} | {x: v[-1] for x, v in lead_of.items()}


def _expand(width: int):
    """Texts with the path places to expand -> edge rows: their key and check are the edge's digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _known(batches):
            raw, _, starts, ends, offs = word_places(block["text"])
            spans = block["spans"].combine_chunks()
            doc = np.repeat(np.arange(len(spans)), spans.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            flat = spans.flatten()
            start, n = flat.field("start").to_numpy().astype(np.int64), flat.field("n").to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(n)), n)
            a = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + start[row] + offs[doc[row]]
            a, row = a[a + width <= offs[doc[row] + 1]], row[a + width <= offs[doc[row] + 1]]
            if not len(a):
                continue
            order = np.argsort(doc[row] * (len(starts) + 1) + a, kind="stable")
            a, of = a[order], doc[row[order]]
            line, begin, stop = single_spaced(raw, starts, ends)
            digest = digest128([line[x:y] for x, y in zip(begin[a].tolist(), stop[a + width - 1].tolist())])
            yield from _path_rows(block, of, a - offs[of], np.ones(len(a), np.int64), digest[:, 0], digest, 13)

    return run


def _met(paths: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Ranges found where equal keys meet."""
    if hot is None:
        rows = paths.withColumn("hot", F.lit(False)).repartition("m")
    else:
        rows = paths.join(F.broadcast(hot), "m", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
        rows = rows.repartition("m", F.when(F.col("hot"), F.col("c")))
    return rows.sortWithinPartitions("m", "c", "d", "doc_id", "copy", "start").mapInArrow(lean(_compact), SPANS)


def removal_ranges(docs: DataFrame, width: int = 20, seed: int = 8) -> DataFrame:
    """__doc, __copy (as _numbered gives them), spans array<struct<start, n>>: the edges (width words each, n in a row from start) that occur earlier too."""
    texts = docs.select(F.col("__doc").alias("doc_id"), F.col("__copy").alias("copy"), "text")
    paths = lambda rows: rows.mapInArrow(lean(_paths(width, seed)), PATHS)
    some = paths(texts.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(HOT_EVERY)) == 0)).where("NOT dup")
    hot = some.groupBy("m").count().where(F.col("count") >= HOT_ROWS).orderBy(F.desc("count"), "m").limit(HOT_KEYS)
    found = stored(_met(paths(texts), stored(hot.select("m", F.lit(True).alias("hot")), "hot")), "paths")
    gather = lambda df: df.groupBy("doc_id", "copy").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    asked = gather(found.where("expand"))
    edges = texts.join(asked.hint("shuffle_merge"), ["doc_id", "copy"]).mapInArrow(lean(_expand(width)), PATHS)
    later = _met(edges, None).where("NOT expand")
    return gather(found.where("NOT expand").unionByName(later)).withColumnsRenamed({"doc_id": "__doc", "copy": "__copy"})


def _marked(offs: np.ndarray, spans: pa.Array, width: int) -> np.ndarray:
    """Which of the words lie in a range."""
    n_words = int(offs[-1])
    change = np.zeros(n_words + 1, np.int64)
    counts = spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = spans.flatten()
    if len(flat):
        doc = np.repeat(np.arange(len(spans)), counts)
        a = flat.field("start").to_numpy().astype(np.int64) + offs[doc]
        b = np.minimum(a + flat.field("n").to_numpy() + width - 1, offs[doc + 1])
        a = np.minimum(a, b)
        np.add.at(change, a, 1)
        np.add.at(change, b, -1)
    return np.cumsum(change)[:n_words] > 0


def _kept(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, int(whole.num_rows * (2 << 20) // max(2 << 20, whole.nbytes)))
            for b in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                raw, offsets, starts, ends, offs = word_places(b["text"])
                raw = raw.tobytes()
                gone = _marked(offs, b["spans"], width)
                removed = np.concatenate([[0], np.cumsum(gone)])
                digests = []
                for i in range(b.num_rows):
                    lo, hi = offs[i], offs[i + 1]
                    if removed[hi] == removed[lo]:
                        kept = b" ".join(raw[offsets[i] : offsets[i + 1]].split())
                    else:
                        keep = lo + np.flatnonzero(~gone[lo:hi])
                        kept = b" ".join([raw[x:y] for x, y in zip(starts[keep].tolist(), ends[keep].tolist())])
                    digests.append(hashlib.sha256(kept).hexdigest())
                yield pa.record_batch([b["doc_id"], pa.array(np.diff(offs).astype(np.int64)), pa.array((removed[offs[1:]] - removed[offs[:-1]]).astype(np.int64)), pa.array(digests, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def _with_ranges(docs: DataFrame, width: int, seed: int) -> DataFrame:
    rows = _numbered(docs)
    return rows.join(removal_ranges(rows, width, seed).hint("shuffle_merge"), ["__doc", "__copy"], "left")


def digests(docs: DataFrame, width: int = 20, seed: int = 8) -> DataFrame:
    """The contract's row for each document: doc_id, n_words, n_removed, kept_sha256."""
    both = _with_ranges(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), width, seed).select("doc_id", "text", "spans")
    return both.mapInArrow(lean(_kept(width)), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _cut_text(width: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, int(whole.num_rows * (2 << 20) // max(2 << 20, whole.nbytes)))
            for b in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                raw, offsets, starts, ends, offs = word_places(b["text"])
                raw = raw.tobytes()
                gone = _marked(offs, b["spans"], width)
                texts = b["text"].to_pylist()
                for i in np.flatnonzero(np.add.reduceat(np.append(gone, False), np.minimum(offs[:-1], len(gone))) * (np.diff(offs) > 0)):
                    lo, hi = offs[i], offs[i + 1]
                    keep = ~gone[lo:hi]
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], keep, [False]])))
                    runs = [raw[starts[lo + x] : ends[lo + y - 1]] for x, y in zip(edge[::2], edge[1::2])]
                    texts[i] = b"\n".join(runs).decode()
                yield pa.record_batch([pa.array(texts, pa.string()) if n == "text" else b[n] for n in names], names=names)

    return run


def without_repeats(docs: DataFrame, width: int = 20, seed: int = 8) -> DataFrame:
    """docs with repeated runs cut out of `text`; kept runs keep their own white space and are joined by a line end.

    All rows and columns stay; a text without repeats is left as it is, byte for byte; n_chars follows the text.
    """
    names = docs.columns
    clash = {n: f"__in_{i}" for i, n in enumerate(names) if n not in ("doc_id", "text")}
    joined = _with_ranges(docs.withColumnsRenamed(clash), width, seed)
    kept = [clash.get(n, n) for n in names]
    schema = ", ".join(f"`{n}` {t}" for n, t in joined.select(*kept).dtypes)
    out = joined.select(*kept, "spans").mapInArrow(lean(_cut_text(width, kept)), schema).withColumnsRenamed({v: k for k, v in clash.items()})
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
