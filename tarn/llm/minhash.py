"""Near-duplicate detection by an LSH forest over MinHash signatures, with links confirmed on the full shingle sets.

A document's set holds its distinct 5-word shingles (ASCII lower case); shorter documents have one shingle, their whole
word sequence; documents without words have an empty set and link with nothing. Two documents are linked if
100 * |A and B| >= percent * |A or B|; components of links share the smallest doc_id.

Method
1. Equal sets (a 128-bit BLAKE2 digest of the sorted shingles themselves) are linked to their smallest doc_id; one of
   them goes on.
2. The forest has as many trees as `shape` gives for percent. A tree orders documents by `DEEP` of their MinHash values;
   documents with a common prefix of `shallow` values are a region. In a region of at most `SMALL` members all pairs
   are candidates. In a larger one depth adapts: longest-common-prefix neighbours of the sorted order, each member with
   the first of every deeper prefix it lies in, and with the few members nearest to the region's consensus (the text
   the others were copied from, as a rule), so candidates stay in proportion to members. The order is dealt by ranges,
   so a region of any size is cut over tasks in pieces of at most `PIECE` rows; the pieces' first and nearest members
   (of a piece of at most `WHOLE` rows all) meet in a second pass.
   A sketch of two bits for each of the values discards candidates far below the threshold (over four standard
   deviations; `agreement`).
3. Candidates are joined with both texts and confirmed on the sets of their shingles, word for word; confirmed links
   give components.
4. Members of larger regions that ended in different components are compared again, each with every member of the
   other components in its region, so adaptive depth loses no link between them. A document whose set has too many
   shingles that none of the others has cannot link with any and is left out of this step, and a sketch of WIDE
   values (again over four standard deviations) keeps pairs below the threshold from being confirmed in vain. A region
   with more than `CELL` such members is dealt into blocks, and each pair of blocks is a task's work of its own.

At the threshold itself a pair shares no region in any tree with probability `MISS` at most, less above it.
Defined results: null doc_id: no part, no component, kept; rows that share a doc_id are one document with the union of
their links; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, as_long, lean, mixed, seeded, stored
from .graph import connected_components
from .words import digest128, joined, run_hashes, shingle_texts, word_hashes

K = 5
MISS, TREES, MOST_TREES, SHALLOW, DEEP = 7.5e-6, 16, 32, 4, 8
SMALL = 16
CENTRES = 4
PIECE, WHOLE = 8192, 64  # rows of a region that one task compares at most; rows of a piece that go on whole at most
CELL = 1024  # members in a block of the last step, about
SKETCH_SD = 4.93  # how many standard deviations below the expected agreement at the threshold a sketch may be
WIDE, WIDE_SD = 1024, 4.5  # the longer sketch of the last step
BROADCAST_IDS = 2_000_000  # document ids broadcast at most: 16 MB
SETS = "doc_id long, n_shingles long, s1 long, s2 long, sig binary"


def shape(percent: int) -> tuple[int, int]:
    """(trees, shallow): trees of which a pair at the threshold shares no region with probability MISS at most."""
    for shallow in range(SHALLOW, 0, -1):
        apart = 1 - min(0.99, percent / 100) ** shallow
        trees = math.ceil(math.log(MISS) / math.log(apart))
        if trees <= MOST_TREES:
            break
    return max(TREES, trees), shallow  # 85: 16 trees of 4 values, 80: 23 of 4


def agreement(percent: int, values: int, deviations: float) -> float:
    """Least share of equal 2-bit values: so many standard deviations below the one expected at the threshold."""
    expected = percent / 100 + (1 - percent / 100) / 4
    return expected - deviations * math.sqrt(expected * (1 - expected) / values)


def _texts(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    for b in batches:
        step = max(1, int(b.num_rows * limit // max(limit, b.nbytes)))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of the texts, flat, and n + 1 offsets."""
    h, offs = word_hashes(column, lower=True)
    counts = np.diff(offs)
    runs = run_hashes(h, K)
    n = np.where(counts >= K, counts - K + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(n)), n)
    a = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + offs[doc]
    at = np.concatenate([[0], np.cumsum(n)])
    whole = counts[doc] >= K
    s = np.zeros(len(doc), U64)
    s[whole] = runs[a[whole]]
    few, first = np.flatnonzero(~whole), a[~whole]
    s[few] = h[first]
    for j in range(1, K - 1):  # a text of under K words: all its words
        more = counts[doc[few]] > j
        few, first = few[more], first[more]
        s[few] = joined(s[few], h[first + j])
    for i in range(len(n)):
        s[at[i] : at[i + 1]].sort()
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    return s[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(n)))]).astype(np.int64)


def _signatures(s: np.ndarray, offs: np.ndarray, hashes: int) -> np.ndarray:
    """uint32 (texts, hashes); texts with an empty set get zeros."""
    mul, add = seeded(hashes, 2) | U64(1), seeded(hashes, 3)
    out = np.zeros((len(offs) - 1, hashes), np.uint32)
    some = np.flatnonzero(np.diff(offs))
    if len(some):
        for j in range(hashes):
            out[some, j] = np.minimum.reduceat(((s * mul[j] + add[j]) >> U64(32)).astype(np.uint32), offs[some])
    return out


def _sets(hashes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _texts(batches, 2 << 20):
            sig = _signatures(*shingle_sets(b["text"]), hashes)
            sizes, sorted_sets = [], []
            for own in shingle_texts(b["text"], K):
                sizes.append(len(own))
                sorted_sets.append(b"\n".join(sorted(own)))  # no word holds a line end
            both = digest128(sorted_sets)
            yield pa.record_batch([b["doc_id"], pa.array(sizes, pa.int64()), as_long(both[:, 0].copy()), as_long(both[:, 1].copy()), pa.array([x.tobytes() for x in sig], pa.binary())], names=["doc_id", "n_shingles", "s1", "s2", "sig"])

    return run


FOREST = "region long, deep binary, doc_id long, n int, sketch binary"


def _forest(trees: int, shallow: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
                sig = np.frombuffer(b"".join(b["sig"].to_pylist()), np.uint32).reshape(-1, trees * DEEP)
                two = (sig & 3).astype(np.uint8)
                sketch = [x.tobytes() for x in (two[:, 0::4] | two[:, 1::4] << 2 | two[:, 2::4] << 4 | two[:, 3::4] << 6)]
                n = pc.cast(b["n_shingles"], pa.int32())
                for t in range(trees):
                    part = np.ascontiguousarray(sig[:, t * DEEP : (t + 1) * DEEP])
                    key = np.full(len(part), U64(t + 1))
                    for j in range(shallow):
                        key = mixed(key * U64(0x9E3779B97F4A7C15) + part[:, j])
                    deep = [x.tobytes() for x in part[:, shallow:].astype(">u4")]
                    yield pa.record_batch([as_long(key), pa.array(deep, pa.binary()), b["doc_id"], n, pa.array(sketch, pa.binary())], names=["region", "deep", "doc_id", "n", "sketch"])

    return run


def _regions(batches: Iterator[pa.RecordBatch], key: str = "region", whole: bool = False) -> Iterator[tuple[pa.Table, bool, bool]]:
    """Rows sorted by key, in tables of about PIECE rows, and whether the first and the last region may go on outside.

    A region of more rows is cut into pieces, unless `whole`; the first and the last region of a task's rows may go on
    in other tasks.
    """
    held, rows, enough, cut_off = [], 0, PIECE, True
    for given in batches:
        for b in (given.slice(i, PIECE) for i in range(0, given.num_rows, PIECE)):
            held.append(b)
            rows += b.num_rows
            if rows < enough:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            k = t[key].to_numpy()
            cut = int(np.searchsorted(k, k[-1], "left"))
            if cut:
                yield t.slice(0, cut).combine_chunks(), cut_off, False
                held, rows, enough, cut_off = t.slice(cut).to_batches(), t.num_rows - cut, PIECE, False
            elif whole:
                held, enough = t.to_batches(), 2 * rows
            else:
                yield t, True, True
                held, rows, cut_off = [], 0, True
    if rows:
        yield pa.Table.from_batches(held).combine_chunks(), cut_off, True


_AGREE = np.array([sum((x >> s) & 3 == 0 for s in (0, 2, 4, 6)) for x in range(256)], np.uint8)


def _close(sketch: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int, deviations: float = SKETCH_SD) -> np.ndarray:
    least = agreement(percent, 4 * sketch.shape[1], deviations)
    keep = np.zeros(len(i), bool)
    for lo in range(0, len(i), 16384):
        a, b = i[lo : lo + 16384], j[lo : lo + 16384]
        agree = _AGREE[sketch[a] ^ sketch[b]].sum(1, dtype=np.int32)
        keep[lo : lo + 16384] = (agree >= least * 4 * sketch.shape[1]) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
    return keep


def _central(sketch: np.ndarray) -> np.ndarray:
    """The CENTRES rows that agree most with the commonest value of every place."""
    two = np.stack([(sketch >> s) & 3 for s in (0, 2, 4, 6)], axis=2).reshape(len(sketch), -1)
    commonest = np.argmax([(two == v).sum(0) for v in range(4)], axis=0)
    return np.argsort(-(two == commonest).sum(1), kind="stable")[:CENTRES]


#: What a row of _candidates is: a pair, a member of a region not compared in full, a member or a representative of a piece.
PAIR, MEMBER, PART, HEAD = range(4)
PAIRS = "kind int, a long, b long, region long, deep binary, doc_id long, n int, sketch binary"
_PAIR_SCHEMA = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("region", pa.int64()), ("deep", pa.binary()), ("doc_id", pa.int64()), ("n", pa.int32()), ("sketch", pa.binary())])


def _pair_rows(ids, i, j):
    a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
    ok = a != b
    a, b = a[ok], b[ok]
    if len(a):
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        a, b = a[new], b[new]
    none = pa.nulls(len(a))
    return pa.record_batch([pa.array(np.full(len(a), PAIR, np.int32)), pa.array(a), pa.array(b), *(none.cast(f.type) for f in list(_PAIR_SCHEMA)[3:])], schema=_PAIR_SCHEMA)


def _member_rows(t: pa.Table, rows: np.ndarray, kind: int):
    part, none = t.take(pa.array(rows)), pa.nulls(len(rows), pa.int64())
    out = [pa.array(np.full(len(rows), kind, np.int32)), none, none, *(part[c] for c in ("region", "deep", "doc_id", "n", "sketch"))]
    return pa.table(out, schema=_PAIR_SCHEMA).to_batches()


def _candidates(percent: int, second: bool = False):
    """Forest rows sorted by (region, deep, doc_id) -> candidate pairs and members; in the second pass regions are whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, open_first, open_last in _regions(batches, whole=second):
            key = t["region"].to_numpy()
            head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(head, len(key)))
            goes_on = np.zeros(len(head), bool)
            if not second:
                goes_on[0], goes_on[-1] = open_first, goes_on[-1] | open_last
            # a small piece goes on whole, a single row is nobody's neighbour
            whole = goes_on & (size <= WHOLE)
            yield from _member_rows(t, np.flatnonzero(np.repeat(whole, size)), PART)
            use = ~whole & (size > 1) | (np.add.reduceat(t["kind"].to_numpy() == HEAD, head) > 0 if second else False)
            t = t.filter(pa.array(np.repeat(use, size))).combine_chunks()
            if not t.num_rows:
                continue
            size, goes_on = size[use], goes_on[use]
            head = np.cumsum(size) - size
            key, ids, n = t["region"].to_numpy(), t["doc_id"].to_numpy(), t["n"].to_numpy().astype(np.int64)
            sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(len(key), -1)
            deep = np.frombuffer(b"".join(t["deep"].to_pylist()), ">u4").reshape(len(key), -1)
            of = np.repeat(np.arange(len(head)), size)
            place = np.arange(len(key)) - head[of]
            small = size[of] <= SMALL
            i, j = [], []
            for step in range(1, SMALL):  # all pairs of small regions
                a = np.flatnonzero(small & (place + step < size[of]))
                i.append(a), j.append(a + step)
            big, heads = np.flatnonzero(~small), []
            if len(big):
                a = big[place[big] > 0]
                i.append(a - 1), j.append(a)  # neighbours in the sorted order
                start = head[of]
                i.append(start[a]), j.append(a)  # the first of the region
                same = key[1:] == key[:-1]
                for d in range(deep.shape[1]):  # the first of every deeper prefix
                    same = same & (deep[1:, d] == deep[:-1, d])
                    start = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(len(key)), 0))
                    b = big[start[big] < big]
                    i.append(start[b]), j.append(b)
                for r in np.flatnonzero(size > SMALL):  # the members nearest to the region's consensus
                    members = np.arange(head[r], head[r] + size[r])
                    central = members[_central(sketch[members])]
                    for x in central:
                        i.append(np.full(len(members), x)), j.append(members)
                    if goes_on[r]:
                        heads.append(np.unique(np.append(central, members[0])))
            i, j = np.concatenate(i), np.concatenate(j)
            keep = _close(sketch, n, i, j, percent)
            yield _pair_rows(ids, i[keep], j[keep])
            if heads:
                yield from _member_rows(t, np.concatenate(heads), HEAD)
            if second:  # representatives stand for members that were not compared with one another
                big = np.flatnonzero((np.add.reduceat(t["kind"].to_numpy() == HEAD, head) > 0)[of] | ~small)
            yield from _member_rows(t, big, MEMBER)

    return run


def _wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two bits of each of WIDE MinHash values."""
    mul, add = seeded(WIDE, 4) | U64(1), seeded(WIDE, 6)
    for b in _texts(batches, 1 << 20):
        s, offs = shingle_sets(b["text"])
        two = np.zeros((b.num_rows, WIDE), np.uint8)
        some = np.flatnonzero(np.diff(offs))
        if len(some):
            for j in range(WIDE):
                two[some, j] = np.minimum.reduceat(s * mul[j] + add[j], offs[some]) >> U64(20) & U64(3)
        sketch = two[:, 0::4] | two[:, 1::4] << 2 | two[:, 2::4] << 4 | two[:, 3::4] << 6
        yield pa.record_batch([b["doc_id"], pa.array([x.tobytes() for x in sketch], pa.binary())], names=["doc_id", "sketch"])


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _texts(batches):
        s, offs = shingle_sets(b["text"])
        ids = np.repeat(b["doc_id"].to_numpy(), np.diff(offs))
        for lo in range(0, len(s), 65536):
            yield pa.record_batch([pa.array(ids[lo : lo + 65536]), as_long(s[lo : lo + 65536])], names=["doc_id", "s"])


def _between(percent: int):
    """Rows (cell, side, component, doc_id, n, common, sketch) sorted by cell -> candidate pairs between components of a cell.

    A cell is a region, or a pair of blocks of one: then the blocks are its sides, and only pairs across are taken.
    common: how many of the n shingles occur in any other of these documents; an intersection is no larger.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _, _ in _regions(batches, "cell", True):
            key, ids, n, comp, side, common = (t[c].to_numpy() for c in ("cell", "doc_id", "n", "component", "side", "common"))
            n = n.astype(np.int64)
            sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(len(key), -1)
            head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            for lo, hi in zip(head, np.append(head[1:], len(key))):
                _, inverse, count = np.unique(comp[lo:hi], return_inverse=True, return_counts=True)
                if len(count) < 2:
                    continue
                rank = np.argsort(np.argsort(count, kind="stable"))[inverse]
                across = len(np.unique(side[lo:hi])) > 1
                for x in np.flatnonzero(rank < rank.max()):
                    # smaller components look at larger ones, each pair once
                    ok = rank > rank[x]
                    if across:
                        ok &= side[lo:hi] != side[lo + x]
                    j = lo + np.flatnonzero(ok)
                    most = np.minimum(common[lo + x], common[j])
                    j = j[100 * most >= percent * (n[lo + x] + n[j] - most)]
                    i = np.full(len(j), lo + x)
                    keep = _close(sketch, n, i, j, percent, WIDE_SD)
                    if keep.any():
                        yield _pair_rows(ids, i[keep], j[keep])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _texts(batches, 2 << 20):
            a_ids = b["a"].to_numpy()
            new = np.ones(len(a_ids), bool)
            text_a = b["text_a"].fill_null("")
            # rows that share a doc_id may hold different texts: each is a left side of its own
            new[1:] = (a_ids[1:] != a_ids[:-1]) | pc.not_equal(text_a[1:], text_a[:-1]).to_numpy(zero_copy_only=False)
            lefts, ok, x = shingle_texts(text_a.filter(pa.array(new)), K), [], set()
            for fresh, y in zip(new.tolist(), shingle_texts(b["text_b"], K)):
                if fresh:
                    x = next(lefts)
                both = len(x & y)
                ok.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            ok = pa.array(ok, pa.bool_())
            yield pa.record_batch([b["a"].filter(ok), b["b"].filter(ok)], names=["a", "b"])

    return run


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int, name: str) -> DataFrame:
    """Links among the pairs (a stored table); only texts of documents in a pair are shuffled."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    ids = stored(ids, f"{name}-ids")
    some = texts.join(_few(ids, "shuffle_merge"), texts.doc_id == F.col("id"), "left_semi")
    right = some.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    left = some.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    both = pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a").select("a", "b", "text_a", "text_b")
    return stored(both.mapInArrow(lean(_confirm(percent)), "a long, b long"), name)


def _few(table: DataFrame, otherwise: str) -> DataFrame:
    """A stored table marked for broadcast where it has at most BROADCAST_IDS rows, else for another join."""
    return F.broadcast(table) if table.count() <= BROADCAST_IDS else table.hint(otherwise)


def _mixed(members: DataFrame) -> DataFrame:
    """Members (region, component, ...) of regions with more than one component, and how many members those have."""
    regions = members.groupBy("region").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("members")).where("x < y")
    return members.join(_few(stored(regions.select("region", "members"), "regions"), "merge"), "region")


def components(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    sets = stored(texts.mapInArrow(lean(_sets(shape(percent)[0] * DEEP)), SETS), "sets")
    full = sets.where("doc_id IS NOT NULL AND n_shingles > 0")
    group = ["s1", "s2", "n_shingles"]
    reps = stored(full.groupBy(*group).agg(F.min("doc_id").alias("rep")), "classes")
    copies = full.select(*group, "doc_id").join(reps.hint("merge"), group).where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    copies = stored(copies, "copies")
    # one row for each class; sets of under six shingles that differ are never similar enough at 0.85, of under four at 0.8
    least = 1 if percent < 80 else 100 // (100 - percent) - 1
    heads = full.where(F.col("n_shingles") >= max(1, least)).join(reps.select(*group, F.col("rep").alias("doc_id")).hint("merge"), [*group, "doc_id"], "left_semi").dropDuplicates(["doc_id", *group])
    forest = heads.select("doc_id", "n_shingles", "sig").mapInArrow(lean(_forest(*shape(percent))), FOREST)
    found = stored(forest.repartitionByRange("region", "deep", "doc_id").sortWithinPartitions("region", "deep", "doc_id").mapInArrow(lean(_candidates(percent)), PAIRS), "candidates")
    pieces = found.where(F.col("kind").isin(PART, HEAD)).select("kind", "region", "deep", "doc_id", "n", "sketch")
    found = found.unionByName(stored(pieces.repartition("region").sortWithinPartitions("region", "deep", "doc_id").mapInArrow(lean(_candidates(percent, True)), PAIRS), "pieces"))
    pairs = stored(found.where(F.col("kind") == PAIR).select("a", "b").distinct(), "pairs")
    # a document in several rows: take each text once
    once = texts.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"]) if texts.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").take(1) else texts
    links = copies.unionByName(_confirmed(pairs, once, percent, "links"))
    labels = connected_components(links)
    crowded = found.where(F.col("kind") == MEMBER).select("region", "doc_id", "n")
    if crowded.take(1):
        labels = stored(labels, "labels")
        marked = crowded.distinct().join(labels.withColumnRenamed("node", "doc_id").hint("merge"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        again = stored(_mixed(marked).drop("members"), "mixed")
        ids = stored(again.select(F.col("doc_id").alias("id")).distinct(), "mixed-ids")
        some = once.join(_few(ids, "shuffle_merge"), once.doc_id == F.col("id"), "left_semi")
        own = some.mapInArrow(lean(_shingles), "doc_id long, s long").groupBy("s").agg(F.count("*").alias("df"), F.min("doc_id").alias("doc_id")).where("df = 1").groupBy("doc_id").agg(F.count("*").alias("own"))
        again = again.join(own.hint("merge"), "doc_id", "left").withColumn("common", F.col("n") - F.coalesce("own", F.lit(0))).drop("own")
        # even inside a document of the same common part
        able = stored(_mixed(stored(again.where(F.col("common") * 100 >= F.col("n") * percent), "able")), "split")
        wide = some.join(_few(stored(able.select(F.col("doc_id").alias("id")).distinct(), "able-ids"), "shuffle_merge"), F.col("doc_id") == F.col("id"), "left_semi").mapInArrow(lean(_wide), "doc_id long, sketch binary")
        blocks = F.ceil(F.col("members") / CELL).cast("int")
        able = able.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
        able = able.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        cell = F.xxhash64("region", F.least("own", "other"), F.greatest("own", "other"))
        able = able.select("doc_id", "n", "common", "component", cell.alias("cell"), (F.col("own") > F.col("other")).cast("int").alias("side"))
        cells = able.join(wide.hint("merge"), "doc_id").repartition("cell").sortWithinPartitions("cell", "doc_id")
        more = stored(cells.mapInArrow(lean(_between(percent)), PAIRS).select("a", "b").distinct().join(pairs.hint("merge"), ["a", "b"], "left_anti"), "more")
        if more.take(1):
            # components so far are stars; new links join them
            links = labels.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(_confirmed(more, once, percent, "links2"))
            labels = connected_components(links)
    out = sets.select("doc_id", "n_shingles").join(labels.withColumnRenamed("node", "doc_id").hint("merge"), "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, percent: int = 85) -> DataFrame:
    """docs without the rows whose component has a smaller doc_id; all columns stay. Rows with a null doc_id stay."""
    gone = components(docs, percent).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone.hint("shuffle_merge"), F.col("doc_id").cast("long") == F.col("__gone"), "left_anti")
