"""Language identification by a byte convolutional network, trained here in numpy.

Bytes are embedded; filters of several widths run over them, each filter's largest value in a window is taken, and a
softmax layer turns these into languages. Training uses fixed windows of a bounded sample of labelled documents
(`SAMPLE` documents of each language, by hash of doc_id, from the training folds, and of each `SAMPLE_WINDOWS` windows,
drawn by hash from its whole text; every label is a language). For prediction the whole text is cut into windows of `WINDOW` bytes and the probabilities are
averaged by window length; no filter runs over a window's end. A filter over two bytes is one table row, so a window costs a few gathers a byte.

Defined results: null text or no letter: `und`, score 0; with no labelled rows at all every prediction is `und`; texts
of under four bytes use the positions they have. Predictions read the text alone.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, text_buffers

WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 16, 8
SAMPLE, SAMPLE_WINDOWS = 400, 8
STEPS, BATCH, RATE, SEED = 600, 64, 0.01, 7
BLOCK = 512 * WINDOW  # bytes scored at once; longer texts are cut at window borders
FOLDS = 5
_LETTER = re.compile(r"[^\W\d_]")


class Network:
    def __init__(self, labels: list[str]):
        rng = np.random.default_rng(SEED)
        self.labels = labels
        self.p = {"e": rng.normal(0, 0.5, (256, EMBED))}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p["o"] = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(labels)))
        self.p["c"] = np.zeros(len(labels))

    def train(self, windows: np.ndarray, y: np.ndarray) -> None:
        """windows uint8 (n, WINDOW), y label numbers; Adam on the cross-entropy."""
        rng = np.random.default_rng(SEED + 1)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for t in range(1, STEPS + 1):
            pick = rng.integers(0, len(y), BATCH)
            g = self._gradients(windows[pick], y[pick])
            rate = RATE * (1 - t / (STEPS + 1))
            for k in self.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                self.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(x)
        pooled, places = [], []
        embedded = p["e"][x]
        for w in WIDTHS:
            size = x.shape[1] - w + 1
            conv = sum(embedded[:, o : o + size] @ p[f"w{w}"][o * EMBED : (o + 1) * EMBED] for o in range(w))
            at = conv.argmax(1)
            places.append(at)
            pooled.append(np.take_along_axis(conv, at[:, None, :], 1)[:, 0] + p[f"b{w}"])
        h = np.concatenate(pooled, 1)
        a = np.maximum(h, 0)
        z = a @ p["o"] + p["c"]
        z = np.exp(z - z.max(1, keepdims=True))
        d = z / z.sum(1, keepdims=True)
        d[np.arange(n), y] -= 1
        d /= n
        g = {k: np.zeros_like(q) for k, q in p.items()}
        g["o"], g["c"] = a.T @ d + 1e-4 * p["o"], d.sum(0)
        back = (d @ p["o"].T) * (h > 0)
        for i, w in enumerate(WIDTHS):
            own = back[:, i * FILTERS : (i + 1) * FILTERS]
            g[f"b{w}"] = own.sum(0)
            for o in range(w):
                bytes_at = np.take_along_axis(x, places[i] + o, 1)  # (n, FILTERS)
                rows = p[f"w{w}"][o * EMBED : (o + 1) * EMBED]
                g[f"w{w}"][o * EMBED : (o + 1) * EMBED] = np.einsum("nf,nfe->ef", own, p["e"][bytes_at])
                np.add.at(g["e"], bytes_at, own[:, :, None] * rows.T[None])
        return g

    def tables(self) -> dict:
        """For prediction: one row of filter sums for each pair of bytes (and for the third byte of width three)."""
        one = {(w, o): (self.p["e"] @ self.p[f"w{w}"][o * EMBED : (o + 1) * EMBED]).astype(np.float32) for w in WIDTHS for o in range(w)}
        pair = {(w, o): (one[w, o][:, None] + one[w, o + 1][None]).reshape(65536, FILTERS) for w in WIDTHS for o in range(0, w - 1, 2)}
        return {"one": one, "pair": pair}

    def probabilities(self, raw: np.ndarray, offsets: np.ndarray, tables: dict) -> np.ndarray:
        """(texts, labels): mean over the text's windows, weighted by their bytes. Empty texts get zeros."""
        lens = np.diff(offsets)
        out = np.zeros((len(lens), len(self.labels)))
        if not len(raw):
            return out
        counts = -(-lens // WINDOW)
        doc = np.repeat(np.arange(len(lens)), counts)
        begin = offsets[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)) * WINDOW
        size = np.minimum(begin + WINDOW, offsets[doc + 1]) - begin
        wide = np.concatenate([raw, np.zeros(4, np.uint8)])
        pairs = wide[:-1].astype(np.uint16) << 8 | wide[1:]
        pooled = []
        for w in WIDTHS:
            conv = np.take(tables["pair"][w, 0], pairs[: len(raw)], axis=0)
            for o in range(2, w, 2):
                conv += np.take(tables["pair"][w, o], pairs[o : o + len(raw)], axis=0) if o + 1 < w else np.take(tables["one"][w, o], wide[o : o + len(raw)], axis=0)
            for back in range(1, w):  # positions that would run over a window's end, as in training
                at = begin + size - back
                conv[at[at >= begin]] = -np.inf
            pooled.append(np.maximum.reduceat(conv, begin, axis=0) + self.p[f"b{w}"].astype(np.float32))
        h = np.maximum(np.concatenate(pooled, 1), 0)
        z = h @ self.p["o"] + self.p["c"]
        z = np.exp(z - z.max(1, keepdims=True))
        z /= z.sum(1, keepdims=True)
        np.add.at(out, doc, z * size[:, None])
        return out / np.maximum(lens, 1)[:, None]


def fold(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of SAMPLE_WINDOWS windows of each text, drawn by hash from all of it, as a list."""
    for b in batches:
        out = []
        for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
            raw = text.encode()
            n = -(-len(raw) // WINDOW)
            at = np.random.default_rng([SEED, zlib.crc32(str(doc_id).encode())]).permutation(n)[:SAMPLE_WINDOWS] if n > SAMPLE_WINDOWS else range(n)
            out.append([raw[k * WINDOW : (k + 1) * WINDOW] for k in sorted(at)])
        yield pa.record_batch([b["doc_id"], b["lang"], pa.array(out, pa.list_(pa.binary()))], names=["doc_id", "lang", "windows"])


def fitted(docs: DataFrame) -> Network:
    """A network trained on a bounded sample of labelled rows outside fold 0 (windows of at most 2 * SAMPLE documents a label on the driver)."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (fold() != 0)).select("doc_id", "text", "lang")
    counts = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not counts:
        return Network([])
    chance = F.broadcast(docs.sparkSession.createDataFrame([(r["lang"], min(1.0, 1.2 * SAMPLE / r["count"])) for r in counts], "lang string, chance double"))
    part = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1_000_000)) / 1_000_000.0
    rows = labelled.join(chance, "lang").where(part < F.col("chance")).select("doc_id", "text", "lang").limit(2 * SAMPLE * len(counts))
    types = dict(rows.dtypes)
    rows = rows.mapInArrow(lean(_windows), f"doc_id {types['doc_id']}, lang string, windows array<binary>").collect()
    rows.sort(key=lambda r: (r.lang, zlib.crc32(str(r.doc_id).encode()), r.doc_id, r.windows))
    net = Network([r["lang"] for r in counts])
    number, taken = {x: i for i, x in enumerate(net.labels)}, {}
    windows, y = [], []
    for r in rows:
        if not r.windows or taken.get(r.lang, 0) >= SAMPLE:
            continue
        taken[r.lang] = taken.get(r.lang, 0) + 1
        for w in r.windows:
            # short windows repeat themselves, so padding is no clue
            windows.append(np.resize(np.frombuffer(w, np.uint8), WINDOW))
            y.append(number[r.lang])
    if windows:
        net.train(np.stack(windows), np.array(y))
    return net


def _predict(net: Network, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables()
        for whole in batches:
            step = max(1, int(whole.num_rows * (1 << 20) // max(1 << 20, whole.nbytes)))
            for b in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                raw, offsets = text_buffers(b["text"])
                p = np.zeros((b.num_rows, max(1, len(net.labels))))
                lo = 0
                while lo < b.num_rows and net.labels:  # texts together up to a block, longer ones in parts
                    hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + BLOCK, "right")) - 1)
                    a, z = int(offsets[lo]), int(offsets[hi])
                    if hi > lo + 1 or z - a <= BLOCK:
                        p[lo:hi] = net.probabilities(raw[a:z], offsets[lo : hi + 1] - a, tables)
                    else:
                        for x in range(a, z, BLOCK):
                            y = min(x + BLOCK, z)
                            p[lo] += net.probabilities(raw[x:y], np.array([0, y - x]), tables)[0] * ((y - x) / (z - a))
                    lo = hi
                best = p.argmax(1)
                known = [bool(net.labels) and t is not None and _LETTER.search(t) is not None for t in b["text"].to_pylist()]
                lang = [net.labels[k] if ok else "und" for k, ok in zip(best.tolist(), known)]
                score = np.where(known, np.clip(p[np.arange(len(p)), best], 0, 1), 0.0)
                yield pa.record_batch([*(b[n] for n in names), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])

    return run


def predicted(docs: DataFrame, net: Network) -> DataFrame:
    """docs with lang_pred and score (columns of these names are replaced)."""
    docs = docs.drop("lang_pred", "score")
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    return docs.mapInArrow(lean(_predict(net, docs.columns)), f"{schema}, lang_pred string, score double")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; a null doc_id is not held out."""
    net = fitted(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "text")
    return predicted(rows, net).drop("text")


CLEAR = 1.6  # how many even shares of the learned languages a clear language has


def in_known_language(docs: DataFrame, least: float | None = None) -> DataFrame:
    """docs whose text has letters and a language predicted with at least this score; columns as they were.

    The score asked for follows from the number of languages learned: CLEAR times an even share, of four at least (0.4
    for four of them). A text of several languages keeps a winner above that; what goes is text without letters and text
    that the network finds hardly more like one language than another.
    """
    net = fitted(docs)
    least = CLEAR / max(4, len(net.labels)) if least is None else least
    clash = {n: f"__in_{n}" for n in docs.columns if n in ("lang_pred", "score")}
    out = predicted(docs.withColumnsRenamed(clash), net).where((F.col("lang_pred") != "und") & (F.col("score") >= least)).drop("lang_pred", "score")
    return out.withColumnsRenamed({v: k for k, v in clash.items()})
