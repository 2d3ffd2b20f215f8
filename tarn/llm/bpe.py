"""Byte-level BPE: encoding by batched numpy merge rounds, decoding by gathering token bytes.

A batch of texts is cut into pre-tokens at once, by the classes of its code points (letters, numbers, white space, other)
and the rules of the vocabulary's pattern. The different pre-tokens of the batch are encoded together: their bytes become
symbols in one flat array. In every round each word's lowest-rank pair is found by binary search over the sorted pair
keys, all its occurrences in the word (left to right where they overlap) are merged, and words without a known pair
leave. Nothing is remembered between batches, so a worker holds the vocabulary and one batch.

Pre-tokens are grouped by 64-bit hashes; each is then compared with its group's first, byte for byte, and stands alone
where it differs. Defined results: a null text is empty and gives no ids; added special tokens written in a text are
single ids, as the vocabulary file says; every valid text decodes to itself.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import U64, lean, text_buffers
from .words import hashes_at

VOCABULARY = "byte_bpe_50k.json"
BATCH_BYTES = 2 << 20  # texts encoded together
_OTHER, _LETTER, _NUMBER, _SPACE, _SPECIAL = range(5)
_NONE, _END = np.int32(2**31 - 2), np.int32(2**31 - 1)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """A vocabulary file of the tokenizers library with a byte-level BPE model."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = _byte_letters(), spec["model"]["vocab"]
        self.pieces: list[bytes] = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for token, i in vocab.items():
            self.pieces[i] = bytes(letters[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.pieces[i] = token.encode()
        self.first = np.zeros(256, np.int32)
        for letter, b in letters.items():
            self.first[b] = vocab[letter]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int32)
        order = np.argsort(keys, kind="stable")
        order = order[np.concatenate([[True], np.diff(keys[order]) != 0])]  # of equal pairs the first counts
        self.keys, self.rank, self.made = keys[order], order.astype(np.int32), made  # made goes by rank
        two = np.arange(1 << 16)  # pairs of two bytes, so the first round needs no search
        self.byte_rank = self._ranks(self.first[two >> 8], self.first[two & 0xFF])
        every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
        self.kind = np.zeros(0x110000, np.uint8)  # class of each code point
        for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
            for m in regex.finditer(pattern, every):
                lo, hi = ord(every[m.start()]), ord(every[m.end() - 1]) + 1
                self.kind[lo:hi] = kind
        self.kind[0xD800:0xE000] = _OTHER

    def merge_rounds(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens (their bytes, flat, and n + 1 offsets; none is empty), flat, and how many each has."""
        counts, done = np.zeros(len(offs) - 1, np.int64), []
        symbols, head, word = self.first[raw], offs[:-1], np.arange(len(offs) - 1)
        # the rank of each symbol's pair with the next one: _NONE if it is no pair, _END at a word's last symbol
        rank = np.append(self.byte_rank[raw[:-1].astype(np.int32) << 8 | raw[1:]], _END)
        rank[offs[1:] - 1] = _END
        while len(word):
            size = np.diff(np.append(head, len(symbols)))
            lowest = np.minimum.reduceat(rank, head)
            over = lowest >= _NONE
            run = np.flatnonzero(rank == np.repeat(np.where(over, np.int32(-1), lowest), size))
            if 4 * int(size[over].sum()) > len(symbols) or not len(run):  # words without a known pair leave
                gone = np.repeat(over, size)
                counts[word[over]] = size[over]
                done.append((word[over], symbols[gone]))
                symbols, rank, word = symbols[~gone], rank[~gone], word[~over]
                head = np.cumsum(size[~over]) - size[~over]
                continue
            beside = np.diff(run) == 1
            if beside.any():  # of overlapping occurrences every other one, from the left
                lead = np.maximum.accumulate(np.where(np.append(True, ~beside), np.arange(len(run)), 0))
                run = run[(np.arange(len(run)) - lead) % 2 == 0]
            symbols[run] = self.made[rank[run]]
            rank[run] = rank[run + 1]
            keep = np.ones(len(symbols), bool)
            keep[run + 1] = False
            symbols, rank = symbols[keep], rank[keep]
            head = head - np.searchsorted(run, head)
            now = run - np.arange(len(run))
            near = np.concatenate([now, now[now > 0] - 1])
            near = near[rank[near] != _END]
            rank[near] = self._ranks(symbols[near], symbols[near + 1])
        ends, flat = np.cumsum(counts), np.zeros(int(counts.sum()), np.int32)
        for who, said in done:
            own = counts[who]
            flat[np.arange(len(said)) + np.repeat(ends[who] - np.cumsum(own), own)] = said
        return flat, counts

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols, by binary search over the sorted pair keys."""
        key = left.astype(np.int64) << 32 | right
        found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[found] == key, self.rank[found], _NONE)

    def _special_places(self, raw: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, end, id) of added tokens inside the texts, leftmost first, the longer of two at one place."""
        whole, found = raw.tobytes(), []
        for token, i in self.special.items():
            said = token.encode()
            at = whole.find(said)
            while at >= 0:
                text = np.searchsorted(offsets, at, "right") - 1
                if at + len(said) <= offsets[text + 1]:
                    found.append((at, -len(said), i))
                at = whole.find(said, at + 1)
        out, end = [], 0
        for at, size, i in sorted(found):
            if at >= end:
                end = at - size
                out.append((at, end, i))
        return out

    def pre_tokens(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """Byte starts of the pre-tokens of the texts, which they fill without gaps; n + 1 offsets of texts; added tokens."""
        at = np.flatnonzero((raw & 0xC0) != 0x80)
        code = raw[at].astype(np.uint32)
        for bits, mask, more in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
            some = np.flatnonzero((code >= bits) & (code < (0xE0, 0xF0, 0x100)[more - 1]) & (at + more < len(raw) + 0))
            value = (raw[at[some]] & mask).astype(np.uint32)
            for j in range(1, more + 1):
                value = value << 6 | (raw[at[some] + j] & 0x3F)
            code[some] = value | 0x80000000  # done; first bytes of other lengths are still to come
        code &= 0x7FFFFFFF
        kind = self.kind[code]
        opens = np.zeros(len(at) + 1, bool)  # where no pre-token crosses: texts and added tokens
        opens[np.searchsorted(at, offsets)] = True
        special = self._special_places(raw, offsets) if self.special else []
        for lo, hi, _ in special:
            x, y = np.searchsorted(at, (lo, hi))
            kind[x:y] = _SPECIAL
            opens[x] = opens[y] = True
        mark = opens.copy()
        mark[1:-1] |= kind[1:] != kind[:-1]
        mark[-1] = True
        if len(at):
            run = np.flatnonzero(mark)
            begin, end = run[:-1], run[1:]
            what, inner = kind[begin], ~opens[end]  # inner: the text goes on after the run
            # of white space before something else the last character stands apart; a space joins what follows
            last = end[(what == _SPACE) & inner]
            joins = last[code[last - 1] == 32]
            mark[last - 1] = True
            mark[joins] = False
            # an apostrophe of its own run takes s, t, m, d, re, ve or ll of the letters behind it
            quote = np.flatnonzero((what == _OTHER) & inner & (end - begin == 1) & (code[begin] == 39) & mark[begin])
            quote = quote[what[np.minimum(quote + 1, len(what) - 1)] == _LETTER]
            a, stop = end[quote], end[quote + 1] if len(quote) else end[:0]
            c1 = code[a]
            c2 = np.where(a + 1 < stop, code[np.minimum(a + 1, len(code) - 1)], 0)
            one = np.isin(c1, [ord(c) for c in "stmd"])
            two = ((c1 == ord("r")) & (c2 == ord("e"))) | ((c1 == ord("v")) & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l")))
            for hit, size in ((one, 1), (two, 2)):
                mark[a[hit]] = False
                mark[a[hit] + size] = True
        starts = at[np.flatnonzero(mark[:-1])]
        return starts, np.searchsorted(starts, offsets, "left"), special

    def words(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the different pre-tokens of the texts, flat, and their offsets; which of them stands at each place; offsets of texts."""
        raw, offsets = text_buffers(column)
        starts, offs, special = self.pre_tokens(raw, offsets)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int64), offs
        ends = np.append(starts[1:], len(raw))
        _, first, place = np.unique(hashes_at(raw, starts, ends), return_index=True, return_inverse=True)
        odd = ~_same_bytes(raw, starts, ends, first[place])
        if odd.any():  # equal hashes of different bytes: each such place is a word of its own
            place[odd] = len(first) + np.arange(int(odd.sum()))
            first = np.append(first, np.flatnonzero(odd))
        size = ends[first] - starts[first]
        at = np.concatenate([[0], np.cumsum(size)])
        take = np.arange(at[-1]) + np.repeat(starts[first] - at[:-1], size)
        flat, counts = self.merge_rounds(raw[take], at)
        for lo, _, i in special:  # an added token is one id
            k = int(place[np.searchsorted(starts, lo)])
            if counts[k] != 1 or flat[int(counts[:k].sum())] != i:
                low = int(counts[:k].sum())
                flat = np.concatenate([flat[:low], np.array([i], flat.dtype), flat[low + counts[k] :]])
                counts[k] = 1
        return flat, np.concatenate([[0], np.cumsum(counts)]), place, offs

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the texts, flat, and n + 1 offsets."""
        return gathered(*self.words(column))

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")


def _same_bytes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each place has the same bytes as the place `other` names."""
    wide = np.zeros(len(raw) + 8, np.uint8)
    wide[: len(raw)] = raw
    eight = np.ndarray((len(raw) + 1,), "<u8", wide, strides=(1,))
    size = ends - starts
    same = size == size[other]
    rows, at = np.flatnonzero(same & (np.arange(len(starts)) != other)), 0
    while len(rows):
        left = np.minimum(size[rows] - at, 8)
        mask = np.where(left == 8, U64(0xFFFFFFFFFFFFFFFF), (U64(1) << (8 * (left % 8)).astype(U64)) - U64(1))
        off = ((eight[starts[rows] + at] ^ eight[starts[other[rows]] + at]) & mask) != 0
        same[rows[off]] = False
        rows, at = rows[~off & (size[rows] - at > 8)], at + 8
    return same


def gathered(flat: np.ndarray, at: np.ndarray, place: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What words() gives -> ids of the texts, flat, and n + 1 offsets."""
    counts = (at[1:] - at[:-1])[place]
    total = np.concatenate([[0], np.cumsum(counts)])
    take = np.arange(total[-1]) + np.repeat(at[place] - total[:-1], counts)
    return flat[take], total[offs]


_loaded: dict[str, ByteBPE] = {}


def loaded(path: str) -> ByteBPE:
    if path not in _loaded:
        _loaded[path] = ByteBPE(path)
    return _loaded[path]


def small_batches(batches: Iterator[pa.RecordBatch], limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    for b in batches:
        step = max(1, int(b.num_rows * limit // max(limit, b.nbytes)))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for b in small_batches(batches):
            flat, word_at, place, offs = bpe.words(b["text"])
            ids, at = gathered(flat, word_at, place, offs)
            letters, cut, said, back = list(map(str, flat.tolist())), word_at.tolist(), [], []
            known = [",".join(letters[lo:hi]) for lo, hi in zip(cut, cut[1:])]
            for i in range(b.num_rows):
                own = ids[at[i] : at[i + 1]]
                text = ",".join([known[p] for p in place[offs[i] : offs[i + 1]].tolist()])
                said.append(hashlib.sha256(text.encode()).hexdigest())
                back.append(hashlib.sha256(bpe.decode(own).encode()).hexdigest())
            yield pa.record_batch([b["doc_id"], pa.array(np.diff(at)), pa.array(said, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row."""
    docs = docs.select(docs.doc_id.cast("long").alias("doc_id"), docs.text)
    return docs.mapInArrow(lean(_digests(path or vocabulary_path())), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _encode(path: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for b in small_batches(batches):
            ids, at = bpe.ids(b["text"])
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
            yield pa.record_batch([*(b[n] for n in names), lists], names=[*names, "ids"])

    return run


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with a column `ids` array<int>; all columns stay (an own column named ids is replaced)."""
    docs = docs.drop("ids")
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    return docs.mapInArrow(lean(_encode(path or vocabulary_path(), docs.columns)), f"{schema}, ids array<int>")


def _decode(path: str, names: list[str], into: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for b in small_batches(batches):
            texts = [None if i is None else bpe.decode(np.array(i, np.int64)) for i in b["ids"].to_pylist()]
            yield pa.record_batch([*(b[n] for n in names), pa.array(texts, pa.string())], names=[*names, into])

    return run


def decoded(rows: DataFrame, path: str | None = None, into: str = "decoded") -> DataFrame:
    """rows (with `ids` array<int>) with the decoded text; null ids give a null text."""
    rows = rows.drop(into)
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(lean(_decode(path or vocabulary_path(), rows.columns, into)), f"{schema}, `{into}` string")
