"""Each operator against brute force, on small tables with nulls, empty and long texts, ties, repeats and odd columns."""

import collections
import hashlib
import html
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("tarn.llm.queries")
SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, region long, ids string, score double"


def table(spark, texts, schema=DOC):
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 == 0 else "s", None if t is None else len(t), 5, "x", 1.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema)


def passages():
    base = [f"w{i}" for i in range(400)]
    p = " ".join(base[:60])
    return [
        p, "lead in " + p + " tail", None, "", "   ", "one two", p, " ".join(base[40:45]), "a " * 300, "a " * 50,
        " ".join(base[100:160]) + "\n" + " ".join(base[30:52]), " ".join(base), "x" * 5000, "Ünï cödé \u2003 mixed\u00a0space " * 12,
        " ".join(base[:200]) + " changed", " ".join(base[:200]) + " other", "W0 W1 W2 W3 w4", "w0 w1 w2 w3 w4",
    ]


def removed(texts, width=20):
    seen, out = {}, {}
    for d, t in enumerate(texts):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            if k in seen:
                gone[i : i + width] = [True] * width
            seen.setdefault(k, (d, i))
        kept = [x for x, g in zip(w, gone) if not g]
        out[d] = (len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def components(texts, percent=85):
    sets = {}
    for d, t in enumerate(texts):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


def test_substring_dedup(spark):
    from tarn.llm import substr

    texts = passages()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substr.digests(table(spark, texts)).collect()}
    assert got == removed(texts)
    cut = {r.doc_id: r for r in substr.without_repeats(table(spark, texts)).collect()}
    assert cut[0].text == texts[0] and cut[6].text == "" and cut[2].text is None and cut[12].text == texts[12] and cut[0].region == 5
    assert cut[1].text == "lead in\ntail" and cut[1].n_chars == 12


def test_substring_dedup_blocks(spark, monkeypatch):
    from tarn.llm import substr

    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(3)
    monkeypatch.setattr(substr, "BLOCK_BYTES", 4096)
    got = {r.doc_id: r.n_removed for r in substr.digests(docs).collect()}
    rows = sorted(docs.select("doc_id", "text").collect())
    want = removed([r.text for r in rows])
    assert got == {r.doc_id: want[i][1] for i, r in enumerate(rows)}


def test_minhash(spark):
    from tarn.llm import minhash

    texts = passages() + [" ".join(f"c{i}" if i != 7 * k else "edit" + str(k) for i in range(150)) for k in range(40)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.components(table(spark, texts)).collect()}
    assert got == components(texts)
    kept = minhash.one_of_each(table(spark, texts))
    assert kept.columns == table(spark, texts).columns and {r.doc_id for r in kept.collect()} == {d for d, x in got.items() if x[2]}


def test_minhash_two_texts(spark):
    """A doc_id with two texts has the links of both, on the left side of the comparison too."""
    from tarn.llm import minhash

    base = [[f"{c}{i}" for i in range(100)] for c in "pqr"]
    texts = [(0, " ".join(base[0])), (0, " ".join(base[1])), (0, None), (1, edited(base[1], 1, 1)), (2, edited(base[0], 1, 2)), (3, " ".join(base[2])), (4, edited(base[1], 1, 4))]
    got = minhash.components(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)).collect()
    assert {r.doc_id: r.component_id for r in got} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 0}


def edited(base, edits, seed):
    """base with so many words replaced, each in five shingles of its own."""
    w = list(base)
    for i in np.random.default_rng(seed).choice((len(w) - 9) // 6, edits, replace=False):
        w[6 * i + 4] = f"e{seed}x{i}"
    return " ".join(w)


def test_near_dedup_at_80(spark):
    """Links at 0.8, in pairs and in a large region, as brute force finds them."""
    from tarn.llm import minhash

    texts = ["a b c d e f g h", "a b c d e f g h i", "k l m n o p q", "k l m n o p q r"]
    for b in range(30):
        base = [f"b{b}w{i}" for i in range(454)]
        texts += [" ".join(base), edited(base, 8 + b % 4, b)]  # similarities 0.84, 0.82, 0.8 and 0.78
    texts += [edited([f"z{i}" for i in range(454)], 5, 100 + k) for k in range(40)]
    docs = table(spark, texts)
    want = components(texts, 80)
    assert sum(x[2] for x in want.values()) < sum(x[2] for x in components(texts).values())
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.components(docs, 80).collect()} == want
    assert {r.doc_id for r in minhash.one_of_each(docs, 80).collect()} == {d for d, x in want.items() if x[2]}


def test_near_dedup_between_at_80():
    """The step between components keeps pairs of a similarity of 0.8."""
    import pyarrow as pa

    from tarn.llm import minhash

    texts = []
    for b in range(200):
        base = [f"b{b}w{i}" for i in range(454)]
        texts += [" ".join(base), edited(base, 10, b)]  # 400 common shingles of 500
    ids = np.arange(len(texts))
    wide = pa.Table.from_batches(minhash._wide([pa.record_batch([pa.array(ids), pa.array(texts)], names=["doc_id", "text"])])).combine_chunks()
    rows = pa.table({"cell": ids // 2, "side": ids * 0, "component": ids, "doc_id": ids, "n": np.full(len(ids), 450), "common": np.full(len(ids), 400), "sketch": wide["sketch"]}).combine_chunks()
    found = [p for out in minhash._between(80)(iter(rows.to_batches())) for p in zip(out["a"].to_pylist(), out["b"].to_pylist())]
    assert sorted(found) == [(i, i + 1) for i in range(0, len(ids), 2)]


def complement(n):
    """Two different words over a and b that one polynomial modulo a power of two cannot tell apart."""
    s = "a"
    for _ in range(n):
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))


def test_words_told_apart(spark):
    """Long words and long runs of words that collide in polynomial hashes are different words."""
    from tarn.llm import minhash, substr

    s, t = complement(10)
    head = " ".join(f"w{i}" for i in range(19))
    runs = [" ".join(complement(k)[side]) for k in (5, 6) for side in (0, 1)]
    texts = [f"{head} {s}", f"{head} {t}", s, t, *runs]
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substr.digests(table(spark, texts)).collect()} == removed(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.components(table(spark, texts)).collect()} == components(texts)


def test_minhash_cut_regions(spark, monkeypatch):
    """Regions cut over tasks and pieces, and cells of blocks, give the same links."""
    from tarn.llm import minhash

    base = [f"z{i}" for i in range(300)]
    texts = [edited(base, 1 + k % 9, k) for k in range(150)] + [edited([f"y{i}" for i in range(60)], 1 + k % 2, k) for k in range(90)]
    want = components(texts)
    docs = table(spark, texts).repartition(8)
    for piece, whole in ((8192, 64), (40, 4), (24, 16)):
        monkeypatch.setattr(minhash, "PIECE", piece), monkeypatch.setattr(minhash, "WHOLE", whole)
        candidates, between = minhash._candidates, minhash._between

        def patched(make, *bound):
            def outer(*args):
                def run(batches):
                    before = minhash.PIECE, minhash.WHOLE
                    minhash.PIECE, minhash.WHOLE = bound
                    yield from make(*args)(batches)
                    minhash.PIECE, minhash.WHOLE = before
                return run
            return outer

        monkeypatch.setattr(minhash, "_candidates", patched(candidates, piece, whole)), monkeypatch.setattr(minhash, "_between", patched(between, piece, whole))
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.components(docs).collect()}
        monkeypatch.setattr(minhash, "_candidates", candidates), monkeypatch.setattr(minhash, "_between", between)
        assert got == want, piece


def test_substring_dedup_two_texts(spark):
    """Rows of one doc_id with different texts are documents of their own, in the order of their SHA-256; equal rows are one."""
    from tarn.llm import substr

    p = [f"w{i}" for i in range(90)]
    texts = [" ".join(p[:30]), " ".join(p[30:60]), " ".join(p[60:] + p[:25])]
    rows = [(7, texts[0]), (7, texts[1]), (7, texts[0]), (7, None), (7, texts[2]), (3, "q " + texts[1]), (None, texts[0]), (9, texts[0] + " z")]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    single = sorted({(d, t) for d, t in rows if d is not None}, key=lambda r: (r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()))
    brute = removed([t for _, t in single])
    want = collections.Counter((d, *brute[single.index((d, t))]) for d, t in rows if d is not None)
    want[(None, 30, 0, hashlib.sha256(texts[0].encode()).hexdigest())] += 1
    assert collections.Counter(map(tuple, substr.digests(docs).collect())) == want
    cut = substr.without_repeats(docs.selectExpr("*", "1 AS copy", "2 AS __n", "3 AS spans"))
    assert cut.columns == ["doc_id", "text", "copy", "__n", "spans"] and cut.count() == len(rows)


def test_substring_dedup_hot(spark, monkeypatch):
    """Seeds in very many contexts, dealt by path, give the same ranges."""
    from tarn.llm import substr

    hot = " ".join(f"h{i}" for i in range(12))
    texts = [f"{' '.join(f'a{k}x{i}' for i in range(15))} {hot} {' '.join(f'b{k % 60}y{i}' for i in range(15))}" for k in range(150)]
    monkeypatch.setattr(substr, "HOT_EVERY", 1)
    docs = table(spark, texts).repartition(6)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substr.digests(docs).collect()} == removed(texts)


@pytest.mark.parametrize("percent", [50, 70, 80, 85, 95, 100])
def test_near_dedup_bounds(percent):
    """A pair at the threshold is missed by the forest and dropped by a sketch as seldom at every percent; 85 is as it was."""
    from tarn.llm import minhash

    trees, shallow = minhash.shape(percent)
    assert (1 - min(0.99, percent / 100) ** shallow) ** trees <= minhash.MISS
    assert percent != 85 or (trees, shallow) == (16, 4)
    rng = np.random.default_rng(percent)
    for values, deviations in ((trees * minhash.DEEP, minhash.SKETCH_SD), (minhash.WIDE, minhash.WIDE_SD)):
        agree = rng.binomial(values, percent / 100 + (1 - percent / 100) / 4, 20_000)
        assert (agree < values * minhash.agreement(percent, values, deviations)).mean() <= 2e-4


def test_empty_tables(spark):
    from tarn.llm import ann, bpe, html_text, langid, minhash, packing, pii, substr, topk, urls

    docs, vectors, pages = spark.createDataFrame([], DOC), spark.createDataFrame([], "vec_id long, embedding array<float>"), spark.createDataFrame([], "page_id long, url string, html string")
    for f in (substr.digests, substr.without_repeats, minhash.components, minhash.one_of_each, bpe.digests, pii.digests, pii.redacted, langid.digests, langid.in_known_language, packing.packed):
        assert f(docs).count() == 0, f
    for f in (topk.searched, ann.searched):
        assert f(vectors).count() == 0
    for f in (html_text.extracted, urls.judged):
        assert f(pages).count() == 0


def test_bpe_round_trip(spark):
    from tokenizers import Tokenizer

    from tarn.llm import bpe

    library = Tokenizer.from_file(bpe.vocabulary_path())
    texts = passages() + ["<|endoftext|>a<|endoftext|>", "it's 'S 12ab  \n\n x", "aaaa" * 300, "日本語 ١٢٣ é\u0301"]
    got = {r.doc_id: r for r in bpe.digests(table(spark, texts)).collect()}
    for d, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[d].n_tokens == len(ids)
        assert got[d].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[d].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = bpe.decoded(bpe.encoded(table(spark, texts)))
    assert all(r.decoded == (r.text or "") and r.region == 5 for r in back.collect())


def test_bpe_cuts(monkeypatch):
    """Pre-tokens cut as the library cuts them, on random strings of awkward characters, and with hashes that all collide."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    from tarn.llm import bpe

    library, model = Tokenizer.from_file(bpe.vocabulary_path()), bpe.ByteBPE(bpe.vocabulary_path())
    rng = np.random.default_rng(5)
    parts = ["a", "s", "t", "re", "ve", "ll", "d", "m", "'", "'s", "'re", " ", "  ", "\n", "\t", "\u3000", "\u00a0", "1", "9", "\u0663", "é", "日本", "!", "-", "😀", "<|endoftext|>", "<|endoftext", "|>", "Z", "x" * 40, "\u0301", "\ufeff", "'ll", "''", "\r\n"]
    texts = [None, ""] + ["".join(parts[k] for k in rng.integers(0, len(parts), n)) for n in rng.integers(1, 30, 3000)]

    def equal(some):
        ids, at = model.ids(pa.array(some))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [library.encode(t or "", add_special_tokens=False).ids for t in some]

    equal(texts)
    monkeypatch.setattr(bpe, "hashes_at", lambda raw, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(3))
    equal(texts[:300])


@pytest.mark.parametrize("shares", [None, {"s": 0.9}])
def test_packing(spark, shares):
    from tokenizers import Tokenizer

    from tarn.llm import bpe, packing

    library, texts = Tokenizer.from_file(bpe.vocabulary_path()), passages() * 3
    got = packing.packed(table(spark, texts).repartition(3), shares=shares, window=700).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [0]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        by_doc[r.doc_id].append((r.start, r.length))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for pieces, whole in [(by_doc[d], True) for d in range(len(texts))] + [(s, False) for s in by_sequence.values()]:
        at = 0
        for start, n in sorted(pieces):
            assert start == at
            at += n
        assert whole or at <= 1024
    assert sum(sum(n for _, n in s) < 1024 for s in by_sequence.values()) <= 1


def simulated(totals, shares, window):
    """Deficit round-robin, window by window and queue by queue: (queue, token) in stream order."""
    from fractions import Fraction

    out, given, window = [], [0] * len(totals), window * len(totals)

    def serve(rates, until):
        deficit = {q: Fraction(0) for q in rates}
        while not until():
            for q, rate in rates.items():
                deficit[q] += rate
                n = min(int(deficit[q]), totals[q] - given[q])
                out.extend((q, t) for t in range(given[q], given[q] + n))
                given[q] += n
                deficit[q] -= n

    listed = {q: s for q, s in sorted((shares or {}).items()) if s > 0}
    weight = {q: max(1, round(s / sum(listed.values()) * 2**28)) for q, s in listed.items() if totals[q]}
    while weight:
        rates = {q: Fraction(window * w, sum(weight.values())) for q, w in weight.items()}
        serve(rates, lambda: any(given[q] == totals[q] for q in rates))
        weight = {q: w for q, w in weight.items() if given[q] < totals[q]}
    left = [t - g for t, g in zip(totals, given)]
    windows = -(-sum(left) // window)
    serve({q: Fraction(t, max(1, windows)) for q, t in enumerate(left)}, lambda: given == list(totals))
    return out


@pytest.mark.parametrize("totals, shares", [
    ([50, 0, 333, 1], None), ([7], None), ([0], None), ([900, 100, 40], {0: 0.1, 1: 0.9}), ([900, 100, 40], {2: 1.0}), ([5, 5, 5], {0: 0.0}), ([300, 200, 100, 17], {0: 1, 1: 1, 2: 2, 3: 0.001}),
])
def test_packing_order(totals, shares):
    """The closed form gives the order of the round-robin played through."""
    from tarn.llm import packing

    plan, want = packing.Schedule(np.array(totals), shares, 10), simulated(totals, shares, 10)
    got = {}
    for q, n in enumerate(totals):
        for lo in range(0, n, 13):
            hi = min(n, lo + 13)
            spans = list(plan.pieces(q, lo, hi))
            assert sum(y - x for x, y, _ in spans) == hi - lo
            got |= {place + t - x: (q, t) for x, y, place in spans for t in range(x, y)}
    assert [got[i] for i in range(len(want))] == want and len(got) == len(want)


def test_packing_many_sources():
    """A document costs about the same among 4,000 sources as among 4."""
    import time

    from tarn.llm import packing

    took = []
    for sources in (4, 4000):
        totals = np.full(sources, 80_000_000 // sources)
        plan, began = packing.Schedule(totals), time.time()
        pieces = sum(1 for k in range(20_000) for _ in plan.pieces(k % sources, k // sources * 500, k // sources * 500 + 500))
        took.append((time.time() - began) / pieces)
    assert took[1] < 2 * took[0] + 2e-5


def test_packing_mixture(spark):
    """Asked shares hold in every window until a source with a share is empty."""
    from tarn.llm import packing

    docs = spark.createDataFrame([(i, "word " * 40, None if i % 3 == 0 else "ab"[i % 2]) for i in range(900)], "doc_id long, text string, source string").repartition(4)
    got = packing.packed(docs, shares={"a": 0.75, None: 0.25}, window=500).collect()
    ends = collections.defaultdict(int)
    for r in got:
        ends["none" if r.doc_id % 3 == 0 else "ab"[r.doc_id % 2]] += r.length * (r.sequence_id < 8)
    assert abs(ends["a"] - 0.75 * 8 * 1024) < 1200 and ends["b"] == 0 and abs(ends["none"] - 0.25 * 8 * 1024) < 1200


def luhn(d):
    return sum((v := int(c) * (1 + i % 2)) - 9 * (v > 9) for i, c in enumerate(reversed(d))) % 10 == 0


def test_pii(spark):
    from tarn.llm import pii

    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    ok = {
        "email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m.split(".")), "phone": lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15,
        "card": lambda m: 12 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d),
    }
    texts = [*passages(), "a@b.cc-d+e@f.g 1.2.3.4.5.6.7.8 +1 (234) 567-8901- 4111 1111 1111 1111x", "é😀 a@b.c 999.1.1.1 00255.0.0.1 GB82 WEST 1234 5698 7654 32 ssn 123-45-6789", "1.2.3.4" * 500, "4111-1111-1111-1111" * 40]
    got = {r.doc_id: r for r in pii.digests(table(spark, texts)).collect()}
    for d, t in enumerate(texts):
        spans = sorted((m.start(), i, m.end(), k) for i, (k, p) in enumerate(kinds.items()) for m in re.finditer(p, t or "") if ok[k](m.group()))
        assert got[d].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans).encode()).hexdigest()
        assert (got[d].n_email, got[d].n_ip, got[d].n_card, got[d].n_phone) == tuple(sum(s[3] == k for s in spans) for k in kinds)
    odd = len(passages()) + 1
    at = texts[odd].index("GB82")
    assert f"iban:{at}:{at + 27}" in got[odd].spans and "national_id" in got[odd].spans
    clean = {r.doc_id: r for r in pii.redacted(table(spark, texts)).collect()}
    assert clean[odd - 1].text == "<EMAIL><EMAIL> <IP>.<IP> +1 (234) 567-8901- <CARD>x" and clean[2].text is None and clean[5].text == "one two"


def test_pii_many_spans(spark):
    """Offsets and redaction over several blocks of spans and pieces of text; the cost does not grow with their square."""
    import time

    from tarn.llm import pii

    rng = np.random.default_rng(2)
    words = ["é", "plain words", "a@b.cc", "10.0.0.7", "+1 234 567 8901", "4111 1111 1111 1111", "x@y.z 1.2.3.4", "GB82 WEST 1234 5698 7654 32"]
    texts = [" ".join(words[k] for k in rng.integers(0, len(words), n)) for n in (127, 128, 129, 700, 3000)] + ["a@b.cc " * 585 + "é", "x" * 4096 + "a@b.cc" + "y" * 4090]
    clean = {r.doc_id: r.text for r in pii.redacted(table(spark, texts)).collect()}
    rows = {r.doc_id: r.spans for r in pii.digests(table(spark, texts)).collect()}
    for d, t in enumerate(texts):
        spans = [(k, int(a), int(z)) for k, a, z in (x.split(":") for x in rows[d].split(","))]
        want, at = "", 0
        for k, a, z in spans:
            if a >= at:
                want += t[at:a] + f"<{k.upper()}>"
            at = max(at, z)
        assert clean[d] == want + t[at:]
        assert sum(k == "email" for k, _, _ in spans) == len(re.findall(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)+", t))
    took = []
    for n in (1000, 50_000):
        docs = table(spark, [f"a{i}@b.cc " * n for i in range(2)]).cache()
        docs.count()
        began = time.time()
        assert {r.n_email for r in pii.digests(docs).collect()} == {n}
        took.append(time.time() - began)
    assert took[1] < 60


def test_pii_context(spark):
    """Words beside a span decide on the method's own kinds, and move the score of all; they reach no further than the next span."""
    from tarn.llm import pii

    ibans = ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "FR14 2004 1010 0505 0001 3M02 606"]
    cases = {f"pay to {x} now": [("iban", 0.7)] for x in ibans} | {f"my bank account {x}": [("iban", 1.0)] for x in ibans} | {
        "an example of the format: DE89370400440532013000": [], "DE88370400440532013000": [], "ssn 123-45-6789": [("national_id", 0.6)], "123-45-6789": [],
        "part no 123-45-6789 ssn": [], "ssn 000-45-6789": [], "ssn" + " " * 60 + "123-45-6789": [], "write to a@b.cc": [("email", 1.0)], "call order 4111111111111111": [("card", 0.5)],
        "ssn 123-45-6789 123-45-6788": [("national_id", 0.6)],
    }
    names = list(pii.KINDS)
    got = pii.with_spans(table(spark, list(cases))).collect()
    for r in got:
        assert [(names[x.kind], round(x.score, 2)) for x in r.pii] == cases[r.text], r.text


def test_html(spark):
    from tarn.llm import html_text

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    unmarked = {i: re.sub("</?article>", "", h) for i, h in source.items()}
    assert sum(html_text.main_text(h) != html_text.main_text(unmarked[i]) for i, h in source.items()) == 0
    for r in html_text.extracted(pages).collect():
        article = re.search(r"<article>(.*?)(</article>|$)", source[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", article)]
        assert r.text == " ".join(b for b in blocks if b) and r.n_chars == len(r.text)
    long = "Plain words that run on and on in a paragraph of the page without a mark. " * 3
    plain = f"<body><div class='menu'><a href=x>Home</a></div><p>{long}<p>Short.</p><p>{long}</p><ul><li><a href=y>More links here</a></ul><div id=comments>I disagree with all of it, and at length, so here is my own long text about it.</div>"
    assert html_text.main_text(plain) == f"{long.strip()} Short. {long.strip()}"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p") == ""
    assert html_text.main_text("<main><p>a &lt;b&gt; &am c&amp<!-- x --></p><script>var p='</p>'</script><form>f</form></main>") == "a <b> &am c&"


def test_html_distribution():
    """Surges and dives decide: several regions, links inside one, a page that never gets far, and text outside a mark."""
    from tarn.llm import html_text

    long = "A paragraph of the page that runs on for more than the surge point asks for."
    links = "<p><a href=x>More</a></p>"
    assert html_text.regions([0, 5, 30, 0, 0, 0, 4, 0, 0, 0, 40, 1]) == [(1, 3), (10, 12)]
    assert html_text.regions([3, 0, 0]) == [(0, 1)] and html_text.regions([]) == html_text.regions([0, 0]) == []
    page = f"<p>{long}</p>{links}<p>Short.</p>{links * 4}<p>{long}</p>{links * 4}<p>Go</p>"
    assert html_text.main_text(page) == f"{long} More Short. {long}"
    assert html_text.main_text("<body><p>Hi.</p></body>") == "Hi."
    assert html_text.main_text(f"<p>Up</p><article><p>Two.</p>{links * 2}<p>{long}</p></article><p>{long}</p>") == f"Two. More More {long}"
    assert html_text.main_text(f"<article>Teaser</article><p>{long}</p><p>{long}</p>") == f"Teaser {long} {long}"
    for part in (f"<p>{long}</p><p>So.</p>", f"<p>{long}</p><div class=advert>Buy</div>{links}<p>{long}</p><p>End it.</p>"):
        assert html_text.main_text(f"<nav>Home</nav><article>{part}</article><footer>x</footer>") == html_text.main_text(f"<nav>Home</nav>{part}<footer>x</footer>")
    assert html_text.main_text(f"<p>{long} <math><mi>x</mi></math> <object>seen</object></p>") == f"{long} x seen"


def test_html_interrupted():
    """An unmarked article goes on after furniture and link-only lines, as often as they come."""
    from tarn.llm import html_text

    parts = [f"Part {i} of a text that runs on for well over the number of characters that a surge must reach, as articles do. " * (1 + i % 2) for i in range(4)]
    breaks = ["<div class=advert>Buy</div>" * 3 + "<div class=share>Tell others</div>", "<p><a href=x>More of it</a></p>" * 4, "<nav>a<br>b<br>c<br>d</nav>"]
    page = "<body>" + "".join(f"<p>{a}</p>{b}" for a, b in zip(parts, [*breaks, ""])) + "</body>"
    assert html_text.main_text(page) == " ".join(x.strip() for x in parts)


@pytest.mark.parametrize("wrapper", [
    "div class='overflow-hidden'", "div aria-hidden='false'", "div class='layout has-sidebar'", "div class='content no-banner'", "section class='content-with-sidebar'", "div data-state=hidden",
    "div data-id='share'",
])
def test_html_wrappers(wrapper):
    from tarn.llm import html_text

    text = "Plain words that run on and on in a paragraph of the page, so that they are a surge without a mark as well."
    inner = f"<p>{text}</p><div class='has-x share'>Share it</div><div hidden>not shown</div><p aria-hidden=true>nor this</p><p style='color:red; display : none'>nor that</p>"
    close = f"</{wrapper.split()[0]}>"
    assert html_text.main_text(f"<body><{wrapper}>{inner}{close}</body>") == text
    assert html_text.main_text(f"<body><{wrapper}><article>{inner}</article>{close}</body>") == text


def test_html_marked_article():
    """Nothing that holds the marked article hides it; what it holds and other articles' furniture still count."""
    from tarn.llm import html_text

    text = "A paragraph of the article that is longer than the others."
    for tag in ("body style='visibility:hidden'", "main aria-hidden=true", "article hidden", "div class=sidebar", "form id=search"):
        page = f"<{tag}><article><p>{text}</p><div class=advert>Buy</div><div hidden>no</div></article></{tag.split()[0]}><div id=comments><article>Mine.</article></div>"
        assert html_text.main_text(page) == text, tag


def test_urls(spark):
    from tarn.llm import urls

    cases = {
        "http://A.Example.ORG:80/en/1?x": ("a.example.org:80", "/en/1", None), "https://example.org/es/#f": ("example.org", "/es/", "example.org/es/"),
        "https://m.example.org/en/12": ("m.example.org", "/en/12", "example.org/en/1"), "x://org": ("org", "", None), "x://b.org/": ("b.org", "/", "org/"),
        "nothing": ("", "", None), "http://c.com/de/1": ("c.com", "/de/1", "com/de/"), "http://c.com?/fr/": ("c.com", "", None),
    }
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(cases)] + [(99, None)], "page_id long, url string")
    got = {r.page_id: r for r in urls.judged(pages).collect()}
    for i, want in enumerate(cases.values()):
        assert (got[i].host, got[i].path, got[i].rule) == want
    assert got[99].host == got[99].path == "" and all(r.verdict in ("allow", "block") for r in got.values())


def test_url_model(spark):
    """The model's ratios against a plain computation."""
    import math

    from tarn.llm import urls

    known = [("abab/x", 2, True), ("abc/y", 1, True), ("zab/x", 3, False), ("", 1, False)]
    a, r = collections.Counter(), collections.Counter()
    for s, n, accepted in known:
        for i in range(1, len(s) + 1):
            for k in range(1, min(i, urls.ORDER) + 1):
                (a if accepted else r)[s[i - k : i]] += n
    grams = set(a) | set(r)
    letters = [g for g in grams if len(g) == 1]

    def p(c, g):
        if len(g) == 1:
            return (c[g] + urls.BETA / len(letters)) / (sum(c[x] for x in letters) + urls.BETA)
        return (c[g] + urls.BETA * p(c, g[1:])) / (c[g[:-1]] + urls.BETA)

    got = {x.gram: x.ratio for x in urls.model(spark.createDataFrame(known, "s string, n long, accepted boolean")).collect()}
    assert set(got) == grams
    assert all(math.isclose(got[g], math.log(p(a, g) / p(r, g)), abs_tol=1e-9) for g in grams)


def test_url_likelihood(spark):
    """Score and verdict against both models computed in full, with n-grams, contexts and characters never seen."""
    import math

    from tarn.llm import urls

    urls_seen = [f"http://{h}{p}{i}" for i in range(40) for h, p in (("a.com", "/fr/"), ("b.com", "/de/x"), ("c.org", "/zz"), ("example.org", "/en/1"))]
    free = ["http://a.net/de/x1", "http://b.com/frde", "http://example.com/en/1", "http://q.net/\u00e9", "http://com", "x", "http://ab.net/fr/7"]
    pages = spark.createDataFrame(list(enumerate(urls_seen + free)), "page_id long, url string")
    got = urls.judged(pages).collect()
    counts = {True: collections.Counter(), False: collections.Counter()}
    known = [(r.host + r.path, r.verdict == "allow") for r in got if r.rule]
    held = lambda s: zlib.crc32(s.encode()) % 5 == 0
    for s, accepted in known:
        for i in range(1, len(s) + 1):
            for k in range(1, min(i, urls.ORDER) + 1):
                counts[accepted][s[i - k : i]] += not held(s)
    seen = {g for c in counts.values() for g, n in c.items() if n}
    letters = [g for g in seen if len(g) == 1]

    def p(c, g):
        if len(g) == 1:
            return (c[g] + urls.BETA / len(letters)) / (sum(c[x] for x in letters) + urls.BETA)
        return (c[g] + urls.BETA * p(c, g[1:])) / (c[g[:-1]] + urls.BETA)

    def score(s):
        grams = [s[max(0, i - urls.ORDER) : i] for i in range(1, len(s) + 1)]
        return sum(math.log(p(counts[True], g) / p(counts[False], g)) for g in grams) / max(1, len(s))

    assert any(r.path and r.path[-1] not in letters for r in got)
    assert all(abs(r.score - score(r.host + r.path)) < 1e-6 for r in got)
    tests = [(math.copysign(math.floor(abs(x) * 100 + 0.5), x) / 100, accepted) for s, accepted in known if held(s) for x in [score(s)]]
    n = [max(1, sum(a == accepted for _, a in tests)) for accepted in (False, True)]
    error = lambda b: round(sum(a and x < b for x, a in tests) / n[1] + sum(not a and x >= b for x, a in tests) / n[0], 9)
    at = min({x for x, _ in tests}, key=lambda b: (error(b), abs(b), b)) - 0.005
    assert [r.verdict for r in got if not r.rule] == ["allow" if score(r.host + r.path) >= at else "block" for r in got if not r.rule]


def test_url_score_paths(spark, monkeypatch):
    """A table too large to broadcast gives the same scores, with hot n-grams apart."""
    from tarn.llm import urls

    known = spark.createDataFrame([(f"abab/x{i % 7}", 2 + i, i % 2 == 0) for i in range(40)] + [("zab/y", 3, False)], "s string, n long, accepted boolean")
    table = urls.model(known).cache()
    strings = spark.createDataFrame([("abab/x3",), ("zab/q",), ("",), ("é",)], "s string")
    whole = {r.s: round(r.score, 9) for r in urls.scored(strings, table).collect()}
    for parts in (1, 3, 20):
        monkeypatch.setattr(urls, "HOT_PARTS", parts)
        assert {r.s: round(r.score, 9) for r in urls.scored(strings, table).collect()} == whole


def test_urls_repeated_and_clashing(spark):
    """Repeated rows are judged each; columns that clash with the operator's own are ignored; ruled verdicts are the rules'."""
    from tarn.llm import urls

    rows = [(i % 30, f"http://{h}.com/{p}/{i % 7}") for i, (h, p) in enumerate([("a", "fr"), ("b", "de"), ("c", "x"), ("d.org", "")] * 15)] + [(1, None)]
    pages = spark.createDataFrame([(i, u, "h", 1, 2.5, "v") for i, u in rows], "page_id long, url string, host string, n long, score double, s string")
    got = urls.judged(pages).collect()
    assert collections.Counter(r.page_id for r in got) == collections.Counter(i for i, _ in rows)
    for r in got:
        assert r.rule is None or r.verdict == ("allow" if r.path.startswith("/fr/") else "block")
    assert len({(r.host, r.path, r.verdict, r.score) for r in got}) == len({(r.host, r.path) for r in got})


def odd_vectors(spark, n=400):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 8)]) for i in range(n)] + [(500, None), (600, []), (700, [1.0, None]), (800, [float("nan")] * 8), (900, [0.0] * 8), (1000, [1.0, 2.0])]
    rows += [(5, rows[5][1]), (1100, rows[100][1]), (1101, rows[100][1])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>"), {i: v for i, v in rows if v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v)}


def test_topk(spark):
    from tarn.llm import topk

    df, vectors = odd_vectors(spark)
    ids = np.array(sorted(vectors))
    x = np.floor(1024 * np.array([vectors[i] for i in ids])).astype(np.int64)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.searched(df).collect() if r.query_id != 1000}
    want = {}
    for q in np.flatnonzero(ids % 100 == 0):
        s = x @ x[q]
        order = [i for i in np.lexsort((ids, -s)) if i != q][:10]
        want |= {(ids[q], k + 1): (ids[i], s[i]) for k, i in enumerate(order)}
    assert got == want
    huge = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, 2.0]), (2, [-1e30, 0.0])], "vec_id long, embedding array<double>")
    assert [r.score for r in topk.searched(huge).orderBy("rank").collect()] == [2**63 - 1, -(2**63)]


def test_ann(spark):
    from tarn.llm import ann

    df, vectors = odd_vectors(spark)
    vectors.pop(900)
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids])
    got = collections.defaultdict(list)
    for r in ann.searched(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = 0
    queries = np.flatnonzero(ids % 100 == 0)
    for q in queries:
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, d)) if i != q][:10]
        hits += len({ids[i] for i in order} & {v for v, _ in got[ids[q]]})
        assert len(got[ids[q]]) == 10 and all(np.isclose(s, d[np.searchsorted(ids, v)], rtol=0, atol=1e-12) for v, s in got[ids[q]])
    assert hits >= 9 * len(queries)


def recall(spark, x, rerank=None):
    """Share of the true ten nearest found, over all queries, with rerank rows measured exactly."""
    from tarn.llm import ann

    before, ann.RERANK = ann.RERANK, rerank or ann.RERANK
    try:
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
        got = collections.defaultdict(set)
        for r in ann.searched(df).collect():
            got[r.query_id].add(r.vec_id)
    finally:
        ann.RERANK = before
    q = np.arange(0, len(x), 100)
    d = (x.astype(np.float64) ** 2).sum(1) - 2 * x[q].astype(np.float64) @ x.T.astype(np.float64)
    d[np.arange(len(q)), q] = np.inf
    return np.mean([len(got[i] & set(np.argsort(d[k])[:10])) / 10 for k, i in enumerate(q)])


def test_ann_recall(spark):
    """Against brute force over all queries of sf0.1 with 2 % of its rows measured exactly, and over nearly isotropic vectors with 0.8 %."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], np.float32)
    assert recall(spark, x, len(x) // 50) >= 0.95
    assert recall(spark, np.random.default_rng(5).normal(0, 1, (12_000, 64)).astype(np.float32)) >= 0.95


def test_language(spark):
    from tarn.llm import langid

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = langid.digests(docs).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and lang[r.doc_id]]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.9 * len(held)
    odd = {r.doc_id: r for r in langid.predicted(table(spark, passages() + ["12 34 !!", "é", "a" * 300_000]), langid.fitted(docs)).collect()}
    n = len(passages())
    assert odd[2].lang_pred == odd[3].lang_pred == odd[n].lang_pred == "und" and odd[n].score == 0 and odd[n + 1].lang_pred != "und"
    assert all(0 <= r.score <= 1 for r in odd.values())


def test_language_whole_texts(spark):
    """Texts teach their language by what follows a long common opening; every label can be predicted."""
    from tarn.llm import langid

    opening = "the same words of a notice open every text here " * 110
    words = {"x": "ula mora teni sabo ", "y": "grof zwik brant plux "}
    docs = spark.createDataFrame([(i, opening + words["xy"[i % 2]] * 600, "xy"[i % 2]) for i in range(60)], "doc_id long, text string, lang string")
    tests = spark.createDataFrame([(i, words["xy"[i % 2]] * 20) for i in range(10)], "doc_id long, text string")
    assert all(r.lang_pred == "xy"[r.doc_id % 2] for r in langid.predicted(tests, langid.fitted(docs)).collect())
    many = spark.createDataFrame([(i, f"text {i % 260} " * 9, f"l{i % 260}") for i in range(2600)], "doc_id long, text string, lang string")
    assert len(langid.fitted(many).labels) == 260


def plain_probabilities(net, raw):
    """The network on one text, window by window, place by place."""
    from tarn.llm import langid as L

    out, p = np.zeros(len(net.labels)), net.p
    for at in range(0, len(raw), L.WINDOW):
        x, pooled = raw[at : at + L.WINDOW], []
        for w in L.WIDTHS:
            conv = [np.concatenate([p["e"][b] for b in x[i : i + w]]) @ p[f"w{w}"] for i in range(len(x) - w + 1)]
            pooled.append(np.max(conv, 0) + p[f"b{w}"] if conv else np.full(L.FILTERS, -np.inf))
        z = np.maximum(np.concatenate(pooled), 0) @ p["o"] + p["c"]
        z = np.exp(z - z.max())
        out += z / z.sum() * len(x)
    return out / max(1, len(raw))


def test_language_network():
    """Probabilities of texts of any length against the plain network, cut into blocks too; the gradient against differences."""
    import pyarrow as pa

    from tarn.llm import langid as L

    rng = np.random.default_rng(4)
    net = L.Network(["a", "b", "c"])
    for k in net.p:
        net.p[k] = rng.normal(0, 0.7, net.p[k].shape)
    texts = ["", "a", "é", "abc", "x" * 255, "y" * 256, "z" * 257, "".join(map(chr, rng.integers(32, 700, 900)))]
    raws = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    want = [plain_probabilities(net, r) for r in raws]
    flat, offsets = np.concatenate(raws), np.concatenate([[0], np.cumsum([len(r) for r in raws])])
    assert np.allclose(net.probabilities(flat, offsets, net.tables()), want, atol=2e-5)
    before, L.BLOCK = L.BLOCK, 2 * L.WINDOW
    try:
        got = [r for b in L._predict(net, ["t"])(iter([pa.record_batch([pa.array(texts), pa.array(texts)], names=["t", "text"])])) for r in b.to_pylist()]
    finally:
        L.BLOCK = before
    assert all(r["lang_pred"] == "und" or (r["lang_pred"] == net.labels[int(w.argmax())] and abs(r["score"] - w.max()) < 2e-5) for r, w in zip(got, want))
    x, y = rng.integers(0, 256, (6, 40)).astype(np.uint8), rng.integers(0, 3, 6)

    def loss():
        total = 0.0
        for row, label in zip(x, y):
            pooled = [np.max([np.concatenate([net.p["e"][b] for b in row[i : i + w]]) @ net.p[f"w{w}"] for i in range(len(row) - w + 1)], 0) + net.p[f"b{w}"] for w in L.WIDTHS]
            z = np.maximum(np.concatenate(pooled), 0) @ net.p["o"] + net.p["c"]
            total += np.log(np.exp(z - z.max()).sum()) + z.max() - z[label]
        return total / len(x) + 0.5e-4 * (net.p["o"] ** 2).sum()

    g = net._gradients(x, y)
    for k in net.p:
        for place in rng.integers(0, net.p[k].size, 4):
            at = np.unravel_index(place if k != "e" else int(x[0, 0]) * L.EMBED + place % L.EMBED, net.p[k].shape)
            kept, step = net.p[k][at], 1e-6
            net.p[k][at] = kept + step
            up = loss()
            net.p[k][at] = kept - step
            down = loss()
            net.p[k][at] = kept
            assert abs((up - down) / (2 * step) - g[k][at]) < 1e-4, k


def test_pipeline_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and repeated rows: the stages keep what they should and the last packs it all."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    words = [f"word{i}" for i in range(60)]
    texts = [" ".join(words), " ".join(words) + " end", None, "", "12 34", "write to a@b.cc now please, it is a long way to the end of this text", " ".join(words[::-1])]
    rows = [(i, t, "en" if i % 2 else None, None if i == 5 else "s", None if t is None else len(t)) for i, t in enumerate(texts)] + [(5, texts[5], None, "s", 3), (None, "a text without a number that stays", "en", "s", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    kept = docs.collect()
    assert collections.Counter(r.doc_id for r in kept) == {0: 1, 5: 2, 6: 1, None: 1}
    assert all("a@b.cc" not in r.text for r in kept) and all(r.n_chars == len(r.text) for r in kept)
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == {0, 5, 6, None} and sum(r.length for r in pieces if r.doc_id == 5) == 2 * next(r.doc_tokens for r in pieces if r.doc_id == 5)


@pytest.mark.parametrize("name", ["op2_minhash_near_dedup", "op5_exact_topk", "op10_substring_dedup"])
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from tarn.llm import queries

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted(docs.collect())
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, out = out, stage(spark, out, SF)
        assert out.columns == docs.columns, name
        kept = {r.doc_id: r for r in out.collect()}
        if name == "language_id":
            assert len(kept) >= 0.99 * len(rows)
        if name == "minhash_near_dedup":
            texts = [r.text for r in sorted(before.collect())]
            own = [r.doc_id for r in sorted(before.collect())]
            assert set(kept) == {own[i] for i, x in components(texts, 80).items() if x[2]}
        if name in ("substring_dedup", "pii"):
            assert len(kept) == before.count()
        assert all(r.n_chars == len(r.text) for r in kept.values())
    pieces = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(kept)
