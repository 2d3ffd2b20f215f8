"""Personal data in whole texts, with DataFrame functions only.

Regular expressions propose spans, checksums confirm them (Luhn for cards, mod-97 for IBANs), words near a span move its
score up (`CONTEXT`) or down (`AGAINST`). Kinds: email, ip, card, phone (the base kinds: every span that its rule accepts
stays, whatever its score) and the method's own, which their score decides: iban (mod-97; dropped beside words that
speak against it) and national_id (three, two, four digits; only beside a context word, and none against it).

Offsets are code points, end exclusive. A text is cut at a kind's matches; the running length of cuts and matches gives
the offsets, and a span's context is up to `NEAR` code points of the cuts on both of its sides. Running values are
taken in blocks of `BLOCK` spans, so the work grows with the text and not with the square of its spans. Patterns are
possessive and start only where a run starts, so they need no backtracking on long runs.
Defined results: a null text is empty and has no spans; repeated rows are reported each; other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of the kinds, in report order. \\G: a match may start where the one before ended.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE = ("email", "ip", "card", "phone")
#: A cheap test that a text may hold the kind at all.
MAY_HOLD = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){11}"),
    "phone": lambda t: t.contains("+"),
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}[ A-Z0-9]{10}"),
    "national_id": lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
}
#: Score of a confirmed span, and what a context word adds.
SCORE = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.7, "national_id": 0.3}
NEAR, CONTEXT_MOVES, ACCEPT = 40, 0.3, 0.5
BLOCK, PIECE = 128, 4096  # spans, code points
CONTEXT = {
    "email": "mail|contact|write|schreib|correo|courriel",
    "ip": r"\bip\b|server|host|address|adresse",
    "card": "card|visa|credit|karte|carte|tarjeta",
    "phone": r"phone|\btel|call|mobil|fax|anruf|appel",
    "iban": "iban|account|konto|compte|cuenta|bank",
    "national_id": r"\bssn\b|social security|national id|identity",
}
#: Words that speak against a kind.
AGAINST = {
    "email": r"\bexample\b|\bdummy\b",
    "ip": r"\bversion\b|\bchapter\b|\bsection\b",
    "card": r"\border\b|\binvoice\b|\bisbn\b|\bserial\b|\btracking\b",
    "phone": r"\border\b|\binvoice\b|\bisbn\b|\bserial\b",
    "iban": r"\bexample\b|\bsample\b|\bdummy\b|\bformat\b|\bserial\b",
    "national_id": r"\bpart\b|\border\b|\binvoice\b|\bserial\b|\bmodel\b|\bphone\b",
}


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + F.lit(1), F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def mod97(text: Column) -> Column:
    """Whether an IBAN (white space allowed) leaves 1 when its rearranged number is divided by 97."""
    compact = F.regexp_replace(text, "[^A-Z0-9]", "")
    moved = F.concat(F.substring(compact, F.lit(5), F.length(compact)), F.substring(compact, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step) == 1


_PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})?+"
ACCEPTED = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"),
    "card": lambda m: F.when(F.length(_digits(m)).between(12, 19), luhn(_digits(m))).otherwise(False),
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
    "iban": lambda m: F.when(F.length(F.regexp_replace(m, " ", "")).between(15, 34), mod97(m)).otherwise(False),
    "national_id": lambda m: ~m.rlike("^(000|666|9)|-00-|-0000$"),
}


def bound(value: Column, use) -> Column:
    """use(value), with value computed once however often use mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(items: Column, size, most: bool = False) -> Column:
    """For each item the sum (or the greatest, at least 0) of size over the items before it, in blocks of BLOCK."""
    join = F.greatest if most else lambda a, b: a + b

    def before(values: Column, size, begin: Column) -> Column:
        step = lambda state, x: F.struct(join(state["at"], size(x)).alias("at"), F.array_append(state["out"], state["at"]).alias("out"))
        return F.aggregate(values, F.struct(begin.alias("at"), F.array().cast("array<int>").alias("out")), step, lambda s: s["out"])

    def blocks(all_items: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(all_items) - 1) / BLOCK).cast("int"))
        cut = F.transform(numbers, lambda b: F.slice(all_items, b * BLOCK + F.lit(1), F.lit(BLOCK)))
        return bound(cut, lambda parts: bound(
            before(F.transform(parts, lambda part: F.aggregate(part, F.lit(0), lambda t, x: join(t, size(x)))), lambda t: t, F.lit(0)),
            lambda begins: F.flatten(F.zip_with(parts, begins, lambda part, begin: before(part, size, begin))),
        ))

    return bound(items, lambda x: F.when(F.size(x) > 0, blocks(x)).otherwise(F.array().cast("array<int>")))


def proposed(text: Column, kind: str) -> Column:
    """The pattern's matches, leftmost first and not overlapping: start, kind, end, text, and what is around (left, right)."""
    number = list(KINDS).index(kind)

    def cut(gaps: Column) -> Column:
        hits = F.regexp_extract_all(text, F.lit(KINDS[kind]), F.lit(0))
        return F.filter(F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), F.slice(gaps, F.lit(2), F.size(gaps)).alias("next")), lambda x: x["hit"].isNotNull())

    def span(x: Column, at: Column) -> Column:
        start = at + F.length(x["gap"])
        left = F.right(x["gap"], F.lit(NEAR))
        right = F.substring(F.coalesce(x["next"], F.lit("")), 1, NEAR)
        return F.struct(start.alias("start"), F.lit(number).alias("kind"), (start + F.length(x["hit"])).alias("end"), x["hit"].alias("text"), F.concat(left, F.lit(" "), right).alias("around"))

    size = lambda x: F.length(x["gap"]) + F.length(x["hit"])
    found = bound(bound(F.split(text, KINDS[kind], -1), cut), lambda rows: F.zip_with(rows, running(rows, size), span))
    return F.when(MAY_HOLD[kind](text), found).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,text:string,around:string>>"))


def _scored(spans: Column, kind: str) -> Column:
    said = lambda x, words: F.lower(x["around"]).rlike(words)
    moved = lambda x: F.lit(SCORE[kind]) + F.when(said(x, CONTEXT[kind]), CONTEXT_MOVES).otherwise(0.0) - F.when(said(x, AGAINST[kind]), CONTEXT_MOVES).otherwise(0.0)
    score = lambda x: F.round(F.least(moved(x), F.lit(1.0)), 2)
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["text"].alias("text"), score(x).alias("score")))


def _confirmed(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda x: ACCEPTED[kind](x["text"]))


def with_spans(docs: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """docs with `into`: array of struct(start, kind number, end, text, score), by start, then kind."""
    whole = F.coalesce(F.col(text), F.lit(""))
    found = {k: _scored(_confirmed(proposed(whole, k), k), k) for k in KINDS}
    kept = [c if k in BASE else F.filter(c, lambda x: x["score"] >= ACCEPT) for k, c in found.items()]
    return docs.withColumn(into, F.array_sort(F.concat(*kept)))


def _said(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, their digest, all spans, and the lowest score."""
    out = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    count = lambda k: F.size(F.filter("pii", lambda x: x["kind"] == list(KINDS).index(k))).cast("long")
    return out.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in BASE),
        F.sha2(_said(F.filter("pii", lambda x: x["kind"] < len(BASE))), 256).alias("base_sha256"),
        _said(F.col("pii")).alias("spans"),
        F.array_min(F.transform("pii", lambda x: x["score"])).alias("lowest_score"),
    )


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span of `text` replaced by its kind in angle brackets (overlapping spans by the first one's).

    All rows and columns stay; n_chars follows the text; a null text stays null.
    """
    out = with_spans(docs, into="__pii")
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    text = F.coalesce(F.col("text"), F.lit(""))

    def between(pieces: Column, a: Column, z: Column) -> Column:
        """Code points a to z of the text, out of its pieces."""
        first, last = F.floor(a / PIECE).cast("int"), F.floor(z / PIECE).cast("int")
        inside = F.substring(F.get(pieces, first), a % PIECE + F.lit(1), z - a)
        head = F.substring(F.get(pieces, first), a % PIECE + F.lit(1), F.lit(PIECE))
        middle = F.array_join(F.slice(pieces, first + F.lit(2), F.greatest(last - first - 1, F.lit(0))), "")
        tail = F.substring(F.coalesce(F.get(pieces, last), F.lit("")), F.lit(1), z % PIECE)
        return F.when(z <= a, "").when(first == last, inside).otherwise(F.concat(head, middle, tail))

    def cut(pieces: Column) -> Column:
        # a span that begins inside the ones before it only moves their end
        spans = F.zip_with("__pii", running(F.col("__pii"), lambda x: x["end"], most=True), lambda x, at: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), at.alias("at")))
        fresh = F.filter(spans, lambda x: x["start"] >= x["at"])
        said = F.transform(fresh, lambda x: F.concat(between(pieces, x["at"], x["start"]), F.get(names, x["kind"])))
        return F.concat(F.array_join(said, ""), between(pieces, F.array_max(F.transform("__pii", lambda x: x["end"])), F.length(text)))

    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / PIECE).cast("int")), lambda b: F.substring(text, b * PIECE + F.lit(1), F.lit(PIECE)))
    out = out.withColumn("text", F.when(F.size("__pii") > 0, bound(pieces, cut)).otherwise(F.col("text"))).drop("__pii")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
