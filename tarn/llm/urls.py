"""URL filter: host and path rules, and for URLs without a rule a character language-model ratio. DataFrame functions only.

Two variable-order Markov models over characters, of URLs that the rules accept and that they reject, share one table of
n-grams up to `ORDER` characters. An n-gram's probability given its context is smoothed with that of the n-gram without
its first character: p(g) = (n(g) + BETA * p(shorter g)) / (n(context) + BETA). A URL (host and path) is scored by the
log-likelihood difference of its characters, averaged over its length: for each, the ratio of its longest known n-gram,
and for every longer context that is known (the empty one of a character never seen, too) the factor
BETA / (n(context) + BETA) by which both models step down to the shorter one. The decision value is calibrated on a
fifth of the ruled URLs that the models have not seen, for least balanced error.

The table keeps every n-gram of the ruled URLs outside that fifth, so it grows with them. Only its commonest rows are
broadcast, at every size (each with at least 1 / `HOT_PARTS` of all counts, so no more than `HOT_PARTS` rows, about
2 MB): they keep hot n-grams out of the shuffle that the others join by. All other joins shuffle both sides.
Defined results: a null URL, or one without ://, has an empty host and path and no rule; its verdict is the method's for
the empty string. Without ruled URLs of both kinds every such verdict is allow. Repeated rows are judged each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: (verdict, host, path), fixed by the contract.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
ORDER, BETA = 5, 4.0
HOT_PARTS = 20_000
EDGE = 40.0
#: Strings that one task scores.
TASK_STRINGS = 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as a string, and its verdict; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _grams(rows: DataFrame, s: str) -> DataFrame:
    """rows with i, k and gram: the k characters that end at character i."""
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1)))).alias("i")
    out = rows.where(F.length(s) > 0).select("*", at)
    out = out.select("*", F.explode(F.sequence(F.lit(1), F.least(F.col("i"), F.lit(ORDER)))).alias("k"))
    return out.withColumn("gram", F.substring(F.col(s), F.col("i") - F.col("k") + F.lit(1), F.col("k")))


def model(judged: DataFrame) -> DataFrame:
    """(s, n, accepted) -> gram, ratio, n, a, r: the log of its probability among accepted URLs over that among rejected ones; its counts in all, in accepted and in rejected ones."""
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    counts = _grams(judged, "s").groupBy("gram").agg(n(F.col("accepted")).alias("a"), n(~F.col("accepted")).alias("r"), F.first("k").alias("k"))
    counts = stored(counts, "grams")
    whole = counts.where("k = 1").agg(F.sum("a").alias("a"), F.sum("r").alias("r"), F.count("*").alias("t")).first()
    pa = (F.col("a") + BETA / max(1, whole.t)) / F.lit(float((whole.a or 0) + BETA))
    pr = (F.col("r") + BETA / max(1, whole.t)) / F.lit(float((whole.r or 0) + BETA))
    total = [(F.col("a") + F.col("r")).alias("n"), "a", "r"]
    level = counts.where("k = 1").select("gram", pa.alias("pa"), pr.alias("pr"), *total)
    known = level
    context = counts.select(F.col("gram").alias("context"), F.col("a").alias("ca"), F.col("r").alias("cr"))
    for k in range(2, ORDER + 1):
        grams = counts.where(F.col("k") == k).withColumns({"context": F.substring("gram", 1, k - 1), "shorter": F.substring("gram", 2, k - 1)})
        joined = grams.join(context.hint("merge"), "context").join(level.select(F.col("gram").alias("shorter"), F.col("pa").alias("qa"), F.col("pr").alias("qr")).hint("merge"), "shorter")
        level = joined.select("gram", ((F.col("a") + BETA * F.col("qa")) / (F.col("ca") + BETA)).alias("pa"), ((F.col("r") + BETA * F.col("qr")) / (F.col("cr") + BETA)).alias("pr"), *total)
        level = stored(level, f"level{k}")
        known = known.unionByName(level)
    return stored(known.select("gram", (F.ln("pa") - F.ln("pr")).alias("ratio"), "n", "a", "r"), "model")


def scored(strings: DataFrame, table: DataFrame) -> DataFrame:
    """strings (s, distinct) -> s, score: mean over its characters of the log-likelihood difference (0: empty string or table).

    Strings travel as numbers; what is shuffled is the n-grams that are not broadcast, and of these what the table knows.
    """
    numbered = stored(strings.select("s").withColumn("id", F.monotonically_increasing_id()), "strings")
    # strings are few bytes beside their n-grams: a stated count keeps them from being merged into one task
    tasks = max(strings.sparkSession.sparkContext.defaultParallelism, -(-numbered.count() // TASK_STRINGS))
    spread = _grams(numbered.repartition(tasks, "id"), "s").select("id", "i", "k", "gram")
    letter = lambda c: F.sum(F.when(F.length("gram") == 1, F.col(c)).otherwise(0)).alias(c)
    size = table.agg(F.sum("n").alias("n"), letter("a"), letter("r")).first()
    escape = lambda a, r: F.ln(r + F.lit(BETA)) - F.ln(a + F.lit(BETA))
    table = table.select("gram", "n", F.struct("ratio", escape(F.col("a"), F.col("r")).alias("escape")).alias("known"))
    hot = F.col("n") >= float(size.n or 0) / HOT_PARTS
    found = spread.join(F.broadcast(table.where(hot).select("gram", "known")), "gram", "left")
    rest = found.where("known IS NULL").select("id", "i", "k", "gram").join(table.where(~hot).select("gram", "known").hint("merge"), "gram")
    # all that is known of a string, in its own row
    gather = lambda rows, name: rows.groupBy("id").agg(F.collect_list(F.struct("i", "k", "known.ratio", "known.escape")).alias(name))
    both = numbered.where(F.length("s") > 0).join(gather(found.where("known IS NOT NULL"), "x").hint("merge"), "id", "left").join(gather(rest, "y").hint("merge"), "id", "left")
    none = F.transform(F.sequence(F.lit(1), F.length("s")), lambda i: F.struct(i.alias("i"), F.lit(0).alias("k"), F.lit(None).cast("double").alias("ratio"), F.lit(None).cast("double").alias("escape")))
    listed = lambda c: F.coalesce(F.col(c), F.array().cast("array<struct<i:int,k:int,ratio:double,escape:double>>"))
    each = both.select("id", "s", F.explode(F.concat(none, listed("x"), listed("y"))).alias("g")).select("id", "s", "g.*")
    ends = [F.max(F.when(F.col("k") == c, F.col("escape"))).alias(f"e{c}") for c in range(1, ORDER)]
    places = each.groupBy("id", "i").agg(F.first("s").alias("s"), F.max("k").alias("k"), F.max_by("ratio", "k").alias("ratio"), *ends)
    # the contexts of a character are the n-grams that end before it
    before = Window.partitionBy("id").orderBy("i")
    places = places.select("id", "s", "k", "ratio", *(F.lag(f"e{c}").over(before).alias(f"e{c}") for c in range(1, ORDER)))
    longer = sum(F.when(F.col("k") <= c, F.coalesce(f"e{c}", F.lit(0.0))).otherwise(0.0) for c in range(1, ORDER))
    unseen = escape(F.lit(float(size.a or 0)), F.lit(float(size.r or 0)))
    return places.groupBy("id").agg(F.first("s").alias("s"), (F.sum(F.coalesce("ratio", unseen) + longer) / F.count("*")).alias("score")).select("s", "score")


def calibrated(scores: DataFrame) -> float:
    """(score, n, accepted) -> the decision value with least balanced error; 0 without both kinds.

    Scores are taken in bins of a hundredth; a score beyond +-`EDGE` is in the last bin on its side, where the models
    are surer than any decision needs, so the bins have a stated number.
    """
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    held = F.greatest(F.least(F.round("score", 2), F.lit(EDGE)), F.lit(-EDGE))
    bins = scores.groupBy(held.alias("bin")).agg(n(F.col("accepted")).alias("a"), n(~F.col("accepted")).alias("r"))
    sums = bins.agg(F.sum("a").alias("a"), F.sum("r").alias("r")).first()
    if not sums.a or not sums.r:
        return 0.0
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # at most 8001 bins
    error = F.coalesce(F.sum("a").over(below), F.lit(0)) / sums.a + 1 - F.coalesce(F.sum("r").over(below), F.lit(0)) / sums.r
    best = bins.select("bin", error.alias("error")).orderBy(F.round("error", 9), F.abs("bin"), "bin").first()
    return float(best.bin) - 0.005


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every row."""
    host, path = parts(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("by_rule"), F.concat("host", "path").alias("s"))
    strings = stored(rows.groupBy("s", "by_rule").agg(F.count("*").alias("n")), "urls")
    known = strings.where("by_rule IS NOT NULL").withColumn("accepted", F.col("by_rule") == "allow")
    fold = F.crc32("s") % 5 == 0
    table = model(known.where(~fold))
    scores = stored(scored(strings.select("s").distinct(), table), "scores")
    at = calibrated(known.where(fold).join(scores.hint("merge"), "s"))
    both = rows.join(scores.hint("merge"), "s", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    method = F.when(F.col("score") >= at, "allow").otherwise("block")
    return both.select("page_id", "host", "path", "rule", F.coalesce("by_rule", method).alias("verdict"), F.round("score", 6).alias("score"))
