"""Registered queries of the evaluation engine and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import evaluation as E
from ..operators import relational as R
from ..operators import vectors as V
from ..streaming.windows import event_counts

#: Trials read off lineitem: four choices with scores, a gold answer, a condition, a dose, a cluster.
P = """trials AS (
  SELECT l_orderkey * 8 + l_linenumber AS trial_id, l_partkey AS base_id, l_linenumber % 4 AS permutation, l_suppkey AS cluster,
    l_linestatus AS dataset, l_returnflag AS condition, CAST(floor(l_quantity / 10) AS INTEGER) AS dose,
    l_quantity / 50 AS n1, l_discount * 10 AS n2, l_tax * 12.5 AS n3, (floor(l_extendedprice) % 1000) / 1000 AS n4,
    CAST(l_partkey % 4 + 1 AS INTEGER) AS gold
  FROM lineitem), weights AS (
  SELECT *, least(n1, n2, n3, n4) AS m, CASE least(n1, n2, n3, n4) WHEN n1 THEN 1 WHEN n2 THEN 2 WHEN n3 THEN 3 ELSE 4 END AS prediction,
    CASE gold WHEN 1 THEN n1 WHEN 2 THEN n2 WHEN 3 THEN n3 ELSE n4 END AS g,
    CASE gold WHEN 1 THEN least(n2, n3, n4) WHEN 2 THEN least(n1, n3, n4) WHEN 3 THEN least(n1, n2, n4) ELSE least(n1, n2, n3) END AS d FROM trials), parts AS (
  SELECT *, exp(m-n1) + exp(m-n2) + exp(m-n3) + exp(m-n4) AS z FROM weights), scored AS (
  SELECT *, CAST(prediction = gold AS INTEGER) AS correct, d - g AS margin, 1 / z AS confidence,
    power(exp(m-n1)/z - CAST(gold = 1 AS INTEGER), 2) + power(exp(m-n2)/z - CAST(gold = 2 AS INTEGER), 2) + power(exp(m-n3)/z - CAST(gold = 3 AS INTEGER), 2) + power(exp(m-n4)/z - CAST(gold = 4 AS INTEGER), 2) AS brier,
    power(1 / z - CAST(prediction = gold AS INTEGER), 2) AS confidence_brier FROM parts)"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("trial_id"), F.col("l_partkey").alias("base_id"), (F.col("l_linenumber") % 4).alias("permutation"),
        F.col("l_suppkey").alias("cluster"), F.col("l_linestatus").alias("dataset"), F.col("l_returnflag").alias("condition"),
        F.floor(F.col("l_quantity") / 10).cast("int").alias("dose"),
        F.array(F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 12.5, (F.floor("l_extendedprice") % 1000) / 1000).alias("nll"),
        (F.col("l_partkey") % 4 + 1).cast("int").alias("gold"),
    )


def _r(*names: str) -> list:
    return [(F.round(n, 6) + F.lit(0.0)).alias(n) for n in names]  # no negative zero


def _rs(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)


_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def _query(name: str, sql: str | None = None):
    def keep(f):
        _QUERIES[name] = (f, sql)
        return f

    return keep


@_query("choice_scores", f"WITH {P} SELECT trial_id, prediction, correct, {_rs('margin', 'brier', 'confidence', 'confidence_brier')} FROM scored")
def choice_scores(spark, d):
    return E.scored(trials(spark, d)).select("trial_id", "prediction", "correct", *_r("margin", "brier", "confidence", "confidence_brier"))


@_query("summary", f"""WITH {P}, units AS (SELECT dataset, condition, base_id, count(*) n, sum(correct) c, avg(correct) a, avg(margin) m, avg(brier) b, avg(confidence_brier) cb, min(correct) k FROM scored GROUP BY ALL)
SELECT dataset, condition, CAST(sum(n) AS BIGINT) AS rows, count(*) AS units, round(sum(c) / sum(n), 6) AS accuracy_rows, round(avg(a), 6) AS accuracy, round(avg(m), 6) AS gold_margin, round(avg(b), 6) AS brier, round(avg(cb), 6) AS confidence_brier, round(avg(k), 6) AS all_rows_correct FROM units GROUP BY dataset, condition""")
def summary(spark, d):
    out = E.summary(E.scored(trials(spark, d)), ["dataset", "condition"])
    return out.select("dataset", "condition", "rows", "units", *_r("accuracy_rows", "accuracy", "gold_margin", "brier", "confidence_brier", "all_rows_correct"))


@_query("calibration", f"""WITH {P}, b AS (SELECT dataset, condition, least(floor(confidence * 10), 9) AS bin, count(*) n, sum(correct - confidence) gap FROM scored GROUP BY ALL)
SELECT dataset, condition, round(sum(abs(gap)) / sum(n), 6) AS ece, CAST(sum(n) AS BIGINT) AS rows FROM b GROUP BY dataset, condition""")
def calibration(spark, d):
    return E.calibration_error(E.scored(trials(spark, d)), ["dataset", "condition"]).select("dataset", "condition", *_r("ece"), "rows")


@_query("paired_contrast", f"""WITH {P}, k AS (SELECT base_id, permutation, dataset, cluster, count(*) FILTER (condition = 'A') nl, count(*) FILTER (condition = 'R') nr,
  max(correct) FILTER (condition = 'A') - max(correct) FILTER (condition = 'R') a, max(margin) FILTER (condition = 'A') - max(margin) FILTER (condition = 'R') m FROM scored WHERE condition IN ('A', 'R') GROUP BY ALL),
u AS (SELECT cluster, count(*) n, avg(a) a, avg(m) m FROM k WHERE nl = 1 AND nr = 1 GROUP BY cluster)
SELECT 'A_minus_R' AS contrast, CAST(sum(n) AS BIGINT) AS aligned_rows, count(*) AS units, round(avg(a), 6) AS accuracy_gain, round(avg(m), 6) AS margin_gain FROM u""")
def paired_contrast(spark, d):
    out = E.contrast(E.scored(trials(spark, d)), "A", "R", ["base_id", "permutation", "dataset"], "cluster")
    return out.select("contrast", "aligned_rows", "units", *_r("accuracy_gain", "margin_gain"))


@_query("dose_curve", f"""WITH {P}, p AS (SELECT condition, dose, avg(correct) AS g, count(*) AS rows FROM scored GROUP BY ALL),
w AS (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY dose) AS dose_index, max(g) OVER (PARTITION BY condition ORDER BY dose) AS r, max(g) OVER (PARTITION BY condition) * 0.9 AS t FROM p),
f AS (SELECT *, coalesce(r >= t AND coalesce(lag(r) OVER (PARTITION BY condition ORDER BY dose), -1) < t, FALSE) AS first_at_share FROM w)
SELECT condition, dose, rows, dose_index, round(g, 6) AS gain, round(r, 6) AS running_gain, round(t, 6) AS threshold, first_at_share FROM f""")
def dose_curve(spark, d):
    points = E.scored(trials(spark, d)).groupBy("condition", "dose").agg(F.avg("correct").alias("gain"), F.count("*").alias("rows"))
    return E.dose_curve(points, ["condition"], "dose", "gain").withColumn("dose_index", F.col("dose_index").cast("long")).select("condition", "dose", "rows", "dose_index", *_r("gain", "running_gain", "threshold"), "first_at_share")


@_query("bootstrap_mean", f"""WITH {P}, s AS (SELECT cluster, sum(correct) num, count(correct) den FROM scored GROUP BY cluster), c AS (SELECT *, row_number() OVER (ORDER BY CAST(cluster AS VARCHAR)) - 1 AS k FROM s),
z AS (SELECT count(*) AS g, sum(num) / sum(den) AS estimate FROM s), w AS (SELECT r, (('0x' || substr(md5(concat_ws('|', '42', '', r, i)), 1, 15))::BIGINT) % g AS k FROM z, range(1, 201) a(r), LATERAL (SELECT unnest(range(1, g + 1)) AS i)),
t AS (SELECT r, sum(num) / sum(den) AS theta FROM w JOIN c USING (k) GROUP BY r)
SELECT round(estimate, 6) AS estimate, round(quantile_cont(theta, 0.025), 6) AS low, round(quantile_cont(theta, 0.975), 6) AS high FROM t, z GROUP BY estimate""")
def bootstrap_mean(spark, d):
    return E.bootstrap_interval(E.scored(trials(spark, d)), "correct", "cluster", 200).select(*_r("estimate", "low", "high"))


@_query("unique_index", f"WITH {P} SELECT trial_id, max(base_id) AS base_id FROM trials GROUP BY trial_id HAVING count(*) = 1")
def unique_index(spark, d):
    return R.unique_only(trials(spark, d).select("trial_id", "base_id"), "trial_id")


@_query("key_audit", f"WITH {P}, k AS (SELECT trial_id, count(*) n FROM trials GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) FILTER (n = 1) AS unique_keys, count(*) FILTER (n > 1) AS repeated_keys, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS rows_dropped FROM k")
def key_audit(spark, d):
    return R.key_audit(trials(spark, d), "trial_id")


@_query("coverage_audit", "WITH e AS (SELECT DISTINCT o_orderkey k FROM orders), o AS (SELECT DISTINCT l_orderkey k FROM lineitem WHERE l_returnflag = 'R') SELECT count(*) FILTER (e.k IS NOT NULL AND o.k IS NOT NULL) AS evaluated, count(*) FILTER (o.k IS NULL) AS missing, count(*) FILTER (e.k IS NULL) AS extra FROM e FULL JOIN o ON e.k = o.k")
def coverage_audit(spark, d):
    orders = _table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    return R.coverage(orders, _table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k")), "k")


@_query("mode_funnel", f"""WITH {P}, i AS (SELECT base_id, dataset, bool_or(condition = 'A' AND correct = 1) t, bool_or(condition = 'N' AND correct = 1) s, bool_or(condition = 'R' AND correct = 1) r FROM scored GROUP BY ALL)
SELECT CASE WHEN grouping(dataset) = 1 THEN 'ALL' ELSE dataset END AS dataset, count(*) AS items, count(*) FILTER (t) AS text_only, count(*) FILTER (s AND NOT t) AS single, count(*) FILTER (r AND NOT s AND NOT t) AS reverse, count(*) FILTER (NOT (t OR s OR r)) AS hard, round(count(*) FILTER (NOT (t OR s OR r)) / greatest(count(*), 1), 6) AS hard_rate FROM i GROUP BY ROLLUP (dataset)""")
def mode_funnel(spark, d):
    ok = lambda c: F.bool_or((F.col("condition") == c) & (F.col("correct") == 1))
    items = E.scored(trials(spark, d)).groupBy("base_id", "dataset").agg(ok("A").alias("t"), ok("N").alias("s"), ok("R").alias("r"))
    hard = ~(F.col("t") | F.col("s") | F.col("r"))
    return R.with_all(
        items, "dataset", F.count("*").alias("items"), F.count_if("t").alias("text_only"), F.count_if(F.col("s") & ~F.col("t")).alias("single"),
        F.count_if(F.col("r") & ~F.col("s") & ~F.col("t")).alias("reverse"), F.count_if(hard).alias("hard"), F.round(F.count_if(hard) / F.greatest(F.count("*"), F.lit(1)), 6).alias("hard_rate"),
    )


@_query("group_scores", f"""WITH {P}, g AS (SELECT base_id, dataset, count(DISTINCT permutation) m, min(correct) FILTER (permutation IN (0, 1)) t, min(correct) FILTER (permutation IN (2, 3)) v FROM scored GROUP BY ALL),
f AS (SELECT dataset, count(*) n, sum(t) t, sum(v) v, sum(t * v) b FROM g WHERE m = 4 GROUP BY dataset), w AS (SELECT *, b / n AS p, 1.959963984540054 AS z FROM f)
SELECT dataset, n AS groups, round(t / n, 6) AS text_score, round(v / n, 6) AS video_score, round(p, 6) AS group_score,
  round(greatest(0, (p + z*z/(2*n) - z * sqrt(p*(1-p)/n + z*z/(4.0*n*n))) / (1 + z*z/n)), 6) AS low, round(least(1, (p + z*z/(2*n) + z * sqrt(p*(1-p)/n + z*z/(4.0*n*n))) / (1 + z*z/n)), 6) AS high FROM w""")
def group_scores(spark, d):
    least = lambda *p: F.min(F.when(F.col("permutation").isin(*p), F.col("correct")))
    groups = E.scored(trials(spark, d)).groupBy("base_id", "dataset").agg(F.count_distinct("permutation").alias("m"), least(0, 1).alias("t"), least(2, 3).alias("v")).where("m = 4")
    by = groups.groupBy("dataset").agg(F.count("*").alias("groups"), F.sum("t").alias("t"), F.sum("v").alias("v"), F.sum(F.col("t") * F.col("v")).alias("b"))
    low, high = S.wilson(F.col("b"), F.col("groups"))
    rate = lambda c, a: F.round(F.col(c) / F.col("groups"), 6).alias(a)
    return by.select("dataset", "groups", rate("t", "text_score"), rate("v", "video_score"), rate("b", "group_score"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@_query("rank_table", f"""WITH {P}, t AS (SELECT condition, avg(correct) a, avg(margin) m, avg(brier) b FROM scored GROUP BY 1),
s AS (SELECT condition, (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) AS x, (m - min(m) OVER ()) / (max(m) OVER () - min(m) OVER ()) AS y, 1 - (b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()) AS w FROM t)
SELECT condition, round((x + y + w) / 3, 6) AS overall, CAST(row_number() OVER (ORDER BY (x + y + w) / 3 DESC NULLS LAST, condition) AS INTEGER) AS place FROM s""")
def rank_table(spark, d):
    t = E.scored(trials(spark, d)).groupBy("condition").agg(F.avg("correct").alias("a"), F.avg("margin").alias("m"), F.avg("brier").alias("b"))
    return E.ranked(t, ["a", "m", "b"], ["b"], "condition").select("condition", *_r("overall"), "place")


@_query("pivot_accuracy", f"WITH {P} SELECT dataset, round(avg(correct) FILTER (condition = 'A'), 6) AS \"A\", round(avg(correct) FILTER (condition = 'N'), 6) AS \"N\", round(avg(correct) FILTER (condition = 'R'), 6) AS \"R\" FROM scored GROUP BY dataset")
def pivot_accuracy(spark, d):
    return E.scored(trials(spark, d)).groupBy("dataset").pivot("condition", ["A", "N", "R"]).agg(F.round(F.avg("correct"), 6))


@_query("unit_sample", f"WITH {P}, u AS (SELECT base_id, sha256(concat_ws('|', '42', CAST(base_id AS VARCHAR))) h FROM (SELECT DISTINCT base_id FROM trials)), c AS (SELECT base_id FROM u ORDER BY h, base_id LIMIT 25) SELECT base_id, count(*) AS rows FROM trials WHERE base_id IN (SELECT base_id FROM c) GROUP BY 1")
def unit_sample(spark, d):
    return R.hash_ranked(trials(spark, d), "base_id", 25, S.hash_rank(F.lit("42"), F.col("base_id"))).groupBy("base_id").agg(F.count("*").alias("rows"))


@_query("stable_ids", "SELECT p_partkey, substr(sha1(concat_ws('::', p_name, p_brand, CAST(p_size AS VARCHAR))), 1, 20) AS id FROM part")
def stable_ids(spark, d):
    return _table(spark, d, "part").select("p_partkey", S.stable_id(F.col("p_name"), F.col("p_brand"), F.col("p_size")).alias("id"))


@_query("leaking_units", "SELECT l_suppkey AS unit, count(DISTINCT l_linestatus) AS splits, count(*) AS rows FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linestatus) > 1")
def leaking_units(spark, d):
    return R.leaking_units(_table(spark, d, "lineitem").select(F.col("l_suppkey").alias("unit"), "l_linestatus"), "unit", "l_linestatus")


@_query("merged_intervals", """WITH i AS (SELECT l_suppkey AS k, l_extendedprice AS s, l_extendedprice + l_quantity AS e FROM lineitem),
w AS (SELECT *, CASE WHEN max(e) OVER x IS NULL OR s > max(e) OVER x + 5 THEN 1 ELSE 0 END f FROM i WINDOW x AS (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, sum(f) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) n FROM w)
SELECT k, round(min(s), 4) AS s, round(max(e), 4) AS e, count(*) AS parts FROM g GROUP BY k, n""")
def merged_intervals(spark, d):
    rows = _table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_extendedprice").alias("s"), (F.col("l_extendedprice") + F.col("l_quantity")).alias("e"))
    return R.merged_intervals(rows, "k", "s", "e", 5.0).select("k", F.round("s", 4).alias("s"), F.round("e", 4).alias("e"), "parts")


@_query("interval_join", "SELECT event_id, p_partkey FROM events JOIN part ON value >= p_retailprice - 900 AND value < p_retailprice - 900 + 2")
def interval_join(spark, d):
    spans = _table(spark, d, "part").select("p_partkey", (F.col("p_retailprice") - 900).alias("s"), (F.col("p_retailprice") - 900 + 2).alias("e"))
    return R.interval_join(_table(spark, d, "events").select("event_id", "value"), spans, "value", "s", "e", 10.0).select("event_id", "p_partkey")


@_query("shared_hard", f"WITH {P}, k AS (SELECT base_id, count(DISTINCT condition) n, bool_or(correct = 1) f FROM scored GROUP BY 1) SELECT base_id, NOT f AS in_none FROM k WHERE n = (SELECT count(DISTINCT condition) FROM trials)")
def shared_hard(spark, d):
    return R.in_all(E.scored(trials(spark, d)), "base_id", "condition", F.col("correct") == 1)


@_query("expanded_trials", "WITH b AS (SELECT p_partkey AS base_id, p_partkey % 4 + 1 AS gold, p_partkey % 2 AS kind FROM part), c(condition, for_kind) AS (VALUES ('full', 0), ('full', 1), ('clue', 1)) SELECT base_id, condition, CAST(s AS INTEGER) AS shift, (gold - 1 + s) % 4 + 1 AS answer FROM b JOIN c ON kind = for_kind, range(0, 4) r(s)")
def expanded_trials(spark, d):
    bases = _table(spark, d, "part").select(F.col("p_partkey").alias("base_id"), (F.col("p_partkey") % 4 + 1).alias("gold"), (F.col("p_partkey") % 2).alias("kind"))
    conditions = spark.createDataFrame([("full", 0), ("full", 1), ("clue", 1)], "condition string, for_kind int")
    return E.expanded(bases, conditions, 4).select("base_id", "condition", "shift", "answer")


@_query("adjacent_distance", """WITH v AS (SELECT label, embedding::DOUBLE[] e, lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) b FROM embeddings)
SELECT label, round(avg(1 - list_cosine_similarity(e, b)), 6) AS adjacent, count(*) AS pairs FROM v WHERE b IS NOT NULL GROUP BY label""")
def adjacent_distance(spark, d):
    return V.adjacent_distance(_table(spark, d, "embeddings"), "label", "vec_id", "embedding").select("label", *_r("adjacent"), "pairs")


@_query("pairwise_distance", """SELECT a.label AS label, round(avg(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS pairwise FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1""")
def pairwise_distance(spark, d):
    return V.mean_pairwise_distance(_table(spark, d, "embeddings"), "label", "embedding").select("label", *_r("pairwise"))


@_query("event_windows", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    return event_counts(_table(spark, d, "events")).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


from . import designs, records, reports, strict  # noqa: E402, F401  register their queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _QUERIES.items() if sql}
