"""Registered queries of paired, permuted and multi-part designs, answers and prompts, selections, digests and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import digests, sequences, text
from ..operators import designs as D
from ..operators import evaluation as E
from ..operators import relational as R
from ..operators import resampling
from ..operators import vectors as V
from .queries import P, _query, _r, _rs, _table, trials


def _scored(spark, d):
    return E.scored(trials(spark, d))


def _moved_gold(spark, d):
    """Trials whose gold answer depends on the role as well, so that a flip of the prediction can be right."""
    moved = (F.col("base_id") + (F.col("condition") == "R").cast("int")) % 4 + 1
    return E.scored(trials(spark, d).withColumn("gold", moved.cast("int")))


_MOVED = "moved AS (SELECT *, CAST((base_id + CAST(condition = 'R' AS INTEGER)) % 4 + 1 AS INTEGER) AS gold2, CAST(prediction = gold2 AS INTEGER) AS correct2 FROM scored)"


_PAIRS = f"""{_MOVED}, k AS (SELECT dataset, cluster, base_id, permutation, dose, count(*) FILTER (condition = 'A') n1, count(*) FILTER (condition = 'R') n2,
  max(prediction) FILTER (condition = 'A') p1, max(prediction) FILTER (condition = 'R') p2, max(correct2) FILTER (condition = 'A') c1, max(correct2) FILTER (condition = 'R') c2,
  max(gold2) FILTER (condition = 'A') g1, max(gold2) FILTER (condition = 'R') g2 FROM moved WHERE condition IN ('A', 'R') GROUP BY ALL),
w AS (SELECT *, n1 = 1 AND n2 = 1 AS whole, c1 = 1 AND c2 = 1 AS both_right FROM k)"""


def _role_pairs(spark, d):
    return D.role_pairs(_moved_gold(spark, d), ["dataset", "cluster", "base_id", "permutation", "dose"], "condition", "A", "R")


def _intervals(rows, *metrics: str):
    out = resampling.unit_intervals(rows, ["dataset"], ["base_id"], "cluster", list(metrics), 30)
    return out.select("dataset", *(F.round(F.col(m + end) + F.lit(1e-9), 6).alias(m + end) for m in metrics for end in ("", "_ci_low", "_ci_high")))


def _interval_sql(*metrics: str) -> str:
    """What `_intervals` gives, from units (dataset, cluster, metrics that may be null)."""
    each = lambda form: ", ".join(form.format(m=m) for m in metrics)
    ends = "round(any_value(point.{m}) + 1e-9, 6) AS {m}, round(quantile_cont(theta.{m}, 0.025) + 1e-9, 6) AS {m}_ci_low, round(quantile_cont(theta.{m}, 0.975) + 1e-9, 6) AS {m}_ci_high"
    return f"""sums AS (SELECT dataset, cluster, {each('sum({m}) AS {m}, count({m}) AS n_{m}')} FROM units GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY cluster::VARCHAR) - 1 AS place, count(*) OVER (PARTITION BY dataset) AS size FROM sums),
sizes AS (SELECT dataset, max(size) AS size FROM numbered GROUP BY ALL),
draws AS (SELECT dataset, r, (('0x' || substr(md5(concat_ws('|', '42', dataset, r, i)), 1, 15))::BIGINT) % size AS place FROM sizes, range(1, 31) a(r), LATERAL (SELECT unnest(range(1, size + 1)) AS i)),
theta AS (SELECT dataset, r, {each('sum({m}) / nullif(sum(n_{m}), 0) AS {m}')} FROM draws JOIN numbered USING (dataset, place) GROUP BY ALL),
point AS (SELECT dataset, {each('sum({m}) / nullif(sum(n_{m}), 0) AS {m}')} FROM sums GROUP BY ALL)
SELECT dataset, {each(ends)} FROM theta JOIN point USING (dataset) GROUP BY dataset"""


@_query("pair_metrics", f"""WITH {P}, {_PAIRS}
SELECT dataset, count(*) AS expected_units, count(*) FILTER (whole) AS complete_units, count(*) FILTER (n1 > 1 OR n2 > 1) AS ambiguous_units, round(count(*) FILTER (whole) / count(*), 6) AS coverage,
  round(avg(CAST(both_right AS INTEGER)) FILTER (whole), 6) AS both_correct, round(avg(CAST(p1 <> p2 AS INTEGER)) FILTER (whole), 6) AS semantic_flip,
  round(avg(CAST(both_right AND p1 <> p2 AND g1 <> g2 AS INTEGER)) FILTER (whole), 6) AS correct_semantic_flip, round(avg(CAST(p1 = p2 AS INTEGER)) FILTER (whole), 6) AS invariance,
  round(avg(CAST(both_right AND p1 = p2 AND g1 = g2 AS INTEGER)) FILTER (whole), 6) AS correct_invariance FROM w GROUP BY dataset""")
def pair_metrics(spark, d):
    return D.pair_metrics(_role_pairs(spark, d), ["dataset"]).select("dataset", "expected_units", "complete_units", "ambiguous_units", *_r("coverage", *D.PAIR_METRICS))


@_query("pair_intervals", f"""WITH {P}, {_PAIRS},
units AS (SELECT dataset, cluster, base_id, avg(CAST(both_right AS INTEGER)) AS both_correct, avg(CAST(p1 = p2 AS INTEGER)) AS invariance FROM w WHERE whole GROUP BY ALL),
{_interval_sql('both_correct', 'invariance')}""")
def pair_intervals(spark, d):
    seen = D.pair_observations(_role_pairs(spark, d)).where("whole")
    return _intervals(seen, "both_correct", "invariance")


_VOTES = """v AS (SELECT dataset, cluster, base_id, prediction, count(*) n, min(correct) c FROM scored GROUP BY ALL),
q AS (SELECT dataset, cluster, base_id, count(DISTINCT permutation) k FROM scored GROUP BY ALL),
u AS (SELECT dataset, cluster, base_id, sum(n) n, max(n) m, count(*) p, min(c) c FROM v GROUP BY ALL)"""


@_query("permutation_metrics", f"""WITH {P}, {_VOTES}
SELECT dataset, count(*) AS expected_units, count(*) FILTER (n = 2 AND k = 2) AS complete_units, round(avg(CAST(p = 1 AS INTEGER)) FILTER (n = 2 AND k = 2), 6) AS consistency,
  round(avg(m / n) FILTER (n = 2 AND k = 2), 6) AS stability, round(avg(c) FILTER (n = 2 AND k = 2), 6) AS all_correct FROM u JOIN q USING (dataset, cluster, base_id) GROUP BY dataset""")
def permutation_metrics(spark, d):
    units = D.permutation_units(_scored(spark, d), ["dataset", "cluster", "base_id"], 2)
    mean = lambda c: F.avg(F.when(F.col("complete"), F.col(c)))
    out = units.groupBy("dataset").agg(
        F.count("*").alias("expected_units"), F.count_if("complete").alias("complete_units"), mean("consistent").alias("consistency"), mean("stability").alias("stability"), mean("all_correct").alias("all_correct"))
    return out.select("dataset", "expected_units", "complete_units", *_r("consistency", "stability", "all_correct"))


@_query("permutation_intervals", f"""WITH {P}, {_VOTES},
units AS (SELECT dataset, cluster, base_id, CASE WHEN n = 2 AND k = 2 THEN CAST(p = 1 AS INTEGER) END AS consistent, CASE WHEN n = 2 AND k = 2 THEN m / n END AS stability, CASE WHEN n = 2 AND k = 2 THEN c END AS all_correct FROM u JOIN q USING (dataset, cluster, base_id)),
{_interval_sql('consistent', 'stability', 'all_correct')}""")
def permutation_intervals(spark, d):
    units = D.permutation_units(_scored(spark, d), ["dataset", "cluster", "base_id"], 2)
    metrics = ["consistent", "stability", "all_correct"]
    return _intervals(units.withColumns({m: F.when(F.col("complete"), F.col(m)) for m in metrics}), *metrics)


@_query("perturbation_flags", f"""WITH {P}, i AS (SELECT base_id, dataset, coalesce(bool_or(correct = 1) FILTER (condition = 'A'), FALSE) o, coalesce(bool_or(correct = 1) FILTER (condition = 'N'), FALSE) s, coalesce(bool_or(correct = 1) FILTER (condition = 'R'), FALSE) r FROM scored GROUP BY ALL)
SELECT CASE WHEN grouping(dataset) = 1 THEN 'ALL' ELSE dataset END AS dataset, count(*) AS items, count(*) FILTER (o) AS original_correct, count(*) FILTER (o AND r AND s) AS robust, count(*) FILTER (o AND NOT (r AND s)) AS temporal_sensitive, count(*) FILTER (NOT o AND (r OR s)) AS helped,
  round(count(*) FILTER (o AND r AND s) / greatest(count(*) FILTER (o), 1), 6) AS robust_given_original FROM i GROUP BY ROLLUP (dataset)""")
def perturbation_flags(spark, d):
    ok = lambda c: F.coalesce(F.bool_or((F.col("condition") == c) & (F.col("correct") == 1)), F.lit(False))
    items = _scored(spark, d).groupBy("base_id", "dataset").agg(ok("A").alias("o"), ok("N").alias("s"), ok("R").alias("r"))
    o, s, r = F.col("o"), F.col("s"), F.col("r")
    return R.with_all(
        items, "dataset", F.count("*").alias("items"), F.count_if(o).alias("original_correct"), F.count_if(o & r & s).alias("robust"), F.count_if(o & ~(r & s)).alias("temporal_sensitive"),
        F.count_if(~o & (r | s)).alias("helped"), F.round(F.count_if(o & r & s) / F.greatest(F.count_if(o), F.lit(1)), 6).alias("robust_given_original"))


@_query("variant_robustness", f"""WITH {P}, v AS (SELECT base_id, prediction, count(*) n, sum(correct) c, coalesce(max(correct) FILTER (permutation = 0), 0) z FROM scored GROUP BY ALL),
u AS (SELECT base_id, sum(n) n, sum(c) c, max(n) m, max(z) z FROM v GROUP BY 1)
SELECT base_id, CAST(n AS BIGINT) AS evaluated, CAST(c AS BIGINT) AS right_variants, c >= ceil(n * 0.3) AS robust, z = 1 AS canonical, round(m / n, 6) AS stability FROM u""")
def variant_robustness(spark, d):
    by = _scored(spark, d).groupBy("base_id", "prediction").agg(F.count("*").alias("n"), F.sum("correct").alias("c"), F.coalesce(F.max(F.when(F.col("permutation") == 0, F.col("correct"))), F.lit(0)).alias("z"))
    u = by.groupBy("base_id").agg(F.sum("n").alias("n"), F.sum("c").alias("c"), F.max("n").alias("m"), F.max("z").alias("z"))
    return u.select("base_id", F.col("n").alias("evaluated"), F.col("c").alias("right_variants"), (F.col("c") >= F.ceil(F.col("n") * F.lit(0.3).cast("decimal(2,1)"))).alias("robust"), (F.col("z") == 1).alias("canonical"), F.round(F.col("m") / F.col("n"), 6).alias("stability"))


@_query("exact_set_votes", f"""WITH {P}, o AS (SELECT cluster, base_id, gold, (unnest([0, 1, 2, 3]) + permutation) % 4 + 1 AS option, unnest([exp(m-n1)/z, exp(m-n2)/z, exp(m-n3)/z, exp(m-n4)/z]) AS p FROM scored),
a AS (SELECT cluster, base_id, option, round(avg(p), 9) p, min(gold) gold FROM o GROUP BY 1, 2, 3), t AS (SELECT *, max(p) OVER (PARTITION BY cluster, base_id) AS top FROM a),
c AS (SELECT cluster, base_id, count(*) FILTER (p = top) AS ties, bool_or(p = top AND option = gold) AS hit FROM t GROUP BY 1, 2)
SELECT cluster, count(*) AS candidates, count(*) FILTER (ties > 1) AS tied, min(CAST(ties = 1 AND hit AS INTEGER)) AS exact FROM c GROUP BY 1""")
def exact_set_votes(spark, d):
    return D.option_votes(_scored(spark, d), ["cluster"], "base_id", 4)


@_query("dose_contrast", f"""WITH {P}, x AS (SELECT *, base_id % 2 AS stratum, cluster % 4 AS slot, CASE WHEN condition = 'R' AND base_id % 2 = 0 THEN 0 ELSE dose END AS dose2 FROM scored WHERE condition IN ('A', 'R')),
s AS (SELECT stratum, min(dose2) <> max(dose2) AS several FROM x WHERE condition = 'R' GROUP BY 1),
t AS (SELECT x.*, CASE WHEN several THEN dose2 END AS join_dose FROM x JOIN s USING (stratum)),
l AS (SELECT stratum, permutation, slot, base_id, dose2, max(join_dose) join_dose, max(correct) c, max(margin) m FROM t WHERE condition = 'A' GROUP BY 1, 2, 3, 4, 5 HAVING count(*) = 1),
r AS (SELECT stratum, permutation, slot, base_id, join_dose, max(correct) c, max(margin) m FROM t WHERE condition = 'R' GROUP BY 1, 2, 3, 4, 5 HAVING count(*) = 1),
u AS (SELECT l.stratum, l.join_dose IS NOT NULL AS matched, l.base_id, count(*) n, avg(l.c - r.c) a, avg(l.m - r.m) m FROM l JOIN r ON l.stratum = r.stratum AND l.permutation = r.permutation AND l.slot = r.slot AND l.base_id = r.base_id AND l.join_dose IS NOT DISTINCT FROM r.join_dose GROUP BY 1, 2, 3)
SELECT stratum, CASE WHEN bool_or(matched) THEN 'matched_requested_dose' ELSE 'broadcast_single_dose' END AS dose_alignment, CAST(sum(n) AS BIGINT) AS aligned_rows, count(*) AS units, round(avg(a), 6) AS accuracy_gain, round(avg(m), 6) AS margin_gain FROM u GROUP BY 1""")
def dose_contrast(spark, d):
    stratum = F.col("base_id") % 2
    rows = _scored(spark, d).withColumn("stratum", stratum).withColumn("slot", F.col("cluster") % 4).withColumn("dose", F.when((F.col("condition") == "R") & (stratum == 0), 0).otherwise(F.col("dose")))
    return D.dose_contrast(rows, "A", "R", ["stratum"], ["permutation", "slot"], "base_id").select("stratum", "dose_alignment", "aligned_rows", "units", *_r("accuracy_gain", "margin_gain"))


_REPORTED = "reported AS (SELECT *, CASE WHEN trial_id % 5 = 0 THEN CAST(trial_id % 4 + 1 AS INTEGER) ELSE prediction END AS rp, CASE WHEN trial_id % 7 = 0 THEN 1 ELSE correct END AS rc, CASE WHEN trial_id % 11 = 0 THEN margin + 1 ELSE margin END AS rm FROM scored), issues AS (SELECT trial_id, dataset, unnest([CASE WHEN prediction <> rp THEN 'prediction_mismatch' END, CASE WHEN correct <> rc THEN 'correct_mismatch' END, CASE WHEN abs(margin - rm) > 2e-6 * greatest(1.0, abs(margin), abs(rm)) THEN 'margin_mismatch' END]) AS kind FROM reported)"


def _issues(spark, d):
    tid = F.col("trial_id")
    rows = _scored(spark, d).withColumns({
        "reported_prediction": F.when(tid % 5 == 0, (tid % 4 + 1).cast("int")).otherwise(F.col("prediction")),
        "reported_correct": F.when(tid % 7 == 0, 1).otherwise(F.col("correct")),
        "reported_margin": F.when(tid % 11 == 0, F.col("margin") + 1).otherwise(F.col("margin")),
    })
    return D.score_issues(rows)


@_query("score_issues", f"WITH {P}, {_REPORTED} SELECT trial_id, kind FROM issues WHERE kind IS NOT NULL")
def score_issues(spark, d):
    return _issues(spark, d).select("trial_id", "kind")


@_query("issue_gate", f"WITH {P}, {_REPORTED}, n AS (SELECT kind, count(*) n FROM issues WHERE kind IS NOT NULL GROUP BY 1) SELECT g.kind AS kind, coalesce(n, 0) AS rows, n IS NULL AS passed FROM (VALUES ('invalid_nll'), ('prediction_mismatch'), ('margin_mismatch')) g(kind) LEFT JOIN n ON n.kind = g.kind")
def issue_gate(spark, d):
    gate = spark.createDataFrame([("invalid_nll",), ("prediction_mismatch",), ("margin_mismatch",)], "kind string")
    counts = _issues(spark, d).groupBy("kind").agg(F.count("*").alias("n"))
    return gate.join(counts, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("rows"), F.col("n").isNull().alias("passed"))


@_query("design_histograms", f"WITH {P}, h AS (SELECT unnest(['gold', 'condition', 'dataset', 'dose']) AS field, unnest([CAST(gold AS VARCHAR), condition, dataset, CAST(dose AS VARCHAR)]) AS value FROM trials) SELECT field, value, count(*) AS rows FROM h GROUP BY 1, 2")
def design_histograms(spark, d):
    return D.histograms(trials(spark, d), ["gold", "condition", "dataset", "dose"])


@_query("category_means", "WITH c AS (SELECT p_retailprice, unnest(list_distinct(list_concat(['ALL'], string_split(p_type, ' ')))) AS category FROM part) SELECT category, count(*) AS rows, round(avg(p_retailprice), 4) AS mean_price FROM c GROUP BY 1")
def category_means(spark, d):
    categories = F.array_union(F.array(F.lit("ALL")), F.split("p_type", " "))
    return _table(spark, d, "part").select("p_retailprice", F.explode(categories).alias("category")).groupBy("category").agg(F.count("*").alias("rows"), F.round(F.avg("p_retailprice"), 4).alias("mean_price"))


@_query("shard_assignment", """WITH k AS (SELECT p_partkey, sha256(p_name) AS h FROM part), d AS (SELECT p_partkey, h, [instr('0123456789abcdef', c) - 1 for c in string_split(h, '')] AS x FROM k)
SELECT p_partkey, list_reduce(list_concat([0::BIGINT], x), lambda a, c: (a * 16 + c) % 7) AS worker, list_reduce(list_concat([0::BIGINT], x[1:16]), lambda a, c: (a * 16 + c) % 5) AS shard FROM d""")
def shard_assignment(spark, d):
    return _table(spark, d, "part").select("p_partkey", digests.worker(F.sha2("p_name", 256), 7).alias("worker"), digests.shard(F.col("p_name"), 5).alias("shard"))


@_query("set_identity", """WITH k AS (SELECT DISTINCT sha256(concat_ws('|', CAST(o_orderkey AS VARCHAR), o_orderstatus)) AS h FROM orders), p AS (SELECT substr(h, 1, 4) p, count(*) n, sha256(string_agg(h, ',' ORDER BY h)) g FROM k GROUP BY 1)
SELECT sha256(string_agg(g, ',' ORDER BY p)) AS root, CAST(sum(n) AS BIGINT) AS members FROM p""")
def set_identity(spark, d):
    rows = _table(spark, d, "orders").select(F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus"), 256).alias("h"))
    return digests.set_identity(rows, "h")


_CHOICES = "[p_name, p_brand, p_type, CAST(p_size AS VARCHAR)]"


def _choices(spark, d):
    parts = _table(spark, d, "part").withColumn("choices", F.array("p_name", "p_brand", "p_type", F.col("p_size").cast("string")))
    return parts.withColumn("order", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: ((i + F.col("p_partkey")) % 4).cast("int")))


@_query("permuted_prompts", f"""WITH c AS (SELECT p_partkey, {_CHOICES} AS c FROM part), o AS (SELECT *, [c[(i + p_partkey) % 4 + 1] for i in range(0, 4)] AS q FROM c)
SELECT p_partkey, 'Which?' || chr(10) || 'A. ' || q[1] || chr(10) || 'B. ' || q[2] || chr(10) || 'C. ' || q[3] || chr(10) || 'D. ' || q[4] || chr(10) || 'Answer:' AS prompt, chr(CAST(65 + (4 - p_partkey % 4) % 4 AS INTEGER)) AS answer, array_to_string(c, '|') AS restored FROM o""")
def permuted_prompts(spark, d):
    rows = _choices(spark, d).withColumn("shown", text.permuted(F.col("choices"), F.col("order")))
    return rows.select(
        "p_partkey", text.prompt(F.lit("Which?"), F.col("shown")).alias("prompt"), text.option_label(F.array_position("order", F.lit(0)) - 1).alias("answer"),
        F.array_join(text.restored(F.col("shown"), F.col("order")), "|").alias("restored"))


@_query("normalized_answers", f"""WITH c AS (SELECT p_partkey, {_CHOICES} AS c, CASE p_partkey % 4 WHEN 0 THEN '(b).' WHEN 1 THEN upper(p_brand) WHEN 2 THEN ' ' || p_name || ' ' ELSE 'Z' END AS said FROM part)
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'B' WHEN 1 THEN 'B' WHEN 2 THEN 'A' END AS answer FROM c""")
def normalized_answers(spark, d):
    k = F.col("p_partkey") % 4
    said = F.when(k == 0, "(b).").when(k == 1, F.upper("p_brand")).when(k == 2, F.concat(F.lit(" "), "p_name", F.lit(" "))).otherwise("Z")
    return _choices(spark, d).select("p_partkey", text.normalized_answer(said, F.col("choices")).alias("answer"))


@_query("text_forms", "SELECT p_partkey, regexp_replace(p_brand || '/' || p_name, '[^A-Za-z0-9_-]', '_', 'g') AS safe_id, regexp_replace(regexp_replace(p_brand, '[0-9]', '0', 'g'), '[A-Za-z]', 'x', 'g') AS sham, printf('%.1f%%', 100.0 * p_size / 50) AS share FROM part")
def text_forms(spark, d):
    return _table(spark, d, "part").select(
        "p_partkey", text.safe_id(F.concat("p_brand", F.lit("/"), "p_name")).alias("safe_id"), text.sham(F.col("p_brand")).alias("sham"), text.percent_text(F.col("p_size"), F.lit(50)).alias("share"))


@_query("frame_picks", """WITH f AS (SELECT p_partkey, range(0, p_size + 7) AS f, p_size + 6 AS last, (p_size + 7) // 2 AS half FROM part)
SELECT p_partkey, array_to_string([CAST(round_even(s * last / 4, 0) AS BIGINT) for s in range(0, 5)], ',') AS evenly, array_to_string([x for x in f if x % 2 = 0], ',') AS strided,
  array_to_string(list_concat(f[half + 1:], f[1:half]), ',') AS swapped, array_to_string(list_reverse(f), ',') AS reversed,
  array_to_string([CAST(round_even((j + 1) * (last + 1) / 3, 0) - round_even(j * (last + 1) / 3, 0) AS BIGINT) for j in range(0, 3)], ',') AS segment_sizes FROM f""")
def frame_picks(spark, d):
    rows = _table(spark, d, "part").withColumn("f", F.sequence(F.lit(0), F.col("p_size") + 6))
    said = lambda c, a: F.array_join(c, ",").alias(a)
    f = F.col("f")
    return rows.select(
        "p_partkey", said(sequences.evenly(f, 5), "evenly"), said(sequences.strided(f), "strided"), said(sequences.swapped_halves(f), "swapped"), said(F.reverse(f), "reversed"),
        said(F.transform(sequences.segments(f, 3), lambda s: F.size(s)), "segment_sizes"))


@_query("quota_sample", "SELECT o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256(concat_ws('|', '42', CAST(o_orderkey AS VARCHAR))), o_orderkey) <= 20")
def quota_sample(spark, d):
    return R.quota(_table(spark, d, "orders"), "o_orderpriority", 20, F.sha2(F.concat_ws("|", F.lit("42"), F.col("o_orderkey").cast("string")), 256), "o_orderkey").select("o_orderkey", "o_orderpriority")


@_query("label_questions", """WITH u AS (SELECT b, row_number() OVER (ORDER BY sha256(b), b) - 1 AS pos, count(*) OVER () AS size FROM (SELECT DISTINCT p_brand AS b FROM part)),
s AS (SELECT p_partkey, p_brand, CAST(('0x' || substr(sha256(CAST(p_partkey AS VARCHAR)), 1, 15))::BIGINT % (SELECT max(size) FROM u) AS BIGINT) AS start FROM part),
c AS (SELECT p_partkey, p_brand, b, j FROM s, (SELECT max(size) AS z FROM u), range(0, 4) r(j) JOIN u ON pos = (start + j) % z WHERE j < z AND b <> p_brand),
k AS (SELECT p_partkey, p_brand, b FROM c QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY j) <= 3 UNION ALL SELECT p_partkey, p_brand, p_brand FROM part),
o AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY sha256(concat_ws('|', 'order', CAST(p_partkey AS VARCHAR), b)), b) n FROM k)
SELECT p_partkey, string_agg(b, '|' ORDER BY n) AS choices, max(chr(CAST(64 + n AS INTEGER))) FILTER (b = p_brand) AS answer FROM o GROUP BY 1""")
def label_questions(spark, d):
    return E.label_questions(_table(spark, d, "part"), "p_partkey", "p_brand", 3).select("p_partkey", F.array_join("choices", "|").alias("choices"), "answer")


@_query("far_distance", """WITH v AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k, embedding::DOUBLE[] e FROM embeddings)
SELECT a.label AS label, round(avg(1 - list_cosine_similarity(a.e, b.e)), 6) AS far FROM v a JOIN v b ON a.label = b.label AND b.k >= a.k + 2 GROUP BY 1""")
def far_distance(spark, d):
    return V.far_distance(_table(spark, d, "embeddings"), "label", "vec_id", "embedding").select("label", *_r("far"))


@_query("gap_correlation", """WITH v AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k, embedding::DOUBLE[] e FROM embeddings)
SELECT a.label AS label, round(corr(b.k - a.k, 1 - list_cosine_similarity(a.e, b.e)), 5) AS correlation FROM v a JOIN v b ON a.label = b.label AND b.k > a.k GROUP BY 1""")
def gap_correlation(spark, d):
    return V.gap_correlation(_table(spark, d, "embeddings"), "label", "vec_id", "embedding").select("label", F.round("correlation", 5).alias("correlation"))


@_query("label_agreement", """WITH s AS (SELECT a.vec_id AS q, a.label AS l, b.label AS o, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 12) DESC, b.vec_id) AS r FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
k AS (SELECT q, max(CAST(r = 1 AND l = o AS INTEGER)) AS f, max(CAST(l = o AS INTEGER)) AS n FROM s WHERE r <= 5 GROUP BY q) SELECT count(*) AS examples, round(avg(f), 6) AS top1, round(avg(n), 6) AS topk FROM k""")
def label_agreement(spark, d):
    return V.label_agreement(_table(spark, d, "embeddings"), "vec_id", "label", "embedding", 5).select("examples", *_r("top1", "topk"))


@_query("two_way_closure", "WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 9 = 0 THEN 'X' ELSE o_orderstatus END AS v FROM orders) SELECT 'missing' AS side, k, v FROM (FROM a EXCEPT ALL FROM b) UNION ALL SELECT 'extra', k, v FROM (FROM b EXCEPT ALL FROM a)")
def two_way_closure(spark, d):
    orders = _table(spark, d, "orders")
    a = orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    return R.differences(a, a.withColumn("v", F.when(F.col("k") % 9 == 0, "X").otherwise(F.col("v"))))


@_query("effective_rank")
def effective_rank(spark, d):
    return V.effective_rank(_table(spark, d, "embeddings"), "label", "embedding", 64).select("label", "n", *_r("rank", "rank_ratio", "top_energy"))
