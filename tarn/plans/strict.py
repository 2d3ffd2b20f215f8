"""Registered queries of preparation, validation, trials, frames, identities and connectors, on rows read off the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import digests as D
from ..functions import fields as X
from ..functions import records as R
from ..functions import scores as S
from ..functions import text as T
from ..operators import frames as V
from ..operators import locks as L
from ..operators import preparation as Q
from ..operators import trials as G
from ..operators import validation as W
from ..sources import connectors as C
from ..sources import manifests as M
from .queries import P, _query, _table, trials


def _letter(c):
    return F.char(F.col(c) + 64)


def _predictions(spark, d):
    """Scored rows with faults of several kinds, and their manifest."""
    from ..operators import evaluation as E

    rows = E.scored(trials(spark, d)).withColumnRenamed("base_id", "k")
    b = F.col("k")
    bad = lambda n, other, good: F.when(b % n == 0, other).otherwise(good)
    labels = F.array(*map(F.lit, "ABCD"))
    out = rows.select(
        bad(97, F.lit(" "), F.concat(F.lit("t"), F.col("trial_id").cast("string"))).alias("trial_id"), F.concat(F.lit("b"), b.cast("string")).alias("base_id"), F.lit("diag").alias("dataset"), F.lit("temporal_order").alias("information_family"), F.lit("q").alias("question_family"),
        bad(13, F.lit(None), F.lit("1")).alias("reasoning_depth"), F.lit("full_video").alias("condition"), bad(11, F.lit(""), F.lit("visual")).alias("input_channel"), F.lit("0").alias("requested_dose"), F.lit("0.0").alias("effective_dose"), F.lit("0").alias("permutation_index"),
        bad(23, F.array(F.lit("a")), F.array(*map(F.lit, ["one", "two", "three", "Four "]))).alias("choices"), _letter("gold").alias("answer"), bad(29, F.lit("Z"), _letter("prediction")).alias("prediction"), bad(31, F.lit("five"), F.element_at(F.array(*map(F.lit, ["ONE", "two", "three", "four"])), F.col("prediction"))).alias("prediction_text"),
        bad(7, F.lit("maybe"), F.when(F.col("correct") == 1, "yes").otherwise("0")).alias("correct"), bad(17, F.lit(None), F.col("margin") + F.when(b % 37 == 0, 0.5).otherwise(0.0)).alias("gold_margin"),
        F.map_from_arrays(labels, F.transform("probability", lambda x: x + F.when(b % 41 == 0, 0.01).otherwise(0.0))).alias("choice_probability"),
        F.when(b % 19 == 0, F.map_from_arrays(F.slice(labels, 1, 3), F.slice("nll", 1, 3))).otherwise(F.map_from_arrays(labels, "nll")).alias("choice_nll"), F.get("nll", F.col("gold") - 1).alias("gold_nll"), F.array_min(F.filter("nll", lambda x, i: i + 1 != F.col("gold"))).alias("best_distractor_nll"),
        bad(2, F.lit("x"), F.sha2(F.lit("r"), 256)).alias("result_content_sha256"), bad(3, F.lit(None), F.sha2(F.lit("s"), 256)).alias("scoring_run_signature_sha256"), bad(5, F.lit("g"), F.sha2(F.lit("g"), 256)).alias("scoring_global_signature_sha256"), F.col("permutation"),
    )
    manifest = out.where("permutation <> 3").select("trial_id", "base_id", "dataset", "information_family", F.when(F.col("base_id").endswith("5"), "other").otherwise("q").alias("question_family"), "condition", "requested_dose", "choices", "answer")
    return out.drop("permutation"), manifest


_FAULTY = f"""{P}, raw AS (SELECT *, CASE WHEN base_id % 97 = 0 THEN NULL ELSE 't' || trial_id END AS id, base_id % 23 <> 0 AS listed, ['one', 'two', 'three', 'four'] AS names FROM scored),
twice AS (SELECT id FROM raw WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1), own AS (SELECT * FROM raw WHERE id IS NOT NULL AND id NOT IN (FROM twice)),
man AS (SELECT * FROM raw WHERE permutation <> 3 AND id IS NOT NULL), mtwice AS (SELECT id FROM man GROUP BY id HAVING count(*) > 1), expected AS (SELECT * FROM man WHERE id NOT IN (FROM mtwice)),
both_sides AS (SELECT * FROM own WHERE id IN (SELECT id FROM expected))"""
#: Kinds of issue on one joined row, as (kind, condition on the row).
_ROW_KINDS = [
    ("prediction_manifest_mismatch", "base_id % 10 = 5"), ("missing_group_field", "base_id % 13 = 0"), ("missing_input_channel", "base_id % 11 = 0"), ("invalid_correct", "base_id % 7 = 0"), ("invalid_gold_margin", "base_id % 17 = 0"), ("invalid_choices", "NOT listed"),
    ("invalid_prediction_label", "listed AND base_id % 29 = 0"), ("correct_prediction_inconsistency", "listed AND base_id % 7 <> 0 AND base_id % 29 = 0 AND correct = 1"), ("prediction_text_choice_mismatch", "listed AND base_id % 29 <> 0 AND base_id % 31 = 0"),
    ("invalid_choice_nll_key_set", "listed AND base_id % 19 = 0"), ("choice_probability_nll_inconsistency", "listed AND base_id % 19 <> 0 AND base_id % 41 = 0"), ("prediction_nll_inconsistency", "listed AND base_id % 19 <> 0 AND base_id % 29 = 0"),
    ("gold_margin_nll_inconsistency", "listed AND base_id % 19 <> 0 AND (base_id % 17 = 0 OR base_id % 37 = 0)"), ("correct_nll_inconsistency", "listed AND base_id % 19 <> 0 AND base_id % 7 = 0"),
]
_ISSUES_SQL = f"""{_FAULTY}, issues AS (
  SELECT 'prediction_missing_trial_id' AS kind, count(*) AS n FROM raw WHERE id IS NULL UNION ALL SELECT 'duplicate_prediction_trial_id', count(*) FROM twice UNION ALL SELECT 'manifest_missing_trial_id', count(*) FROM raw WHERE id IS NULL AND permutation <> 3
  UNION ALL SELECT 'duplicate_manifest_trial_id', count(*) FROM mtwice UNION ALL SELECT 'missing_or_invalid_result_content_sha256', count(*) FROM own WHERE base_id % 2 = 0 UNION ALL SELECT 'missing_scoring_run_signature_sha256', count(*) FROM own WHERE base_id % 3 = 0
  UNION ALL SELECT 'invalid_scoring_global_signature_sha256', count(*) FROM own WHERE base_id % 5 = 0 UNION ALL SELECT 'mixed_scoring_global_signatures', CAST(count(DISTINCT base_id % 5 = 0) > 1 AS BIGINT) FROM own
  UNION ALL SELECT 'missing_prediction_trial', count(*) FROM expected WHERE id NOT IN (SELECT id FROM raw WHERE id IS NOT NULL) UNION ALL SELECT 'unexpected_prediction_trial', count(*) FROM own WHERE id NOT IN (SELECT id FROM expected)
  {' '.join(f"UNION ALL SELECT '{k}', count(*) FROM both_sides WHERE {w}" for k, w in _ROW_KINDS)})"""


@_query("preparation_issues", f"WITH {_ISSUES_SQL} SELECT kind, n FROM issues WHERE n > 0")
def preparation_issues(spark, d):
    return Q.issue_counts(Q.prepared(*map(Q.flattened, _predictions(spark, d)))[2])


@_query("strict_failures", f"WITH {_ISSUES_SQL} SELECT kind AS reason FROM issues WHERE n > 0 AND kind NOT LIKE 'duplicate%' AND kind NOT IN ('missing_prediction_trial', 'unexpected_prediction_trial', 'prediction_manifest_mismatch')")
def strict_failures(spark, d):
    return Q.failures(Q.issue_counts(Q.prepared(*map(Q.flattened, _predictions(spark, d)))[2]))


@_query("prepared_rows", f"""WITH {_FAULTY} SELECT id AS trial_id, CASE WHEN base_id % 10 = 5 THEN 'other' ELSE 'q' END AS question_family, CASE WHEN listed AND base_id % 19 <> 0 THEN chr(64 + prediction) WHEN base_id % 29 = 0 THEN 'Z' ELSE chr(64 + prediction) END AS prediction,
  CASE WHEN listed AND base_id % 19 <> 0 THEN CASE correct WHEN 1 THEN 'true' ELSE 'false' END WHEN base_id % 7 = 0 THEN 'maybe' WHEN correct = 1 THEN 'yes' ELSE '0' END AS correct FROM both_sides""")
def prepared_rows(spark, d):
    return Q.prepared(*map(Q.flattened, _predictions(spark, d)))[0].select("trial_id", "question_family", "prediction", "correct")


@_query("probability_faults", """WITH r AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_linenumber AS k FROM lineitem) SELECT CASE k WHEN 1 THEN 'invalid_choice_probability' WHEN 2 THEN 'invalid_choice_probability_key_set' WHEN 3 THEN 'invalid_choice_probability_value' WHEN 4 THEN 'invalid_choice_probability_total' ELSE 'none' END AS kind, count(*) AS n FROM r GROUP BY 1""")
def probability_faults(spark, d):
    k = F.col("l_linenumber")
    m = lambda *kv: F.create_map(*(F.lit(x) for x in kv)).cast("map<string,double>")
    p = F.when(k == 1, F.lit(None).cast("map<string,double>")).when(k == 2, m("A", 1.0, "C", 1.0)).when(k == 3, m("A", 1.0, "B", -1.0)).when(k == 4, m("A", 0.0, "B", 0.0)).otherwise(m("A", 2.0, "B", 1.0))
    rows = _table(spark, d, "lineitem").select(F.coalesce(Q.probability_error(p, F.array(F.lit("x"), F.lit("y"))), F.lit("none")).alias("kind"))
    return rows.groupBy("kind").agg(F.count("*").alias("n"))


@_query("candidate_sets", """WITH r AS (SELECT l_orderkey AS q, l_linenumber AS c, l_suppkey % 50 = 0 AS blank, l_partkey % 40 = 0 AS torn FROM lineitem), n AS (SELECT l_orderkey AS q, count(*) AS n FROM lineitem GROUP BY 1),
g AS (SELECT r.q, count(*) AS rows, n.n + CAST(r.q % 7 = 0 AS INTEGER) AS want, count(DISTINCT CASE WHEN blank THEN '' WHEN torn THEN '1' ELSE CAST(c AS VARCHAR) END) AS ids, count(*) FILTER (blank) AS blanks, bool_or(r.q % 11 = 0 AND c = 1) AS uncounted FROM r JOIN n ON r.q = n.q GROUP BY ALL),
k AS (SELECT CASE WHEN uncounted THEN ['clevrer_invalid_official_candidate_count'] ELSE list_filter([CASE WHEN blanks > 0 THEN 'clevrer_missing_official_candidate_id' END, CASE WHEN ids <> rows THEN 'clevrer_duplicate_official_candidate_id' END, CASE WHEN rows <> want OR ids <> want THEN 'clevrer_incomplete_official_candidate_set' END], lambda x: x IS NOT NULL) END AS kinds FROM g),
e AS (SELECT unnest(kinds) AS kind FROM k UNION ALL SELECT 'clevrer_missing_resampling_unit_id' FROM lineitem WHERE l_orderkey % 13 = 0) SELECT kind, count(*) AS n FROM e GROUP BY 1""")
def candidate_sets(spark, d):
    li = _table(spark, d, "lineitem")
    counts = li.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    rows = li.join(counts, "l_orderkey").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("trial_id"), F.lit(" CLEVRER").alias("dataset"), F.when(F.col("l_orderkey") % 13 != 0, F.col("l_orderkey").cast("string")).alias("resampling_unit_id"), F.col("l_orderkey").cast("string").alias("independent_unit_id"), F.lit("c").alias("condition"),
        F.lit("0").alias("requested_dose"), F.lit("0.0").alias("effective_dose"), F.lit("0").alias("permutation_index"), F.when(F.col("l_suppkey") % 50 == 0, " ").when(F.col("l_partkey") % 40 == 0, "1").otherwise(F.col("l_linenumber").cast("string")).alias("official_candidate_id"),
        F.when((F.col("l_orderkey") % 11 == 0) & (F.col("l_linenumber") == 1), F.lit("0")).otherwise((F.col("n") + (F.col("l_orderkey") % 7 == 0).cast("int")).cast("string")).alias("official_candidate_count"))
    return Q.issue_counts(Q.candidate_set_issues(rows))


def _records(spark, d):
    """Base records read off part: two records a pair family, with faults."""
    k = F.col("p_partkey")
    part = _table(spark, d, "part")
    bad = lambda n, other, good: F.when(k % n == 0, other).otherwise(good)
    role = F.when(k % 3 == 0, "standalone").when(k % 2 == 0, "original").otherwise("counterfactual")
    family = F.floor(k / 6) * 2 + F.when(k % 6 < 3, 0).otherwise(1)
    span = lambda a, b: F.struct(a.cast("double").alias("start"), b.cast("double").alias("end"), F.lit("seconds").alias("unit"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("event_id"))
    return R.record(part, {
        "id": bad(47, F.lit(" "), F.concat(F.lit("r"), k.cast("string"))), "source": F.lit("s"), "benchmark": F.lit("b"), "media_path": bad(43, F.lit(""), F.concat(F.lit("/m/"), (k % 700).cast("string"))), "question": F.col("p_name"),
        "choices": bad(41, F.array(F.lit("x"), F.lit(" X ")), F.array(F.lit("red"), F.lit("green"), F.lit("blue"))), "answer": bad(37, F.lit("purple"), F.char(65 + k % 3)), "dataset": F.lit("diag"), "split": bad(53, F.lit("train"), F.lit("eval")),
        "information_family": bad(31, F.lit("odd"), F.lit("static")), "question_family": F.lit("q"), "reasoning_depth": bad(29, F.lit(4), F.lit(1)), "resampling_unit_id": F.concat(F.lit("u"), F.floor(k / 10).cast("string")), "pair_id": F.when(k % 3 == 0, F.concat(F.lit("standalone:r"), k.cast("string"))).otherwise(F.concat(F.lit("p"), family.cast("string"))),
        "pair_role": role, "evidence_spans": bad(23, F.array(span(F.lit(2), F.lit(1)), span(F.lit(0), F.lit(1))), F.array(span(F.lit(0), F.col("p_size")))), "official_candidate_id": bad(19, F.lit("1"), F.lit(None).cast("string")), "provenance": bad(59, F.create_map(F.lit("x"), F.lit("y")), F.create_map(F.lit("source_id"), F.lit("z"))),
    })


@_query("record_issues", """WITH k AS (SELECT p_partkey AS k FROM part), i AS (
  SELECT 'id' AS path, count(*) AS n FROM k WHERE k % 47 = 0 UNION ALL SELECT 'media_path', count(*) FROM k WHERE k % 43 = 0 UNION ALL SELECT 'choices', count(*) FROM k WHERE k % 41 = 0
  UNION ALL SELECT 'answer', count(*) FROM k WHERE k % 37 = 0 OR (k % 41 = 0 AND k % 3 = 2) UNION ALL SELECT 'diagnostic.information_family', count(*) FROM k WHERE k % 31 = 0 UNION ALL SELECT 'diagnostic.reasoning_depth', count(*) FROM k WHERE k % 29 = 0
  UNION ALL SELECT 'diagnostic.evidence_spans[0].end', count(*) FROM k WHERE k % 23 = 0 UNION ALL SELECT 'diagnostic.official_candidate_id', count(*) FROM k WHERE k % 19 = 0 UNION ALL SELECT 'diagnostic.provenance.source_id', count(*) FROM k WHERE k % 59 = 0) SELECT * FROM i WHERE n > 0""")
def record_issues(spark, d):
    return W.record_report(_records(spark, d)).groupBy("path").agg(F.count("*").alias("n"))


@_query("split_leaks", """WITH k AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 53 = 0 THEN 'train' ELSE 'eval' END AS s FROM part),
m AS (SELECT k % 700 AS x FROM k WHERE k % 43 <> 0 GROUP BY 1 HAVING count(DISTINCT s) > 1), u AS (SELECT k // 10 AS x FROM k GROUP BY 1 HAVING count(DISTINCT s) > 1),
f AS (SELECT (k // 6) * 2 + CASE WHEN k % 6 < 3 THEN 0 ELSE 1 END AS x, count(DISTINCT s) AS s, count(DISTINCT k // 10) AS u FROM k WHERE k % 3 <> 0 GROUP BY 1), i AS (
SELECT 'same media appears in multiple splits' AS message, count(*) AS n FROM m UNION ALL SELECT 'resampling family crosses splits', count(*) FROM u UNION ALL SELECT 'pair family crosses splits', count(*) FROM f WHERE s > 1 UNION ALL SELECT 'pair family maps to multiple resampling families', count(*) FROM f WHERE u > 1
UNION ALL SELECT 'duplicate id', CAST(count(*) > 1 AS BIGINT) FROM k WHERE k % 47 = 0) SELECT * FROM i WHERE n > 0""")
def split_leaks(spark, d):
    shown = ["same media appears in multiple splits", "resampling family crosses splits", "pair family crosses splits", "pair family maps to multiple resampling families", "duplicate id"]
    return W.manifest_issues(_records(spark, d)).where(F.col("message").isin(shown)).groupBy("message").agg(F.count("*").alias("n"))


@_query("manifest_coverage", """WITH k AS (SELECT p_partkey AS k FROM part) SELECT 'dataset' AS field, 'diag' AS value, count(*) AS rows FROM k UNION ALL SELECT 'information_family', CASE WHEN k % 31 = 0 THEN 'odd' ELSE 'static' END, count(*) FROM k GROUP BY 2
UNION ALL SELECT 'pair_rows', 'counterfactual', count(*) FROM k WHERE k % 3 <> 0 AND k % 2 = 1 UNION ALL SELECT 'answer_position', CASE WHEN k % 37 = 0 THEN 'PURPLE' ELSE chr(CAST(65 + k % 3 AS INTEGER)) END, count(*) FROM k GROUP BY 2
UNION ALL SELECT 'records_with_evidence', 'diag', count(*) FROM k UNION ALL SELECT 'evidence_spans', 'diag', count(*) + count(*) FILTER (k % 23 = 0) FROM k UNION ALL SELECT 'resampling_unit_id', 'units', count(DISTINCT k // 10) FROM k""")
def manifest_coverage(spark, d):
    return W.coverage(_records(spark, d))


@_query("connector_coverage", "SELECT CASE WHEN p_partkey % 53 = 0 THEN 'train' ELSE 'eval' END AS split, CASE WHEN p_partkey % 31 = 0 THEN 'odd' ELSE 'static' END AS information_family, count(*) AS rows, count(*) AS with_evidence, CAST(0 AS BIGINT) AS with_safe_facts FROM part GROUP BY 1, 2")
def connector_coverage(spark, d):
    return C.coverage(_records(spark, d)).select("split", "information_family", "rows", "with_evidence", "with_safe_facts")


_CONDITIONS = [G.Condition("full_video", "visual", "full"), G.Condition("question_only", "question_only"), G.Condition("only", "visual", "evidence_only", requires_evidence=True), G.Condition("facts", "text_oracle", clue_fields=("static_facts",), doses=(0, 1, "all"))]


def _design(spark, d):
    k = F.col("p_partkey")
    fact = lambda t: R.fact(t)
    facts = F.when(k % 4 == 0, F.array(fact(F.col("p_brand")), fact(F.concat_ws("  ", "p_type", "p_brand")))).otherwise(F.array().cast(R.NO_FACTS))
    rows = _records(spark, d).join(_table(spark, d, "part").select("p_partkey", "p_brand", "p_type"), F.col("id") == F.concat(F.lit("r"), k.cast("string")))
    return rows.withColumn("diagnostic", F.col("diagnostic").withField("oracles", F.col("diagnostic.oracles").withField("static_facts", facts))).where("size(choices) = 3").drop("p_partkey", "p_brand", "p_type")


_DESIGN = "r AS (SELECT p_partkey AS k, p_brand AS b, p_type AS t, p_partkey % 3 AS g, p_partkey % 4 = 0 AS f FROM part WHERE p_partkey % 47 <> 0 AND p_partkey % 41 <> 0 AND p_partkey % 37 <> 0)"


@_query("trial_matrix", f"""WITH {_DESIGN}, c(condition, dose) AS (VALUES ('full_video', 'all'), ('question_only', 'all'), ('only', 'all'), ('facts', '1'), ('facts', 'all')), s AS (SELECT * FROM r, c, range(0, 3) p(i) WHERE condition <> 'facts' OR f)
SELECT 'r' || k AS base_id, condition, dose AS requested_dose, CAST(i AS INTEGER) AS permutation_index, chr(CAST(65 + (g - i + 3) % 3 AS INTEGER)) AS answer, ['red', 'green', 'blue'][g + 1] AS answer_text, ['red', 'green', 'blue'][i % 3 + 1] AS first_choice,
CASE WHEN condition <> 'facts' THEN '' ELSE 'Evidence supplied by the diagnostic oracle:' || chr(10) || '- Visual fact: ' || b || CASE dose WHEN 'all' THEN chr(10) || '- Visual fact: ' || t || ' ' || b ELSE '' END END AS clue_text FROM s""")
def trial_matrix(spark, d):
    made, _ = G.expanded(_design(spark, d).where("answer <> 'purple'"), _CONDITIONS, permutations="all")
    return made.select("base_id", F.col("condition.name").alias("condition"), F.col("condition.requested_dose").alias("requested_dose"), F.col("condition.permutation_index").alias("permutation_index"), "answer", "answer_text", F.get("choices", 0).alias("first_choice"), "clue_text")


@_query("trial_skips", f"WITH {_DESIGN} SELECT 'facts' AS condition, 'no_oracle_fact' AS reason, count(*) * 3 - count(*) FILTER (f) * 2 AS n FROM r")
def trial_skips(spark, d):
    return G.skip_report(G.expanded(_design(spark, d).where("answer <> 'purple'"), _CONDITIONS, permutations="all")[1])


@_query("reconstructed_bases", f"WITH {_DESIGN} SELECT 'r' || k AS id, CAST(1 AS BIGINT) AS differing, chr(CAST(65 + g AS INTEGER)) AS answer, 'red,green,blue' AS choices, CAST(CASE WHEN f THEN 15 ELSE 9 END AS BIGINT) AS trials FROM r")
def reconstructed_bases(spark, d):
    made, _ = G.expanded(_design(spark, d).where("answer <> 'purple'"), _CONDITIONS, permutations="all")
    return G.base_records(made).select("id", "differing", "answer", F.array_join("choices", ",").alias("choices"), "trials")


@_query("channel_prompts", """WITH p AS (SELECT p_partkey, ['visual', 'question_only', 'text_oracle', 'visual_plus_text', 'embedding_oracle', 'none'][p_partkey % 6 + 1] AS ch, p_name AS q, 'Options:' || chr(10) || 'A. ' || p_brand || chr(10) || 'B. ' || p_type || chr(10) || 'Answer:' AS o FROM part)
SELECT p_partkey, ch AS channel, 'You are given a video. Answer the question using only the option letter.' || chr(10) || CASE WHEN ch IN ('visual', 'visual_plus_text', 'embedding_oracle') THEN '<VISUAL>' ELSE '' END ||
CASE ch WHEN 'visual_plus_text' THEN chr(10) || 'clue' || chr(10) WHEN 'text_oracle' THEN 'clue' || chr(10) WHEN 'question_only' THEN '' ELSE chr(10) END || 'Question: ' || q || chr(10) || o AS prompt FROM p WHERE ch <> 'none'""")
def channel_prompts(spark, d):
    channel = F.element_at(F.array(*map(F.lit, ["visual", "question_only", "text_oracle", "visual_plus_text", "embedding_oracle", "none"])), (F.col("p_partkey") % 6 + 1).cast("int"))
    rows = _table(spark, d, "part").withColumn("channel", channel).withColumn("p", G.channel_prompt(F.col("p_name"), F.array("p_brand", "p_type"), F.col("channel"), F.lit(" clue ")))
    return rows.where("p IS NOT NULL").select("p_partkey", "channel", F.concat("p.prefix", F.coalesce("p.marker", F.lit("")), "p.suffix").alias("prompt"))


def _views(spark, d):
    k = F.col("p_partkey")
    view = F.element_at(F.array(*map(F.lit, ["full", "single", "reverse", "evidence_only", "evidence_present", "evidence_removed"])), (k % 6 + 1).cast("int"))
    total = (F.col("p_size") * 10 + 40).cast("int")
    span = F.array(F.struct(F.lit(1.0).alias("start"), (F.lit(1.0) + (k % 20) / 10.0 + 0.1).alias("end"), F.lit("sec").alias("unit"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("event_id")))
    clip = F.lit(None).cast("struct<unit:string,start:double,end:double,start_frame:int,end_frame_exclusive:int,expected_total_frames:int>")
    return _table(spark, d, "part").select(F.concat(F.lit("v"), k.cast("string")).alias("visual_id"), view.alias("view"), F.lit(42).alias("seed"), total.alias("total_frames"), F.lit(10.0).alias("fps"), (total / 10.0).alias("duration_sec"), F.lit(None).cast("array<struct<start:double,end:double>>").alias("intervals"), F.lit(None).cast("string").alias("timestamp_source"), span.alias("spans"), clip.alias("clip"))


@_query("frame_views", """WITH v AS (SELECT p_partkey AS k, p_partkey % 6 AS w, CAST(p_size * 10 + 40 AS BIGINT) AS n, CAST(p_partkey % 20 + 1 AS BIGINT) AS e FROM part), s AS (SELECT *, least(greatest(1, CAST(round_even(4 * e / n, 0) AS BIGINT)), 3) AS slots FROM v),
l AS (SELECT *, range(10, 10 + e) AS ev, list_concat(range(0, 10), range(10 + e, n)) AS rest FROM s), p AS (SELECT *, CASE slots WHEN 1 THEN [ev[len(ev) // 2 + 1]] ELSE [ev[CAST(round_even(i * (len(ev) - 1) / (slots - 1), 0) AS BIGINT) + 1] for i in range(0, slots)] END AS a,
CASE 4 - slots WHEN 1 THEN [rest[len(rest) // 2 + 1]] ELSE [rest[CAST(round_even(i * (len(rest) - 1) / (3 - slots), 0) AS BIGINT) + 1] for i in range(0, 4 - slots)] END AS b FROM l), u AS (SELECT *, [CAST(round_even(i * (n - 1) / 3, 0) AS BIGINT) for i in range(0, 4)] AS full_ FROM p)
SELECT 'v' || k AS visual_id, array_to_string(CASE w WHEN 0 THEN full_ WHEN 1 THEN [n // 2, n // 2, n // 2, n // 2] WHEN 2 THEN list_reverse(full_) WHEN 3 THEN [ev[CAST(round_even(i * (len(ev) - 1) / 3, 0) AS BIGINT) + 1] for i in range(0, 4)] ELSE list_sort(list_concat(a, b)) END, ',') AS indices, CAST(e AS INTEGER) AS evidence_frames FROM u""")
def frame_views(spark, d):
    return V.selections(_views(spark, d), 4).select("visual_id", F.array_join("indices", ",").alias("indices"), "evidence_frames")


@_query("resolved_spans", "SELECT 'v' || p_partkey AS visual_id, 10 AS lo, CAST(10 + p_partkey % 20 + 1 AS INTEGER) AS hi FROM part")
def resolved_spans(spark, d):
    r = V.resolved_spans(F.col("spans"), F.col("total_frames"), F.col("fps"), F.col("duration_sec"), F.col("intervals"))
    return _views(spark, d).select("visual_id", F.get(r, 0).alias("r")).select("visual_id", "r.lo", "r.hi")


@_query("trial_set_root", """WITH t AS (SELECT 't' || o_orderkey AS id, sha256(CAST(o_orderkey AS VARCHAR)) AS s FROM orders) SELECT sha256('{"entries":[' || string_agg('{"trial_content_sha256":"' || s || '","trial_id":"' || id || '"}', ',' ORDER BY id) || '],"schema_version":"x.1"}') AS root, count(*) AS members FROM t""")
def trial_set_root(spark, d):
    rows = _table(spark, d, "orders").select(F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("trial_id"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("trial_content_sha256"))
    return L.trial_set(rows, "x.1")


@_query("unit_roots", """WITH u AS (SELECT 's' || l_suppkey AS u, count(*) AS n FROM lineitem GROUP BY 1) SELECT 'units' AS kind, sha256('{"resampling_unit_ids":[' || string_agg('"' || u || '"', ',' ORDER BY u) || '],"schema_version":"x.1"}') AS root, count(*) AS members FROM u
UNION ALL SELECT 'counts', sha256('{"schema_version":"x.1","units":[' || string_agg('{"record_count":' || n || ',"resampling_unit_id":"' || u || '"}', ',' ORDER BY u) || ']}'), count(*) FROM u UNION ALL SELECT 'bases', sha256('{"base_ids":[' || string_agg('"' || u || '"', ',' ORDER BY u) || '],"schema_version":"x.1"}'), count(*) FROM u""")
def unit_roots(spark, d):
    rows = _table(spark, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("resampling_unit_id"))
    named = lambda k, df: df.withColumn("kind", F.lit(k))
    return named("units", L.unit_set_root(rows, "x.1")).unionByName(named("counts", L.unit_counts_root(rows, "x.1"))).unionByName(named("bases", L.base_id_root(rows, "x.1", "resampling_unit_id")))


@_query("media_root", """WITH m AS (SELECT sha256(p_brand) AS s, p_size AS z, list_sort(list('r' || p_partkey)) AS ids FROM part GROUP BY p_brand, p_size) SELECT sha256('{"bindings":[' || string_agg('{"record_ids":[' || array_to_string([ '"' || x || '"' for x in ids], ',') || '],"sha256":"' || s || '","size_bytes":' || z || '}', ',' ORDER BY s, z) || '],"schema_version":"x.1"}') AS root, count(*) AS members FROM m""")
def media_root(spark, d):
    rows = _table(spark, d, "part").select(F.concat(F.lit("r"), F.col("p_partkey").cast("string")).alias("id"), F.sha2("p_brand", 256).alias("sha256"), F.col("p_size").cast("long").alias("size_bytes"))
    return L.media_binding_root(L.media_bindings(rows), "x.1")


@_query("unit_ranking", """WITH u AS (SELECT DISTINCT 's' || l_suppkey AS u FROM lineitem), r AS (SELECT u AS unit, sha256('{"canonical_split":"eval","dataset":"d","resampling_unit_id":"' || u || '","schema_version":"x.1","seed":42}') AS h FROM u), c AS (SELECT * FROM r ORDER BY h, unit LIMIT 7)
SELECT unit, h AS rank_sha256, count(*) AS rows FROM c JOIN lineitem ON 's' || l_suppkey = unit GROUP BY ALL""")
def unit_ranking(spark, d):
    rows = _table(spark, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("resampling_unit_id"))
    ranked = L.ranked_units(rows, "d", "eval", 42, "x.1")
    return L.selected_units(rows, ranked, 7).groupBy(F.col("resampling_unit_id").alias("unit")).agg(F.count("*").alias("rows")).join(ranked, "unit").select("unit", "rank_sha256", "rows")


@_query("shard_keys", """WITH r AS (SELECT l_orderkey * 8 + l_linenumber AS id, CASE WHEN l_suppkey % 3 = 0 THEN 'r' || l_suppkey WHEN l_suppkey % 3 = 1 AND l_partkey % 2 = 0 THEN 'p' || l_partkey WHEN l_suppkey % 5 = 0 THEN 'i' || l_orderkey ELSE 'x' || l_orderkey || l_linenumber END AS key FROM lineitem) SELECT key, count(*) AS rows FROM r GROUP BY 1""")
def shard_keys(spark, d):
    t = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    s, k = F.col("l_suppkey"), F.col("l_partkey")
    key = X.shard_key(F.when(s % 3 == 0, t("r", "l_suppkey")), F.when(s % 3 == 1, t("p", "l_partkey")), F.when(k % 2 == 0, "Original").otherwise("standalone"), F.when(s % 5 == 0, t("i", "l_orderkey")).otherwise(""), F.concat(t("x", "l_orderkey"), F.col("l_linenumber").cast("string")))
    return _table(spark, d, "lineitem").groupBy(key.alias("key")).agg(F.count("*").alias("rows"))


@_query("resumed_trials", "SELECT 't' || o_orderkey AS trial_id FROM orders WHERE o_orderkey % 3 <> 0")
def resumed_trials(spark, d):
    designs = _table(spark, d, "orders").select(F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("trial_id"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("trial_content_sha256"))
    done = designs.where(F.col("trial_id").substr(2, 20).cast("long") % 3 == 0).withColumns({"scoring_run_signature_sha256": F.lit("run"), "result_content_sha256": F.sha2("trial_id", 256)})
    return L.resumable(designs, done, F.sha2("trial_id", 256), "run")[0].select("trial_id")


@_query("scene_questions", """WITH d AS (SELECT l_orderkey AS s, l_linenumber AS q, any_value(l_returnflag) AS t, bool_or(l_quantity > 25) AS ok FROM lineitem GROUP BY ALL HAVING count(*) = 1), c AS (SELECT s, q, t, c, CASE c WHEN 0 THEN ok ELSE NOT ok END AS right_ FROM d, range(0, 2) r(c) WHERE t <> 'N')
SELECT s || ':' || q || ':' || c AS source_id, 'clevrer:' || CASE t WHEN 'A' THEN 'explanatory' ELSE 'counterfactual' END AS benchmark, CASE WHEN right_ THEN 'B' ELSE 'A' END AS answer, CASE t WHEN 'A' THEN 2 ELSE 3 END AS depth, 'clevrer:' || s || ':' || q AS unit,
'Q' || q || chr(10) || 'Candidate statement: c' || c || chr(10) || 'Is this candidate statement correct?' AS question, 'clevrer:' || substr(sha256('["clevrer",' || s || ',"' || q || '","' || c || '"]'), 1, 20) AS id FROM c""")
def scene_questions(spark, d):
    li = _table(spark, d, "lineitem")
    one = li.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n = 1").drop("n")
    li = li.join(one, ["l_orderkey", "l_linenumber"])
    kind = F.when(F.col("l_returnflag") == "A", "Explanatory").when(F.col("l_returnflag") == "R", "counterfactual").otherwise("descriptive")
    none = F.array().cast("array<string>")
    choice = lambda i, ok: F.struct(F.lit(i).alias("choice_id"), F.lit(f"c{i}").alias("choice"), F.when(ok, "correct").otherwise("wrong").alias("answer"), none.alias("program"))
    first = F.col("l_quantity") > 25
    choices = F.when(F.col("l_returnflag") == "N", F.array().cast("array<struct<choice_id:int,choice:string,answer:string,program:array<string>>>")).otherwise(F.array(choice(0, first), choice(1, ~first)))
    question = F.struct(F.col("l_linenumber").alias("question_id"), kind.alias("question_type"), F.lit(None).cast("string").alias("question_subtype"), F.concat(F.lit("Q"), F.col("l_linenumber").cast("string")).alias("question"), none.alias("program"), choices.alias("choices"))
    scenes = li.groupBy(F.col("l_orderkey").cast("int").alias("scene_index")).agg(F.collect_list(question).alias("questions")).withColumn("video_filename", F.lit("v.mp4"))
    out = C.loaded(C.scene_questions(scenes, "/m", "eval"))
    g = F.col("diagnostic")
    return out.select(g["provenance"]["source_id"].alias("source_id"), "benchmark", "answer", g["reasoning_depth"].alias("depth"), g["independent_unit_id"].alias("unit"), "question", "id")


@_query("paired_videos", """WITH p AS (SELECT p_partkey // 2 AS pair, p_partkey % 2 + 1 AS role, p_partkey, count(*) OVER (PARTITION BY p_partkey // 2) AS n FROM part), i AS (SELECT *, n <> 2 AS lone, pair % 5 = 0 AND n = 2 AS same_video, pair % 7 = 0 AND n = 2 AS same_answer FROM p)
SELECT 'x' || pair || '_' || role AS source_id, CASE role WHEN 1 THEN 'original' ELSE 'counterfactual' END AS pair_role, CASE WHEN pair % 7 = 0 OR role = 1 THEN 'A' ELSE 'B' END AS answer, array_to_string(list_filter([CASE WHEN lone THEN 'a pair needs both roles once' END, CASE WHEN same_video THEN 'both roles show the same video' END, CASE WHEN same_answer THEN 'the answer must change' END], lambda x: x IS NOT NULL), '; ') AS problems FROM i""")
def paired_videos(spark, d):
    k = F.col("p_partkey")
    pair, role = F.floor(k / 2), k % 2 + 1
    same = pair % 7 == 0
    rows = _table(spark, d, "part").select(
        F.concat(F.lit("x"), pair.cast("string"), F.lit("_"), role.cast("string")).alias("video_id"), F.when(pair % 5 == 0, F.concat(F.lit("v"), pair.cast("string"))).otherwise(F.concat(F.lit("w"), k.cast("string"))).alias("video_path"), F.lit("Which?").alias("question"),
        F.array(F.lit("Left"), F.lit("right")).alias("candidates"), F.when(same | (role == 1), "left ").otherwise("RIGHT").alias("answer"), F.lit(None).cast("string").alias("source"), F.lit("temporal_reasoning").alias("category"))
    out = C.paired_videos(rows, "/m", "eval")
    return out.select(F.col("diagnostic.provenance")["source_id"].alias("source_id"), F.col("diagnostic.pair_role").alias("pair_role"), "answer", F.array_join("problems", "; ").alias("problems"))


@_query("labelled_questions", "SELECT p_partkey, p_name AS question, p_brand || '|' || p_type AS choices, CASE p_partkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'B' END AS letter, CASE p_partkey % 4 WHEN 3 THEN 'the answer matches no option' ELSE 'none' END AS problem FROM part")
def labelled_questions(spark, d):
    k = F.col("p_partkey") % 4
    said = F.concat("p_name", F.lit("\nA. "), "p_brand", F.lit("\nB) "), "p_type")
    answer = F.when(k == 0, F.concat(F.lit("A. "), F.lower("p_brand"))).when(k == 1, F.concat(F.lit("B) "), "p_type")).when(k == 2, F.concat(F.lit(" "), F.lower("p_type"))).otherwise(F.concat(F.lit("A. "), "p_type"))
    m = C.labelled_question(said, answer)
    return _table(spark, d, "part").withColumn("m", m).select("p_partkey", "m.question", F.array_join("m.choices", "|").alias("choices"), "m.letter", F.coalesce("m.problem", F.lit("none")).alias("problem"))


@_query("generic_rows", """SELECT 's_' || CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE substr(sha1('s::' || p_name || '::' || p_brand), 1, 20) END AS id, CASE p_partkey % 3 WHEN 0 THEN 'mcq' WHEN 1 THEN 'qa' ELSE 'caption' END AS task, CASE p_partkey % 3 WHEN 2 THEN '/r/' || p_size || '.mp4' ELSE '/r/' || p_size || '.avi' END AS media_path,
CASE p_partkey % 3 WHEN 2 THEN 'Describe it' ELSE p_name END AS question, p_brand AS answer FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 <> 2""")
def generic_rows(spark, d):
    k = F.col("p_partkey")
    question = F.when(k % 3 == 2, F.lit("Describe it")).otherwise(F.col("p_name"))
    fields = F.struct(F.when(k % 2 == 0, k).alias("id"), question.alias("query"), F.col("p_brand").alias("response"), F.when(k % 3 == 0, F.array(F.lit("a"), F.lit("b"))).alias("options"), F.concat(F.col("p_size").cast("string"), F.when(k % 3 == 2, "").otherwise(".avi")).alias("video_path"))
    rows = _table(spark, d, "part").where((k % 2 == 0) | (k % 3 != 2)).select(F.parse_json(F.to_json(fields)).alias("v"))
    return M.normalized(rows, "s", "/r/").select("id", "task", "media_path", "question", "answer")


@_query("group_records", """SELECT 'vinoground:text:' || p_partkey // 2 || '_' || CASE p_partkey % 2 WHEN 0 THEN 'pos' ELSE 'neg' END AS id, CAST(p_partkey // 2 AS INTEGER) AS group_id, 'Which is it?' AS question, p_brand || '|' || p_type AS choices, 'm' || (p_partkey // 2) % 3 AS major_category, CASE (p_partkey // 2) % 2 WHEN 0 THEN 'a,b' ELSE '' END AS minor FROM part""")
def group_records(spark, d):
    k = F.col("p_partkey")
    group = F.floor(k / 2)
    items = _table(spark, d, "part").select(F.concat(group.cast("string"), F.when(k % 2 == 0, "_pos").otherwise("_neg")).alias("idx"), F.concat(F.lit("Which is it?\nA. "), "p_brand", F.lit("\n(b) "), "p_type", F.lit("\nAnswer with the option letter")).alias("question"), F.lit("v.mp4").alias("video_name"), F.lit("a").alias("GT"))
    table = _table(spark, d, "part").select(group.cast("string").alias("index"), F.concat(F.lit(" m"), (group % 3).cast("string")).alias("major"), F.when(group % 2 == 0, "a; b;").alias("minor")).distinct()
    return M.group_records(items, "text", M.categories(table), "/r").select("id", "group_id", "question", F.array_join("choices", "|").alias("choices"), "major_category", F.array_join("minor_categories", ",").alias("minor"))


@_query("deduplicated_items", "SELECT min(p_partkey) AS p_partkey, lower(p_brand) AS key FROM part GROUP BY p_brand, p_size % 5")
def deduplicated_items(spark, d):
    shown = F.concat(F.lit(" "), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).otherwise(F.lower("p_brand")))
    rows = _table(spark, d, "part").select("p_partkey", shown.alias("q"), (F.col("p_size") % 5).cast("string").alias("m"))
    return M.deduplicated(rows, M.semantic_key(F.col("m"), F.col("q"), F.array("q"), F.lit("a")), ["p_partkey"]).select("p_partkey", F.lower(F.trim("q")).alias("key"))


@_query("last_records", "SELECT CAST(l_orderkey AS VARCHAR) AS id, arg_max(l_partkey, l_extendedprice * 100000 + l_partkey) AS l_partkey FROM lineitem GROUP BY 1")
def last_records(spark, d):
    rows = _table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), "l_partkey", "l_extendedprice")
    return M.last_by_id(rows, "id", F.col("l_extendedprice") * 100000 + F.col("l_partkey")).select("id", "l_partkey")


@_query("caption_rows", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN -1 ELSE CAST(i AS INTEGER) END AS caption_index, CASE WHEN p_size % 4 = 0 THEN 'none' ELSE 'c' || i END AS caption FROM part, range(0, 3) r(i) WHERE i < least(3, greatest(1, p_size % 4)) AND i < 2")
def caption_rows(spark, d):
    n = F.col("p_size") % 4
    caps = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.lit("c"), i.cast("string"))))
    return M.caption_variants(_table(spark, d, "part").withColumn("caps", caps), "caps", 2).select("p_partkey", F.coalesce("caption_index", F.lit(-1)).alias("caption_index"), F.coalesce("caption", F.lit("none")).alias("caption"))


@_query("field_forms", """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '<missing>' WHEN 1 THEN CAST(p_size AS VARCHAR) WHEN 2 THEN 'all' WHEN 3 THEN '0.5' ELSE 'NaN' END AS dose, CASE p_partkey % 5 WHEN 0 THEN '<missing>' ELSE ['1', 'all', '0.50', 'NaN'][p_partkey % 5] END AS grouped,
CASE WHEN p_partkey % 5 = 1 THEN 'A' WHEN p_partkey % 5 = 2 THEN 'B' ELSE 'none' END AS letter, CASE p_partkey % 3 WHEN 0 THEN 'seconds' WHEN 1 THEN 'normalized' ELSE 'none' END AS unit, p_partkey % 2 = 0 AS digest, CAST(CASE WHEN p_size > 25 THEN p_size ELSE 0 END AS BIGINT) AS positive,
'clevrer:' || substr(sha256('["clevrer",' || p_partkey || ',"' || p_brand || '"]'), 1, 20) AS id, CASE WHEN p_partkey % 4 = 0 THEN 'question_only' ELSE 'full_video' END AS reference FROM part""")
def field_forms(spark, d):
    k = F.col("p_partkey")
    pick = lambda n, *v: F.element_at(F.array(*map(F.lit, v)), (k % n + 1).cast("int"))
    dose = F.when(k % 5 == 1, F.concat(F.col("p_size").cast("string"), F.lit(".0"))).otherwise(pick(5, " ", "", " all", "0.50", "NaN"))
    return _table(spark, d, "part").select(
        "p_partkey", S.dose(dose).alias("dose"), X.group_value(pick(5, " ", "1", "all", "0.50", "NaN")).alias("grouped"), F.coalesce(X.integer_answer(pick(5, "0", "1", "2", "7", "-1"), F.array(F.lit("x"), F.lit("y")), 1), F.lit("none")).alias("letter"),
        F.coalesce(X.span_unit(pick(3, " Secs", "Relative", "days")), F.lit("none")).alias("unit"), X.is_sha256(F.when(k % 2 == 0, F.sha2("p_brand", 256)).otherwise(F.upper(F.sha2("p_brand", 256)))).alias("digest"), F.coalesce(X.positive_int(F.when(F.col("p_size") > 25, F.col("p_size").cast("string")).otherwise(F.concat(F.lit("-"), F.col("p_size").cast("string")))), F.lit(0)).alias("positive"),
        R.stable_id("clevrer", k.cast("string"), R.json_text(F.col("p_brand"))).alias("id"), X.reference_condition(pick(4, "Text_Oracle", "visual_plus_text", "visual", ""), F.lit("video_plus_oracle"), "full_video").alias("reference"))


@_query("media_lookup", "SELECT p_partkey, '/m/video/' || p_size || '.mp4' AS media_path FROM part")
def media_lookup(spark, d):
    part = _table(spark, d, "part")
    files = part.select(F.concat(F.lit("/m/video/"), F.col("p_size").cast("string"), F.lit(".mp4")).alias("path")).distinct()
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    raw = F.when(k % 3 == 0, size).when(k % 3 == 1, F.concat(F.lit("./"), size, F.lit(".mp4"))).otherwise(F.concat(F.lit("video\\"), size, F.lit(".mp4")))
    return M.looked_up(part.select("p_partkey", raw.alias("raw")), "raw", M.media_index(files, "/m")).select("p_partkey", "media_path")


@_query("folded_digest", "SELECT count(DISTINCT sha256('{\"a\":\"' || p_brand || '\",\"b\":' || p_size || '}')) AS digests, min(sha256('{\"a\":\"' || p_brand || '\",\"b\":' || p_size || '}')) AS least FROM part")
def folded_digest(spark, d):
    digest = D.canonical_sha256(F.struct(F.col("p_size").alias("b"), F.col("p_brand").alias("a")))
    return _table(spark, d, "part").select(digest.alias("h")).agg(F.count_distinct("h").alias("digests"), F.min("h").alias("least"))


@_query("answer_texts", "SELECT p_partkey, CASE p_partkey % 2 WHEN 0 THEN p_name ELSE p_brand END AS said FROM part")
def answer_texts(spark, d):
    return _table(spark, d, "part").select("p_partkey", T.answer_text(F.when(F.col("p_partkey") % 2 == 0, "a)").otherwise(F.upper("p_brand")), F.array("p_name", "p_brand")).alias("said"))
