import os

import pytest

from tarn.plans import queries as plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events embeddings conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    said = lambda v: "null" if v is None or v != v else f"{float(v):.5f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(said(v) for v in r) for r in frame.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got = plans.queries()[name](spark, SF).toPandas()
    want = duck.sql(plans.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) > 0 and rows(got) == rows(want)


def test_effective_rank_equals_gram_eigenvalues(spark):
    import numpy as np

    got = {r["label"]: r for r in plans.queries()["effective_rank"](spark, SF).collect()}
    table = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    for label, part in table.groupby("label"):
        x = np.stack(part["embedding"].to_numpy()).astype(float)
        x = x / np.sqrt((x**2).sum(1))[:, None]
        x = x - x.mean(0)
        e = np.clip(np.linalg.eigvalsh(x @ x.T), 0, None)
        p = e / e.sum()
        assert got[label]["n"] == len(x)
        assert abs(got[label]["rank"] - np.exp(-(p * np.log(p + 1e-12)).sum())) < 1e-4
        assert abs(got[label]["top_energy"] - p.max()) < 1e-5


def test_vector_edges(spark):
    """Zero vectors are at distance 1; one vector has distance 0; without far pairs the neighbours' mean stands in; constant gaps correlate as 0."""
    from tarn.operators import vectors as V

    rows = spark.createDataFrame([("one", 1, [1.0, 0.0]), ("two", 1, [1.0, 0.0]), ("two", 2, [0.0, 0.0]), ("three", 1, [1.0, 0.0]), ("three", 2, [0.0, 2.0]), ("three", 3, [0.0, 0.0])], "g string, o int, v array<double>")
    got = {r["g"]: (r["adjacent"], r["far"], r["difference"]) for r in V.far_distance(rows, "g", "o", "v").collect()}
    assert got == {"one": (0.0, 0.0, 0.0), "two": (1.0, 1.0, 0.0), "three": (1.0, 1.0, 0.0)}
    assert {r["g"]: r["pairwise"] for r in V.mean_pairwise_distance(rows, "g", "v").collect()} == {"one": 0.0, "two": 1.0, "three": 1.0}
    assert {r["g"]: r["correlation"] for r in V.gap_correlation(rows, "g", "o", "v").collect()} == {"one": 0.0, "two": 0.0, "three": 0.0}
    assert {r["g"]: r["rank"] for r in V.effective_rank(rows, "g", "v", 2).collect()}["one"] == 0.0


def test_token_vectors(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from tarn.operators import vectors as V

    t = np.arange(14, dtype=float).reshape(7, 2) ** 1.5
    row = spark.createDataFrame([(t.tolist(), [1, 0, 1, 0, 0, 0, 1], [0] * 7, [[1.0, 0.0], [0.6, 0.8], [0.6, 0.8]])], "t array<array<double>>, m array<int>, z array<int>, o array<array<double>>").select(
        V.pooled(F.col("t")).alias("pooled"), V.masked_mean(F.col("t"), F.col("m")).alias("masked"), V.masked_mean(F.col("t"), F.col("z")).alias("none"), V.adaptive_pool(F.col("t"), 3).alias("three"),
        V.adaptive_pool(F.col("t"), 9).alias("nine"), V.chosen_option(F.array(F.lit(0.5), F.lit(0.7)), F.col("o")).alias("option")).first()
    assert np.allclose(row["pooled"], t.mean(0) / np.linalg.norm(t.mean(0))) and np.allclose(row["masked"], t[[0, 2, 6]].mean(0)) and row["none"] == [0.0, 0.0]
    assert np.allclose(row["three"], [t[0:3].mean(0), t[2:5].mean(0), t[4:7].mean(0)]) and row["nine"] == t.tolist() and row["option"] == 1


def test_label_questions_of_few_labels(spark):
    from tarn.operators import evaluation as E

    nulls = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id int, label string")
    got = {r["id"]: r for r in E.label_questions(nulls, "id", "label", 3).collect()}
    assert set(got) == {1, 3} and sorted(got[1]["choices"]) == ["a", "b"] and got[1]["choices"][ord(got[1]["answer"]) - 65] == "a"
    many = spark.range(3000).selectExpr("id", "concat('l', id % 1500) AS label")
    rows = E.label_questions(many, "id", "label", 3, broadcast_labels=0).collect()
    assert len(rows) == 3000 and all(len(set(r["choices"])) == 4 and r["choices"][ord(r["answer"]) - 65] == r["label"] for r in rows)
    assert len({c for r in rows for c in r["choices"]}) == 1500


def test_formulas(spark):
    """Places, parts, shares, identifiers and doses at their edges."""
    from pyspark.sql import functions as F

    from tarn.functions import fields, scores, sequences, text
    from tarn.operators import evaluation as E

    four = F.sequence(F.lit(0), F.lit(3))
    row = spark.range(1).select(
        sequences.evenly(four, 1).alias("one"), sequences.segments(F.sequence(F.lit(0), F.lit(1)), 4).alias("parts"), text.percent_text(F.lit(1), F.lit(0)).alias("none"), text.percent_text(F.lit(1), F.lit(8)).alias("some"),
        (scores.stable_id(F.lit("a"), F.lit(None).cast("string"), F.lit("b")) == scores.stable_id(F.lit("a"), F.lit("b"))).alias("same"),
        F.array(*(scores.dose(F.lit(x)) for x in ("0.50", "0.5", "2.0", " all ", "", "1e3", "NaN"))).alias("doses"), fields.folded(F.lit("  Stra\u00dfe\u00a0 ΑΣ ")).alias("folded"),
        text.normalized_answer(F.lit("STRASSE"), F.array(F.lit("Stra\u00dfe"), F.lit("Weg"))).alias("answer")).first()
    assert row["one"] == [2] and row["parts"] == [[0], [0], [1], [1]] and row["none"] == "" and row["some"] == "12.5%" and not row["same"]
    assert row["doses"] == ["0.5", "0.5", "2", "all", "<missing>", "1000", "NaN"] and row["folded"] == "strasse ασ" and row["answer"] == "A"
    table = spark.createDataFrame([("a", 1.0, 5.0), ("b", 2.0, 5.0)], "name string, up double, down double")
    assert [r["overall"] for r in E.ranked(table, ["up", "down"], ["down"], "name").orderBy("place").collect()] == [1.0, 0.5]


def test_sequence_selections(spark):
    from pyspark.sql import functions as F

    from tarn.functions import sequences as Q

    row = spark.range(1).select(
        Q.evenly(F.sequence(F.lit(0), F.lit(99)), 5).alias("five"), Q.evenly(F.sequence(F.lit(0), F.lit(4)), 1).alias("one"), Q.evenly(F.array().cast("array<int>"), 3).alias("none"),
        Q.segments(F.sequence(F.lit(0), F.lit(4)), 2).alias("parts"), F.array_sort(Q.hash_shuffled(F.sequence(F.lit(0), F.lit(9)), F.lit("k"))).alias("same")).first()
    assert row["five"] == [0, 25, 50, 74, 99] and row["one"] == [2] and row["none"] == []
    assert sum(row["parts"], []) == list(range(5)) and row["same"] == list(range(10))


def test_differences_count_copies(spark):
    from tarn.operators import relational as R

    a = spark.createDataFrame([(1,), (1,), (None,), (2,)], "k int")
    b = spark.createDataFrame([(1,), (3,), (None,)], "k int")
    assert sorted((r["side"], r["k"]) for r in R.differences(a, b).collect()) == [("extra", 3), ("missing", 1), ("missing", 2)]


def test_semantic_text_folds_compatibility_forms(spark):
    from tarn.functions import text

    rows = spark.createDataFrame([(1, "\uff21\ufb01  Stra\u00dfe\t"), (2, " \u00a0 "), (3, None)], "id int, t string")
    assert {r["id"]: r["s"] for r in rows.select("id", text.semantic_text("t").alias("s")).collect()} == {1: "afi strasse", 2: None, 3: None}


def test_first_exchange_without_sides(spark):
    from tarn.operators import records as C

    rows = spark.createDataFrame([(1, 2, "user", "b"), (1, 1, "user", " <image>a "), (2, 1, "system", "s"), (3, 1, "assistant", None)], "c int, n int, r string, t string")
    got = {r["c"]: (r["question"], r["answer"]) for r in C.first_exchange(rows, "c", "n", "r", "t").collect()}
    assert got == {1: ("a", None), 2: (None, None), 3: (None, None)}
