import gzip


def test_tolerant_lines(spark, tmp_path):
    from tarn.sources import files

    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{bad\n[1]\n"s"\n{"a": 2, "b": "x"}\n')
    good, issues = files.jsonl_tolerant(spark, str(tmp_path / "a.jsonl"), "a long, b string")
    assert sorted((r.a, r.b) for r in good.collect()) == [(1, None), (2, "x")]
    assert sorted(r.kind for r in issues.collect()) == ["malformed", "non_object", "non_object"]


def test_formats_and_sinks(spark, tmp_path):
    from tarn.sources import files

    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write('{"b": 2, "a": "x"}\n')
    (tmp_path / "c.json").write_text('[{"a": 1}, {"a": 2}]')
    (tmp_path / "d.csv").write_text("a,b\n1,x\n")
    assert files.rows(spark, str(tmp_path / "b.jsonl.gz")).count() == 1
    assert files.rows(spark, str(tmp_path / "c.json")).count() == 2
    assert files.rows(spark, str(tmp_path / "d.csv")).first().a == "1"
    files.write_jsonl(files.rows(spark, str(tmp_path / "b.jsonl.gz")), str(tmp_path / "o.jsonl"), gzip=True)
    files.write_csv(files.rows(spark, str(tmp_path / "d.csv")), str(tmp_path / "p.csv"), ["b"])
    assert files.rows(spark, str(tmp_path / "o.jsonl")).columns == ["a", "b"] and files.rows(spark, str(tmp_path / "p.csv")).columns == ["b", "a"]


def test_stream(spark, tmp_path):
    from tarn.streaming.windows import event_counts

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = event_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("counts").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("counts").agg({"n": "sum"}).first()[0] == events.count()


def test_scalar_functions(spark):
    from pyspark.sql import functions as F

    from tarn.functions import scores as S

    df = spark.createDataFrame([(" 2.0 ", "Yes"), ("all", "no"), (" ", "maybe"), ("NaN", None), ("1.5", "0")], "d string, b string")
    rows = df.select(S.dose(F.col("d")).alias("d"), S.lenient_bool(F.col("b")).alias("b"), S.finite(F.col("d")).alias("f")).collect()
    assert [r.d for r in rows] == ["2", "all", "<missing>", "NaN", "1.5"]
    assert [r.b for r in rows] == [True, False, None, None, False] and [r.f for r in rows] == [2.0, None, None, None, 1.5]
    bad = spark.createDataFrame([([1.0, None],), ([1.0, float("nan")],), ([1.0, -1.0],), ([0.5],)], "n array<double>")
    assert all(r.p is None for r in bad.select(S.softmax(F.col("n")).alias("p")).collect())
    lo, hi = spark.range(1).select(*S.wilson(F.lit(0), F.lit(0))).first()
    assert (lo, hi) == (0.0, 0.0)
