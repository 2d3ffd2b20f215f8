import hashlib

from pyspark.sql import functions as F

from tarn.functions import digests as D
from tarn.operators import locks as L


def test_listed_root_is_a_stream_of_ordered_pieces(spark):
    """No list of all leaves is made; the order of rows, mixed digests and nulls change nothing."""
    rows = [(f"t{i}", hashlib.sha256(str(i).encode()).hexdigest() if i % 5 else f"A-{i}") for i in range(30_000)]
    out = L.trial_set(spark.createDataFrame(rows[::-1], "trial_id string, trial_content_sha256 string").repartition(7), "x.1")
    assert "collect_list" not in out._jdf.queryExecution().executedPlan().toString()
    said = ",".join(f'{{"trial_content_sha256":"{sha.lower()}","trial_id":"{name}"}}' for name, sha in sorted(rows))
    want = hashlib.sha256(f'{{"entries":[{said}],"schema_version":"x.1"}}'.encode()).hexdigest()
    assert [tuple(r) for r in out.collect()] == [(want, 30_000)]


def test_listed_root_of_few_none_and_null_leaves(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = spark.createDataFrame([(3, "c", "a" * 64), (1, None, "b"), (None, "a", None), (1, "b", "A" * 64), (1, "a", "a" * 64 + "\n")], "k int, leaf string, more string")
    root = lambda df, leaf="leaf", name="n": tuple(D.listed_root(df, ["k"], F.col(leaf), name, "s").first())
    assert root(rows) == (sha('{"n":[a,a,b,c],"schema_version":"s"}'), 5)
    assert root(rows.where("k = 9")) == (sha('{"n":[],"schema_version":"s"}'), 0) and root(rows.where("leaf IS NULL"), name="z") == (sha('{"schema_version":"s","z":[]}'), 1)
    assert root(rows.where("k > 0"), "more") == (sha('{"n":[' + ",".join(["A" * 64, "a" * 64 + "\n", "b", "a" * 64]) + '],"schema_version":"s"}'), 4)
