"""Frame clocks, spans and views against values worked out by hand and a plain version."""

import random

import pytest
from pyspark.sql import functions as F

from tarn.operators import frames as V

SPAN = "struct<start:double,end:double,unit:string,role:string,event_id:string>"
SHAPE = f"visual_id string, view string, seed int, {V.CLOCK}, spans array<{SPAN}>, clip struct<unit:string,start:double,end:double,start_frame:int,end_frame_exclusive:int,expected_total_frames:int>"


def row(view, spans=((2.0, 4.0),), clip=None, intervals=None, total=100, fps=10.0, duration=10.0, source=None, unit="seconds"):
    return ("v", view, 42, total, fps, duration, intervals, source, [(float(a), float(b), unit, None, None) for a, b in spans], clip)


def select(spark, rows, count=5):
    rows = [(f"v{i:02d}", *r[1:]) for i, r in enumerate(rows)]
    return [r for r in V.selections(spark.createDataFrame(rows, SHAPE), count).orderBy("visual_id").collect()]


def test_views(spark):
    views = ["full", "single", "reverse", "evidence_only", "evidence_present", "evidence_removed", "random_position_mask", "random_matched", "shuffle"]
    got = dict(zip(views, select(spark, [row(v) for v in views])))
    assert all(r.problem is None for r in got.values())
    assert got["full"].indices == [0, 25, 50, 74, 99] and got["single"].indices == [50] * 5 and got["reverse"].indices == [99, 74, 50, 25, 0]
    assert got["evidence_only"].indices == [20, 25, 30, 34, 39] and got["evidence_only"].evidence_frames == 20
    shared = got["evidence_present"].indices
    assert shared == got["evidence_removed"].indices == got["random_position_mask"].indices and sum(20 <= x < 40 for x in shared) == 1
    assert got["evidence_removed"].masked_positions == got["evidence_removed"].evidence_positions == [i for i, x in enumerate(shared) if 20 <= x < 40]
    mask = got["random_position_mask"].masked_positions
    assert len(mask) == len(got["evidence_removed"].masked_positions) and not set(mask) & set(got["evidence_removed"].masked_positions)
    assert sorted(got["shuffle"].indices) == [0, 25, 50, 74, 99]
    order = [0, 25, 50, 74, 99]
    V.stream(42, "v08", "shuffle").shuffle(order)
    assert got["shuffle"].indices == order
    w = got["random_matched"].windows
    assert abs(sum(x.end - x.start for x in w) - 2.0) < 1e-9 and all(not 20 <= i < 40 for i in got["random_matched"].indices)


def test_spans_and_clips(spark):
    clip = lambda **k: {**dict.fromkeys(["unit", "start", "end", "start_frame", "end_frame_exclusive", "expected_total_frames"]), **k}
    uneven = [(0.0, 1.0), (1.0, 4.0), (4.0, 4.5), (4.5, 10.0)]
    rows = [
        row("evidence_only", spans=[(0.2, 0.4)], unit="relative"), row("evidence_only", spans=[(2, 11)]), row("evidence_only", spans=[(4, 2)]), row("evidence_only", spans=()), row("evidence_only", source="opencv_average_fps_unverified"),
        row("full", spans=(), clip=clip(unit="seconds", start=2.0, end=5.0)), row("full", spans=(), clip=clip(unit="frames", start_frame=10, end_frame_exclusive=20, expected_total_frames=100)), row("full", spans=(), clip=clip(unit="frames", end_frame_exclusive=20, expected_total_frames=99)),
        row("evidence_only", clip=clip(unit="seconds", start=3.0, end=5.0)), row("evidence_only", intervals=uneven, total=4, spans=[(0.5, 4.2)]), row("random_matched", spans=[(0.0, 6.0)]), row("sideways"),
    ]
    got = select(spark, rows)
    assert got[0].indices == [20, 25, 30, 34, 39] and "exceeds" in got[1].problem and "positive" in got[2].problem and "evidence" in got[3].problem and "clock" in got[4].problem
    assert got[5].indices[0] == 20 and got[5].indices[-1] == 49 and got[6].indices[0] == 10 and got[6].indices[-1] == 19 and "does not match" in got[7].problem
    assert "outside" in got[8].problem and got[9].indices == [0, 0, 1, 2, 2] and got[9].timestamps == [0.0, 0.0, 1.0, 4.0, 4.0] and "too little" in got[10].problem and got[11].problem == "unknown view"


def test_matched_windows_cover_the_evidence():
    rng = random.Random(1)
    assert V.matched_windows([(0, 3)], [(3, 5), (6, 7.5)], 10, rng)[1].startswith("multi")
    windows, how = V.matched_windows([(0, 3)], [(3, 5), (6, 7.5)], 10, rng)
    assert abs(sum(b - a for a, b in windows) - 3) < 1e-9 and all(any(a >= x and b <= y + 1e-9 for x, y in ((3, 5), (6, 7.5))) for a, b in windows)
    assert V.matched_windows([(0, 6)], [(6, 10)], 10, rng) is None and V.matched_windows([(0, 3)], [(4, 9)], 10, rng)[1].startswith("contiguous")


def test_clock_and_intervals(spark):
    shape = "total int, fps double, duration double, intervals array<struct<start:double,end:double>>, source string"
    rows = [(4, 2.0, 2.0, None, None), (4, 2.0, 3.0, None, None), (4, 2.0, 3.0, None, "opencv_average_fps_unverified"), (0, 2.0, 2.0, None, None), (2, 2.0, 2.0, [(0.0, 1.0), (0.5, 0.8)], None), (2, 1.0, 2.0, [(0.0, 1.0), (1.0, 2.0)], None), (3, 1.0, 2.0, [(0.0, 1.0), (1.0, 2.5)], " ")]
    got = spark.createDataFrame(rows, shape).select(V.clock_issues(*(F.col(c) for c in ("total", "fps", "duration", "intervals", "source"))).alias("i")).collect()
    assert [len(r.i) for r in got] == [0, 1, 0, 2, 1, 0, 3]
    pairs = spark.createDataFrame([([(3.0, 4.0), (0.0, 1.0), (1.0, 2.0), (5.0, 5.0), (3.5, 6.0)],)], "x array<struct<start:double,end:double>>")
    assert [tuple(p) for p in pairs.select(V.merged(F.col("x")).alias("m")).first().m] == [(0.0, 2.0), (3.0, 6.0)]
    views = spark.createDataFrame([("a", 2), ("a", 1), (None, 3), ("b", 4)], "visual_id string, n int")
    assert sorted(map(tuple, V.distinct_views(views).collect())) == [("a", 1), ("b", 4)]


@pytest.mark.parametrize("count, evidence, total", [(5, range(20, 40), 100), (4, range(0, 10), 10), (1, range(3, 4), 9), (8, range(0, 1), 50)])
def test_stratified(spark, count, evidence, total):
    def pick(items, k):
        items = list(items)
        return [items[len(items) // 2]] if k == 1 else [items[round(s * (len(items) - 1) / (k - 1))] for s in range(k)]

    rest = [i for i in range(total) if i not in evidence]
    slots = max(1, round(count * len(evidence) / total))
    slots = min(slots, count - 1) if rest and count > 1 else slots
    slots = min(slots, count)
    want = sorted(pick(evidence, slots) + (pick(rest, count - slots) if count > slots else []))
    got = spark.createDataFrame([(list(range(total)), list(evidence), rest)], "a array<int>, e array<int>, r array<int>").select(V.stratified(F.col("a"), F.col("e"), F.col("r"), count).alias("x")).first().x
    assert got == want
