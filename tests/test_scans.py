"""Scans with carried state, components, bucketed interval joins and the detector search against loops."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqmill.operators import detection, intervals, joins, scans, tracking, trajectory


def loop_match(left, right, tolerance):
    free, got = sorted(right), []
    for x in sorted(left):
        near = [y for y in free if abs(y - x) <= tolerance]
        if near:
            y = min(near, key=lambda y: (abs(y - x), y))
            free.remove(y)
            got.append((x, y, abs(x - y)))
    return got


def loop_suppress(rows, distance):
    kept = []
    for f, s, *more in sorted(rows, key=lambda r: -r[1]):
        if all(abs(f - k[0]) >= distance for k in kept):
            kept.append((f, s, *more))
    return sorted(kept)


@pytest.mark.parametrize("width", [7, 100_000, None])
def test_components_equal_a_loop(spark, width):
    rng = random.Random(width or 1)
    rows = [(k, rng.randrange(-200, 400)) for k in (1, 2, None) for _ in range(120)] + [(3, None), (4, 5), (4, 5)]
    out = scans.cut_at_gaps(spark.createDataFrame(rows, "k int, f int").repartition(3), ["k"], "f", 6, width).collect()
    want = []
    for k in {r[0] for r in rows}:
        start = before = None
        for f in sorted(f for a, f in rows if a == k and f is not None):
            start = f if before is None or f - before >= 6 else start
            before = f
            want.append((k, f, start))
    null_first = lambda r: (r[0] is not None, *map(lambda v: v or 0, r))
    assert sorted(((r.k, r.f, r.part) for r in out), key=null_first) == sorted(want, key=null_first)
    assert scans.cut_at_gaps(spark.createDataFrame([], "k int, f int"), ["k"], "f", 6, width).count() == 0


def test_matching_and_suppression_equal_loops_on_ties_and_dense_keys(spark):
    rng = random.Random(11)
    sides = {k: ([rng.randrange(300) for _ in range(n)], [rng.randrange(300) for _ in range(m)]) for k, (n, m) in {1: (90, 100), 2: (5, 0), 3: (0, 5), 4: (40, 3), 5: (1, 1)}.items()}
    table = lambda i: spark.createDataFrame([(k, f) for k, s in sides.items() for f in s[i]], "k int, frame int").repartition(3)
    for tolerance in (0, 4, 60):
        got = sorted(tuple(r) for r in intervals.greedy_match(table(0), table(1), "k", "frame", tolerance).collect())
        assert got == sorted((k, *m) for k, s in sides.items() for m in loop_match(*s, tolerance))
    rows = [(k, d, rng.randrange(200), float(rng.randrange(6))) for k in (1, 2) for d in (1, 5) for _ in range(150)]
    made = spark.createDataFrame([*rows, (1, 5, 7, None)], "k int, d int, f int, s double").repartition(4)
    got = sorted(tuple(r) for r in trajectory.suppress(made, ["k", "d"], "f", "s", "d").collect())
    assert got == sorted((k, d, *r) for k in (1, 2) for d in (1, 5) for r in loop_suppress(sorted(x[2:] for x in rows if x[:2] == (k, d)), d))


def test_a_hot_key_of_many_events(spark):
    """200,000 events of one key, in components and as one; the time is in proportion."""
    for step in (1, 40):
        rows = spark.range(200_000).select(F.lit(1).alias("k"), (F.col("id") * step).alias("frame"), F.pmod(F.hash("id"), F.lit(1000)).cast("double").alias("score"))
        began = time.time()
        matched = intervals.greedy_match(rows.where("frame % 3 = 0"), rows.where("frame % 3 > 0"), "k", "frame", 12)
        assert matched.count() == (66_667 if step == 1 else 0)
        kept = trajectory.suppress(rows, "k", "frame", "score", 10).count()
        assert kept == 200_000 if step == 40 else 200_000 / 20 <= kept <= 200_000 / 10
        assert time.time() - began < 60


def test_a_hot_key_is_spread_by_the_plan(spark):
    """Interval joins meet on key and stretch; components are sought by key and bucket."""
    points = spark.range(10).select(F.lit(1).alias("k"), F.col("id").alias("f"))
    spans = spark.range(10).select(F.lit(1).alias("k"), F.col("id").alias("start"), (F.col("id") + 3).alias("end"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    for df in (intervals.points_in_intervals(points, spans, "k", "f"), joins.unclaimed(points, spans, "k", "f"), joins.holding(spans, points, "k", "f"), intervals.overlapping(spans, spans, "k"), joins.claimed(points, spans, "k", "f", "end")):
        join = next(x for x in plan(df).splitlines() if "Join" in x)
        assert join.count("_at#") >= 2, join
    windows = [x for x in plan(scans.cut_at_gaps(points, ["k"], "f", 4)).splitlines() if "Window" in x]
    assert any("_bucket" in x.split("], [")[1] for x in windows)


def test_interval_joins_equal_loops(spark):
    rng = random.Random(3)
    spans = [(rng.choice([1, 1, 2]), a, a + rng.randrange(-3, 40)) for a in (rng.randrange(-60, 200) for _ in range(80))] + [(1, -500, 900)] * 2 + [(2, None, 5), (None, 0, 10)]
    points = [(rng.choice([1, 2, 3]), rng.randrange(-80, 220)) for _ in range(150)] + [(1, 5)] * 3 + [(1, None), (None, 5)]
    p, s = spark.createDataFrame(points, "k int, f int").repartition(3), spark.createDataFrame(spans, "k int, start int, end int").repartition(2)
    ok = [x for x in spans if None not in x and x[1] <= x[2]]
    holds = lambda q, x: q[0] == x[0] and q[1] is not None and x[1] <= q[1] <= x[2]
    key = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    for width in (9, 1000):
        assert key(intervals.points_in_intervals(p, s, "k", "f", width).collect()) == key((*q, x[1], x[2]) for q in points for x in ok if holds(q, x))
        meets = lambda a, b: a[0] == b[0] and a[1] <= b[2] and b[1] <= a[2]
        few = [x for x in ok if x[1] % 3 == 0]
        assert key(intervals.overlapping(s, s.where("start % 3 = 0"), "k", width).collect()) == key(x for x in ok if any(meets(x, y) for y in few))
    assert key(joins.unclaimed(p, s, "k", "f").collect()) == key(q for q in points if not any(holds(q, x) for x in ok))
    assert key(joins.holding(s, p, "k", "f").collect()) == key(x for x in ok if any(holds(q, x) for q in points))
    first = [(*q, *min((x[2], x[1]) for x in ok if holds(q, x))) for q in points if any(holds(q, x) for x in ok)]
    assert key(joins.claimed(p, s, "k", "f", "end").select("k", "f", "end", "start").collect()) == key(first)
    empty = s.limit(0)
    assert intervals.points_in_intervals(p, empty, "k", "f").count() == 0 and joins.unclaimed(p, empty, "k", "f").count() == len(points)


def test_denoising_equals_a_loop_and_streams_batches(spark):
    rng = random.Random(6)
    rows = [(k, f, rng.choice([None, rng.uniform(-5, 105), rng.uniform(40, 60)]), rng.uniform(30, 60)) for k in (1, 2, 3) for f in sorted(rng.sample(range(900), 200))]
    want, last = [], {}
    for k, f, x, y in rows:
        why = "missing" if x is None else None if 0 <= x <= 100 and 0 <= y <= 50 else "out_of_frame"
        if why is None and k in last and math.hypot(x - last[k][1], y - last[k][2]) / max(1, f - last[k][0]) > 5:
            why = "jump"
        if why is None:
            last[k] = (f, x, y)
        want.append((k, f, None if why else x, None if why else y, why is None, why))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = trajectory.denoised(spark.createDataFrame(rows, "k int, f int, x double, y double").repartition(5), "k", "f", "x", "y", 5.0, 100.0, 50.0)
        assert sorted((tuple(r) for r in out.collect()), key=lambda r: r[:2]) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r[5] for r in want} == {None, "missing", "out_of_frame", "jump"}
    assert trajectory.denoised(out.select("k", "f", "x", "y").limit(0), "k", "f", "x", "y", 5.0, 1.0, 1.0).count() == 0


def loop_detect(points, c):
    """The published detectors, point by point."""
    p = sorted(q for q in points if q[1] and q[2] and q[1] > 0 and q[2] > 0)
    serve = next(([(a[0], (a[2] - b[2]) / max(b[0] - a[0], 1), "serve_drop")] for a, b in zip(p, p[1:], strict=False) if (a[2] - b[2]) / max(b[0] - a[0], 1) >= c.slope), [])
    ys, peaks, kinks = [q[2] for q in p], [], []
    for i in range(1, len(p) - 1):
        a, b, d = p[i - 1 : i + 2]
        if ys[i] >= ys[i - 1] and ys[i] >= ys[i + 1]:
            height = ys[i] - min(ys[max(0, i - c.radius) : i] + ys[i + 1 : i + 1 + c.radius])
            if height >= c.prominence:
                peaks.append((b[0], height, "y_peak"))
        u, v = (b[1] - a[1], b[2] - a[2]), (d[1] - b[1], d[2] - b[2])
        if max(b[0] - a[0], d[0] - b[0]) <= c.distance and min(math.hypot(*u), math.hypot(*v)) >= c.step:
            n = math.hypot(*u) * math.hypot(*v)
            turn = 0.0 if n == 0 else math.degrees(math.acos(max(-1.0, min(1.0, (u[0] * v[0] + u[1] * v[1]) / n))))
            if turn >= c.angle:
                kinks.append((b[0], turn, "trajectory_kink"))
    return loop_suppress(serve + loop_suppress(peaks, c.distance) + loop_suppress(kinks, c.distance), c.distance)


def test_detector_search_equals_loops(spark):
    rng = random.Random(8)
    rallies = {(v, r): [(f, rng.choice([0.0, rng.uniform(1, 80), rng.uniform(1, 80)]), float(round(rng.uniform(1, 60)))) for f in sorted(rng.sample(range(240), n))] for v in ("train", "val") for r, n in ((1, 70), (2, 3), (3, 1), (4, 120))}
    truth = {k: [rng.randrange(240) for _ in range(rng.randrange(9))] for k in [*rallies, ("val", 99)]}
    points = spark.createDataFrame([(*k, *p) for k, ps in rallies.items() for p in ps], "v string, r int, frame int, x double, y double").repartition(3)
    truths = spark.createDataFrame([(*k, f) for k, fs in truth.items() for f in fs], "v string, r int, frame int")
    grid = detection.grid([4, 12], [8.0, 25.0], [2, 5], [90.0, 140.0], [5.0], [6.0, 500.0])
    got = {(r.v, r.r, r.candidate): [] for r in detection.detect(points, ["v", "r"], "frame", "x", "y", grid).collect()}
    for r in detection.detect(points, ["v", "r"], "frame", "x", "y", grid).collect():
        got[r.v, r.r, r.candidate].append((r.frame, round(r.score, 6), r.reason))
    for k, ps in rallies.items():
        for c in grid:
            assert sorted(got.get((*k, c.candidate), [])) == [(f, round(s, 6), why) for f, s, why in loop_detect(ps, c)]
    rows = {(r.v, r.candidate): r for r in detection.search(points, truths, ["v", "r"], "frame", "x", "y", grid, 9, "v").collect()}
    assert len(rows) == 2 * len(grid)
    for (v, i), row in rows.items():
        found = {k: [e[0] for e in loop_detect(ps, grid[i - 1])] for k, ps in rallies.items() if k[0] == v}
        errors = [m[2] for k in found for m in loop_match(found[k], truth[k], 9)]
        n, t = sum(map(len, found.values())), sum(len(truth[k]) for k in found)
        assert (row.rally_count, row.predicted_events, row.ground_truth_hits, row.matched_ground_truth, row.extra_predictions, row.missed_ground_truth) == (4, n, t, len(errors), n - len(errors), t - len(errors))
        assert row.mean_abs_error == (pytest.approx(sum(errors) / len(errors)) if errors else None)
        assert row.f1 == pytest.approx(2 * len(errors) / (n + t) if errors else 0)
        assert (row.distance, row.slope) == (grid[i - 1].distance, grid[i - 1].slope)
    chosen = detection.best(spark.createDataFrame(list(rows.values())).where("v = 'val'")).collect()
    order = lambda r: (-r.f1, math.inf if r.mean_abs_error is None else r.mean_abs_error, r.extra_predictions, r.candidate)
    assert [r.candidate for r in chosen] == [min((r for (v, _), r in rows.items() if v == "val"), key=order).candidate]
    assert {r.rally_count for r in detection.search(points, truths.limit(0), ["v", "r"], "frame", "x", "y", grid[:1], 9).collect()} == {8}
    with pytest.raises(ValueError, match="empty"):
        detection.grid([], [1.0], [1], [1.0], [1.0], [1.0])


def test_array_suppression_and_matching_equal_loops_on_long_chains():
    """Rising scores and close events settle one in each round: far more than the rounds over all components."""
    rng = random.Random(11)
    for n, gap, score in ((1500, 2, lambda i: i), (1500, 2, lambda i: -i), (900, 3, lambda i: rng.randrange(9)), (900, 0, lambda i: rng.randrange(5)), (1, 1, lambda i: 0), (0, 1, lambda i: 0)):
        frames = sorted(rng.randrange(gap * n + 1) for _ in range(n))
        rows = [(f, score(i), "") for i, f in enumerate(frames)]
        ranks = np.empty(n, np.int64)
        ranks[sorted(range(n), key=lambda i: (-rows[i][1], i))] = np.arange(n)
        for distance in (0, 1, 5):
            kept = trajectory.suppressed(np.array(frames, np.int64), ranks, distance)
            assert [frames[i] for i in np.flatnonzero(kept)] == sorted(r[0] for r in loop_suppress(rows, distance))
        truth = sorted(rng.randrange(gap * n + 1) for _ in range(n // 2))
        for tolerance in (0, 3):
            places, errors = intervals.matched(np.array(frames, np.int64), np.array(truth, np.int64), tolerance)
            assert sorted(zip(places.tolist(), errors.tolist(), strict=True)) == sorted((m[0], m[2]) for m in loop_match(frames, truth, tolerance))


def test_detector_blocks_hold_whole_keys(spark, monkeypatch):
    """Blocks and batches end anywhere, but no key is cut. Points out of view may be true events; those without a frame count and match nothing."""
    rng = random.Random(12)
    keys = [(v, r) for v in (None, "a", "b") for r in (None, 1, 2, 3)]
    rows = [(*k, f, rng.choice([None, 0.0, *[20.0, 40.0, 61.5] * 3]), rng.choice([None, -1.0, *[5.0, 9.0, 44.0, 80.0, 99.0] * 3]), rng.choice([None, True, False])) for k in keys for f in [None, None, *rng.sample(range(-40, 40), 40)]]
    points = spark.createDataFrame(rows, "v string, r int, frame int, x double, y double, hit boolean").repartition(3)
    grid = detection.grid([3, 12], [8.0, 50.0], [2], [20.0, 140.0], [5.0], [6.0])
    found = lambda: sorted(map(repr, detection.detect(points, ["v", "r"], "frame", "x", "y", grid).collect()))
    searched = lambda p, truths: sorted(map(repr, detection.search(p, truths, ["v", "r"], "frame", "x", "y", grid, 4, "v").collect()))
    keyed = points.dropna(subset=["v", "r"])
    want, by_condition = found(), searched(keyed, F.col("hit"))
    assert by_condition == searched(keyed, keyed.where("hit").union(keyed.limit(1).withColumn("r", F.lit(99))))
    hits = {r.v: r.ground_truth_hits for r in detection.search(keyed, F.col("hit"), ["v", "r"], "frame", "x", "y", grid[:1], 4, "v").collect()}
    assert hits == {v: sum(bool(r[5]) for r in rows if r[0] == v and r[1]) for v in ("a", "b")}
    monkeypatch.setattr(scans, "ROWS_IN", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert found() == want and searched(keyed, F.col("hit")) == by_condition
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    per_key = {k: [(f, x, y) for *k2, f, x, y, _ in rows if tuple(k2) == k and f is not None] for k in keys if None not in k}
    got = {}
    for e in detection.detect(keyed, ["v", "r"], "frame", "x", "y", grid).collect():
        got.setdefault((e.v, e.r, e.candidate), []).append((e.frame, round(e.score, 6), e.reason))
    for k, ps in per_key.items():
        for c in grid:
            assert sorted(got.get((*k, c.candidate), [])) == [(f, round(s, 6), why) for f, s, why in loop_detect(ps, c)]


def test_two_slots_carry_over_batches(spark):
    rows = [(1, f, 0.1 + f / 100, 0.2, 5.0) for f in range(40)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = tracking.two_slots(spark.createDataFrame(rows, "clip int, f int, x double, y double, a double"), ["clip"], "f", "x", "y", "a", 0.5, 0.02, 4).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [(r.frame, r.player) for r in got] == [(f, 0) for f in range(40)]
