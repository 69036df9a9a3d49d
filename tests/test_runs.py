"""Tracks, run reports and array files against plain loops."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqmill import sources
from seqmill.operators import reports, tracking


def _follow(frames, split, reach, memory):
    last, out = [(None, memory + 1)] * 2, []
    for f, people in frames:
        for p in (0, 1):
            mine = sorted(c for c in people if (c[1] <= split) == (p == 0))
            at, age = last[p]
            middle = split * 0.5 if p == 0 else split + (1 - split) * 0.5
            best = None
            if mine and age <= memory:
                near = min(mine, key=lambda c: math.dist(c[:2], at))
                best = near if math.dist(near[:2], at) <= reach else None
            elif mine:
                best = max(mine, key=lambda c: c[2] - abs(c[1] - middle) * 10000)
            if best:
                out.append(("m", f, p, *best[:2]))
            last[p] = (best[:2], 0) if best else (at, age + 1)
    return out


def test_two_slots_equal_a_loop(spark):
    r = random.Random(4)
    frames = [(f, [(r.random(), r.random(), r.random() * 2000) for _ in range(r.choice([0, 0, 1, 2, 5]))]) for f in range(120)]
    rows = [("m", f, *c) for f, people in frames for c in people or [(None, None, None)]]
    df = spark.createDataFrame(rows, "clip string, frame long, x double, y double, area double")
    got = sorted(tuple(t) for t in tracking.two_slots(df, ["clip"], "frame", "x", "y", "area", 0.5, 0.3, 4).collect())
    assert got == sorted(_follow(frames, 0.5, 0.3, 4)) and len(got) > 30


def test_batches_are_filled_with_their_last_frame(spark):
    df = spark.createDataFrame([("a", i * 10) for i in range(5)], "k string, f long")
    got = sorted(map(tuple, tracking.batches(df, "k", "f", 4).collect()))
    assert got == [("a", 0, 0, 0, True), ("a", 0, 1, 10, True), ("a", 0, 2, 20, True), ("a", 0, 3, 30, True), ("a", 1, 0, 40, True), ("a", 1, 1, 40, False), ("a", 1, 2, 40, False), ("a", 1, 3, 40, False)]


def test_samples_are_candidates_and_the_same_every_time(spark):
    df = spark.createDataFrame([("a", 0, 100), ("a", 200, 201), ("b", 5, 4)], "k string, start long, end long")
    some = [sorted(map(tuple, tracking.sampled_frames(df.repartition(n), "k", 7, 5, 1, True).collect())) for n in (1, 3)]
    assert some[0] == some[1] and len(some[0]) == 7 and all(f % 5 == 0 and f <= 100 for _, f in some[0])
    assert len(tracking.sampled_frames(df, "k", 99, 5).collect()) == 22


def test_early_stopping_ends_after_the_patience(spark):
    values = [1.0, 3.0, 2.0, 3.0, 1.0, 9.0]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "k string, e int, v double")
    got = [(t["e"], t["is_best"], t["stale"]) for t in reports.early_stopping(df, ["k"], "e", "v", 3).orderBy("e").collect()]
    assert got == [(0, True, 0), (1, True, 0), (2, False, 1), (3, False, 2), (4, False, 3)]


@pytest.mark.parametrize("df", [1, 2, 5, 14, 31])
def test_t_probability_equals_an_integral(spark, df):
    scale = math.gamma((df + 1) / 2) / math.sqrt(df * math.pi) / math.gamma(df / 2)
    ts = [0.0, 0.3, -1.7, 2.5]
    got = [t["p"] for t in spark.createDataFrame([(i, t) for i, t in enumerate(ts)], "i int, t double").select("i", reports.t_probability(F.col("t"), df).alias("p")).orderBy("i").collect()]
    for t, p in zip(ts, got):
        x = np.linspace(0, abs(t), 20001)
        assert abs(1 - 2 * np.trapezoid(scale * (1 + x * x / df) ** (-(df + 1) / 2), x) - p) < 1e-7


def test_clear_clusters_are_stable(spark):
    df = spark.createDataFrame([([float(i % 2 * 50 + i * 0.01), 1.0],) for i in range(40)], "v array<double>")
    got = reports.bootstrap_stability(df, "v", 2, 3, 1).first()
    assert (got["k"], got["fits"], got["mean_ari"], got["std_ari"]) == (2, 3, 1.0, 0.0)


def test_statuses(spark):
    df = spark.createDataFrame([(1, 0, 0.1), (0, 0, 0.9), (4, 4, 0.5), (4, 1, None)], "a int, b int, r double")
    got = df.select(
        reports.sample_status(F.col("a"), F.col("b")).alias("s"), reports.coverage_status(F.col("a"), F.col("b")).alias("c"), reports.review_status({"r": (F.col("r"), 0.5)}, F.lit(True)).alias("q"),
        reports.completion_status(F.col("b"), F.col("a"), F.lit(0), F.lit("fine")).alias("e"),
    ).collect()
    assert [tuple(t) for t in got] == [
        ("missing_negative_images", "failed_zero_annotation_coverage", "quality_ready", "blocked"), ("decode_or_write_failed", "not_evaluated", "completed_needs_quality_review", "blocked"),
        ("ok", "passed_annotation_coverage_smoke", "quality_ready", "fine"), ("ok", "needs_calibration_low_annotation_coverage", "completed_needs_quality_review", "partial_with_problems"),
    ]


def test_array_files_and_inventory(spark, tmp_path):
    a, b = np.arange(24, dtype="float32").reshape(4, 3, 2), np.array([True, False])
    np.save(tmp_path / "a.npy", a)
    np.savez(tmp_path / "b.npz", mask=b, whole=a)
    got = {(t["path"].split("/")[-1], t["name"], t["row_index"]): (tuple(t["shape"]), list(t["values"])) for t in sources.read_arrays(spark, str(tmp_path)).collect()}
    assert len(got) == 10 and got["a.npy", "", 2] == ((3, 2), [float(v) for v in range(12, 18)]) and got["b.npz", "mask", 0] == ((), [1.0])
    files = {t["path"].split("/")[-1]: t["sha256"] for t in sources.file_inventory(spark, str(tmp_path), hashed_below=(tmp_path / "b.npz").stat().st_size).collect()}
    assert files == {"a.npy": hashlib.sha256((tmp_path / "a.npy").read_bytes()).hexdigest(), "b.npz": None}
    good = spark.createDataFrame([([1.0, 2.0],), ([1.0, float("nan")],)], "v array<double>")
    assert sources.checked_arrays(good.limit(1), "v", 2).count() == 1
    with pytest.raises(Exception, match="not 2 finite"):
        sources.checked_arrays(good, "v", 2).collect()
