import math
import random

import numpy as np
import pytest

from seqmill.operators import clusterings as c
from seqmill.operators import measures


def table(spark, rows):
    return spark.createDataFrame(rows, "key string, v array<double>").repartition(3)


def two_clouds(n=40, seed=1):
    rng = random.Random(seed)
    return [(f"u{i}", [rng.gauss(0, 1) + 12 * (i % 2), rng.gauss(0, 1), rng.gauss(0, 1)]) for i in range(n)]


def test_rounds_equal_a_loop(spark):
    """Every fit ends where Lloyd's rounds from its own seeds end, weights of resamples included."""
    rows = two_clouds(60)
    points = c._points(table(spark, rows), "key", "v")
    got = [(r.id, r.vector) for r in points.collect()]
    ids, x = np.array([g[0] for g in got]), np.array([g[1] for g in got])
    fits = [c.Fit(i, k, s, r) for i, (k, s, r) in enumerate([(2, 0, -1), (3, 1, -1), (3, 1, 4), (5, 0, 2)])]
    for lanes in (1, 3):
        held = c._in_lanes(points, lanes)
        seeds, done = c._seeded(held, fits, 7, lanes), c._rounds(held, fits, 7, 100, lanes)
        for f in fits:
            w, centres = c.weights(ids, f.resample, 7), seeds[f.fit].copy()
            assert len(centres) == f.k and all((w[(x == s).all(1)] > 0).any() for s in centres)
            for _ in range(100):
                label = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
                for k in range(f.k):
                    if w[label == k].sum() > 0:
                        centres[k] = np.average(x[label == k], axis=0, weights=w[label == k])
            assert np.allclose(done[f.fit][0], centres)
            assert done[f.fit][1] == pytest.approx((w * ((x[:, None] - centres[None]) ** 2).sum(2).min(1)).sum())


def test_resample_weights_are_poisson():
    w = np.array([c.weights(np.arange(2000), r, 0) for r in range(50)])
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.03 and len({tuple(x) for x in w}) == 50


def test_silhouette_equals_a_loop(spark):
    rows = two_clouds(30, 3)
    points = c._points(table(spark, rows), "key", "v")
    got = {r.id: r.vector for r in points.collect()}
    labels = {k: {i: n % k if n else 9 for n, i in enumerate(sorted(got))} for k in (2, 3)} | {1: dict.fromkeys(got, 0)}
    made = spark.createDataFrame([(i, k, g) for k, of in labels.items() for i, g in of.items()], "id long, k int, cluster int")
    scores = {r.k: r.silhouette for r in c.silhouettes(points, made).collect()}
    for k, of in labels.items():
        total = []
        for i, v in got.items():
            far = {}
            for j, u in got.items():
                if i != j:
                    far.setdefault(of[j], []).append(math.dist(v, u))
            mean = {g: sum(d) / len(d) for g, d in far.items()}
            a, others = mean.get(of[i]), [m for g, m in mean.items() if g != of[i]]
            total.append(0.0 if a is None or not others else (min(others) - a) / max(a, min(others)))
        assert scores[k] is None if k == 1 else scores[k] == pytest.approx(sum(total) / len(total))


def test_rand_scores_equal_the_single_one(spark):
    rng = random.Random(2)
    rows = [(g, rng.randrange(3), rng.randrange(1 + g)) for g in range(4) for _ in range(50)]
    df = spark.createDataFrame(rows, "g int, a int, b int")
    got = {r.g: r.ari for r in c.rand_scores(df, ["g"], "a", "b").collect()}
    for g in range(4):
        one = measures.adjusted_rand(df.where(f"g = {g}"), "a", "b").first()["ari"]
        assert got[g] == pytest.approx(one)
    assert c.rand_scores(spark.createDataFrame([(1, 0, 0)] * 3, "g int, a int, b int"), ["g"], "a", "b").first()["ari"] == 1


def test_sweep_finds_the_clear_clusters_and_repeats(spark):
    rows = two_clouds() + [("null", None), ("hole", [1.0, None, 2.0])]
    runs = [sorted(tuple(r) for r in c.sweep(table(spark, rows), "key", "v", [2, 3, 90], 4, 6, 2).collect()) for _ in range(2)]
    assert runs[0] == runs[1] and [r[0] for r in runs[0]] == [2, 3]
    k, silhouette, mean, std, fits, size, share = runs[0][0]
    assert silhouette > 0.7 and mean == pytest.approx(1) and std == pytest.approx(0) and (fits, size, share) == (6, 20, 0.5)
    assert c.choose(c.sweep(table(spark, rows), "key", "v", [2, 3], 3, 2, 1)).first()["k"] == 2
    results = spark.createDataFrame([(2, 0.5, 0.9, 1, 0.1), (3, 0.4, 0.9, 2, 0.1), (4, 0.4, 0.9, 2, 0.2), (5, None, None, 3, 0.3)], "k int, silhouette double, mean_ari double, least_size long, least_share double")
    assert c.choose(results).first()["k"] == 4


def test_sweep_of_empty_repeated_and_unequal_rows(spark):
    assert c.sweep(table(spark, []), "key", "v", [2], 1, 1, 1).count() == 0
    same = c.sweep(table(spark, [("a", [1.0, 2.0]), ("b", [1.0, 2.0]), ("c", [1.0, 2.0])]), "key", "v", [2], 2, 2, 1).first()
    assert (same.silhouette, same.fits, same.least_size) == (None, 0, 0)
    with pytest.raises(ValueError, match="length"):
        c.sweep(table(spark, [("a", [1.0]), ("b", [1.0, 2.0])]), "key", "v", [2], 1, 1, 1)
