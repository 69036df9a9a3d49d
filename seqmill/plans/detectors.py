"""Registered queries of the detector search and of carried-state scans, each with its SQL.

A bout is a rally, its events the points of a trajectory (value across, confidence along), and
purchases are the true events.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqmill.operators import detection, trajectory
from seqmill.plans.base import LOG
from seqmill.plans.tables import bouts

GRID = detection.grid([4, 10], [20.0, 60.0], [2, 4], [60.0, 120.0], [5.0], [15.0])
TOLERANCE = 5
KEYS = ["rally", "bout"]


def _points(spark, sf_dir):
    return bouts(spark, sf_dir).select(*KEYS, "token", (F.col("rank") * 3).alias("frame"), (F.col("confidence") * 100 + 1).alias("x"), F.col("value").alias("y"))


def detected_events(spark, sf_dir):
    found = detection.detect(_points(spark, sf_dir), KEYS, "frame", "x", "y", GRID)
    return found.select(*KEYS, "candidate", "frame", F.round("score", 6).alias("score"), "reason")


def _searched(spark, sf_dir, *splits):
    """Half of the users are the split to choose by. A split is searched alone where only that one is asked for: its rows don't depend on others."""
    p = _points(spark, sf_dir).withColumn("split", F.when(F.col("rally") % 2 == 0, "val").otherwise("train")).where(F.col("split").isin(*splits))
    found = detection.search(p, F.col("token") == "purchase", ["split", *KEYS], "frame", "x", "y", GRID, TOLERANCE, "split")
    return found.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1", "mean_abs_error")})


def detector_search(spark, sf_dir):
    return _searched(spark, sf_dir, "val", "train")


def best_detector(spark, sf_dir):
    return detection.best(_searched(spark, sf_dir, "val"))


def _denoised(spark, sf_dir):
    return trajectory.denoised(bouts(spark, sf_dir).select(*KEYS, "rank", "value", "confidence"), KEYS, "rank", "value", "confidence", 30.0, 150.0, 0.9)


def denoised_points(spark, sf_dir):
    return _denoised(spark, sf_dir)


def removed_points(spark, sf_dir):
    why = F.col("reason")
    return _denoised(spark, sf_dir).groupBy("rally").agg(F.count_if("visible").alias("n_visible"), F.count_if(why == "jump").alias("n_jumps"), F.count_if(why == "out_of_frame").alias("n_outside"))


_ALL = (detected_events, detector_search, best_detector, denoised_points, removed_points)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

_VALUES = ", ".join(f"({c.candidate}, {c.distance}, {c.prominence!r}::DOUBLE, {c.radius}, {c.angle!r}::DOUBLE, {c.step!r}::DOUBLE, {c.slope!r}::DOUBLE)" for c in GRID)


def _low(side: str) -> str:
    frame = {"a": "BETWEEN {r} PRECEDING AND 1 PRECEDING", "b": "BETWEEN 1 FOLLOWING AND {r} FOLLOWING"}[side]
    return ", ".join(f"coalesce(min(y) OVER (PARTITION BY rally, bout ORDER BY frame ROWS {frame.format(r=r)}), y) AS {side}{r}" for r in sorted({c.radius for c in GRID}))


def _kept(name: str, rows: str, keys: str) -> str:
    """Greedy suppression of ``rows`` (numbered by i) one after the other."""
    on = " AND ".join(f"o.{k} = r.{k}" for k in keys.split(", "))
    return f"""{name} AS (SELECT {keys}, i, frame, score, reason, tie, distance, true AS ok, [frame] AS kept FROM {rows} WHERE i = 1
            UNION ALL SELECT {", ".join(f"r.{k}" for k in keys.split(", "))}, o.i, o.frame, o.score, o.reason, o.tie, o.distance, g.ok, CASE WHEN g.ok THEN list_append(r.kept, o.frame) ELSE r.kept END
            FROM {name} r JOIN {rows} o ON {on} AND o.i = r.i + 1, LATERAL (SELECT len(list_filter(r.kept, lambda k: abs(k - o.frame) < o.distance)) = 0 AS ok) g)"""


_RADII = sorted({c.radius for c in GRID})
_HEIGHT = "CASE radius " + " ".join(f"WHEN {r} THEN y - least(a{r}, b{r})" for r in _RADII) + " END"
_DETECT = f"""WITH RECURSIVE {LOG}, p AS (SELECT rally, (rank - 1) // 10 + 1 AS bout, token, rank * 3 AS frame, confidence * 100 + 1 AS x, value AS y FROM s),
    c(candidate, distance, prominence, radius, angle, step, slope) AS (VALUES {_VALUES}),
    n AS (SELECT *, frame - lag(frame) OVER w AS g1, lead(frame) OVER w - frame AS g2, x - lag(x) OVER w AS x1, y - lag(y) OVER w AS y1, lead(x) OVER w - x AS x2, lead(y) OVER w - y AS y2, {_low('a')}, {_low('b')}
        FROM p WHERE x > 0 AND y > 0 WINDOW w AS (PARTITION BY rally, bout ORDER BY frame)),
    m AS (SELECT *, sqrt(x1 * x1 + y1 * y1) AS s1, sqrt(x2 * x2 + y2 * y2) AS s2, -y2 / greatest(g2, 1) AS rise FROM n),
    t AS (SELECT *, CASE WHEN s1 * s2 = 0 THEN 0 ELSE degrees(acos(least(1, greatest(-1, (x1 * x2 + y1 * y2) / (s1 * s2))))) END AS turn FROM m),
    e AS (SELECT rally, bout, candidate, frame, {_HEIGHT} AS score, 'y_peak' AS reason, 1 AS tie, distance FROM t, c WHERE y1 >= 0 AND y2 <= 0 AND {_HEIGHT} >= prominence
        UNION ALL SELECT rally, bout, candidate, frame, turn, 'trajectory_kink', 2, distance FROM t, c WHERE greatest(g1, g2) <= distance AND least(s1, s2) >= step AND turn >= angle AND g1 IS NOT NULL AND g2 IS NOT NULL),
    f AS (SELECT rally, bout, candidate, min(frame) AS frame, arg_min(rise, frame) AS score, 'serve_drop' AS reason, 0 AS tie, any_value(distance) AS distance FROM t, c WHERE rise >= slope GROUP BY rally, bout, candidate),
    o1 AS (SELECT *, row_number() OVER (PARTITION BY rally, bout, candidate, tie ORDER BY score DESC, frame) AS i FROM e),
    {_kept('r1', 'o1', 'rally, bout, candidate, tie').replace('score, reason, tie, distance, true', 'score, reason, distance, true').replace('o.reason, o.tie, o.distance', 'o.reason, o.distance')},
    u AS (SELECT rally, bout, candidate, frame, score, reason, tie, distance FROM r1 WHERE ok UNION ALL SELECT rally, bout, candidate, frame, score, reason, tie, distance FROM f),
    o2 AS (SELECT *, row_number() OVER (PARTITION BY rally, bout, candidate ORDER BY score DESC, tie, frame) AS i FROM u),
    {_kept('r2', 'o2', 'rally, bout, candidate')}, d AS (SELECT rally, bout, candidate, frame, score, reason FROM r2 WHERE ok)"""
_SEARCH = f"""{_DETECT},
    v AS (SELECT rally, bout, list(frame ORDER BY frame) AS ys FROM p WHERE token = 'purchase' GROUP BY rally, bout),
    dn AS (SELECT *, row_number() OVER (PARTITION BY rally, bout, candidate ORDER BY frame) AS i FROM d),
    z AS (SELECT DISTINCT rally, bout, candidate, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS x, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS pick FROM d JOIN v USING (rally, bout)
        UNION ALL SELECT rally, bout, candidate, i, x, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, pick FROM (SELECT z.rally, z.bout, z.candidate, dn.i, dn.frame AS x, z.used,
            list_sort(list_transform(list_filter(list_zip(v.ys, generate_series(1, len(v.ys))), lambda y: abs(y[1] - dn.frame) <= {TOLERANCE} AND NOT list_contains(z.used, y[2])), lambda y: [abs(y[1] - dn.frame), y[1], y[2]]))[1][3] AS pick
            FROM z JOIN dn ON dn.rally = z.rally AND dn.bout = z.bout AND dn.candidate = z.candidate AND dn.i = z.i + 1 JOIN v ON v.rally = z.rally AND v.bout = z.bout)),
    h AS (SELECT candidate, rally % 2 AS side, count(*) AS m, sum(abs(x - ys[pick])) AS err FROM z JOIN v USING (rally, bout) WHERE pick IS NOT NULL GROUP BY ALL),
    pe AS (SELECT candidate, rally % 2 AS side, count(*) AS p FROM d GROUP BY ALL), tr AS (SELECT rally % 2 AS side, count(DISTINCT (rally, bout)) AS units, count(*) FILTER (token = 'purchase') AS t FROM p GROUP BY ALL),
    q AS (SELECT c.*, CASE WHEN side = 0 THEN 'val' ELSE 'train' END AS split, units, t, coalesce(p, 0) AS p, coalesce(m, 0) AS m, err FROM c CROSS JOIN tr LEFT JOIN pe USING (candidate, side) LEFT JOIN h USING (candidate, side)),
    w AS (SELECT candidate, split, units AS rally_count, p AS predicted_events, t AS ground_truth_hits, m AS matched_ground_truth, t - m AS missed_ground_truth, p - m AS extra_predictions,
        round(CASE WHEN p > 0 THEN m / p ELSE 0 END, 9) AS precision, round(CASE WHEN t > 0 THEN m / t ELSE 0 END, 9) AS recall, round(CASE WHEN m > 0 THEN 2 * (m / p) * (m / t) / (m / p + m / t) ELSE 0 END, 9) AS f1,
        round(CASE WHEN m > 0 THEN err / m END, 9) AS mean_abs_error, distance, prominence, radius, angle, step, slope FROM q)"""
_SCANNED = f"""WITH RECURSIVE {LOG}, b AS (SELECT *, (rank - 1) // 10 + 1 AS bout FROM s),
    r AS (SELECT rally, bout, (bout - 1) * 10 AS rank, CAST(NULL AS BIGINT) AS last, CAST(NULL AS DOUBLE) AS lv, CAST(NULL AS DOUBLE) AS lc, CAST(NULL AS VARCHAR) AS reason FROM (SELECT DISTINCT rally, bout FROM b)
        UNION ALL SELECT r.rally, r.bout, b.rank, CASE WHEN why IS NULL THEN b.rank ELSE last END, CASE WHEN why IS NULL THEN b.value ELSE lv END, CASE WHEN why IS NULL THEN b.confidence ELSE lc END, why
        FROM r JOIN b ON b.rally = r.rally AND b.bout = r.bout AND b.rank = r.rank + 1, LATERAL (SELECT CASE WHEN NOT (b.value BETWEEN 0 AND 150 AND b.confidence BETWEEN 0 AND CAST(0.9 AS DOUBLE)) THEN 'out_of_frame'
            WHEN last IS NOT NULL AND sqrt((b.value - lv) * (b.value - lv) + (b.confidence - lc) * (b.confidence - lc)) / greatest(b.rank - last, 1) > 30 THEN 'jump' END AS why)),
    k AS (SELECT r.rally, r.bout, r.rank, CASE WHEN reason IS NULL THEN value END AS value, CASE WHEN reason IS NULL THEN confidence END AS confidence, reason IS NULL AS visible, reason FROM r JOIN b ON b.rally = r.rally AND b.rank = r.rank AND b.bout = r.bout)"""

ORACLE_SQL: dict[str, str] = {
    "detected_events": f"{_DETECT} SELECT rally, bout, candidate, frame, round(score, 6) AS score, reason FROM d",
    "detector_search": f"{_SEARCH} SELECT * FROM w",
    "best_detector": f"{_SEARCH} SELECT * FROM w WHERE split = 'val' ORDER BY f1 DESC, mean_abs_error ASC NULLS LAST, extra_predictions, candidate LIMIT 1",
    "denoised_points": f"{_SCANNED} SELECT * FROM k",
    "removed_points": f"{_SCANNED} SELECT rally, count(*) FILTER (visible) AS n_visible, count(*) FILTER (reason = 'jump') AS n_jumps, count(*) FILTER (reason = 'out_of_frame') AS n_outside FROM k GROUP BY rally",
}
