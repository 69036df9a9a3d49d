"""Registered queries of array geometry over the vectors of ``embeddings``, each with its SQL.

A vector of 64 values is read as 32 points; values nearer than 0.05 to zero are missing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqmill import functions as fn
from seqmill.functions import tensors
from seqmill.operators import measures
from seqmill.plans.base import table

MATRIX = [[1.2, 0.1, 0.3], [0.05, 0.9, -0.2], [0.01, 0.02, 1.0]]
LENGTHS = (10, 12, 15, 40)


def _poses(spark, sf_dir):
    """vec_id, label, vector (missing values are zero), points."""
    vector = F.transform(F.col("embedding").cast("array<double>"), lambda v: F.when(F.abs(v) < 0.05, 0.0).otherwise(v))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), vector.alias("vector"))
    return rows.withColumn("points", F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.array(F.get("vector", i * 2), F.get("vector", i * 2 + 1))))


_E = """e AS (SELECT vec_id, CAST(label AS BIGINT) AS label, list_transform(CAST(embedding AS DOUBLE[]), lambda v: CASE WHEN abs(v) < 0.05 THEN 0.0 ELSE v END) AS vector FROM embeddings),
    q AS (SELECT vec_id, label, unnest(generate_series(0, 31)) AS i, vector FROM e), p AS (SELECT vec_id, label, i, vector[2 * i + 1] AS x, vector[2 * i + 2] AS y, vector FROM q)"""


def _xy(point, places: int = 6, x: str = "x", y: str = "y"):
    point = F.col(point) if isinstance(point, str) else point
    return F.round(F.get(point, F.lit(0)), places).alias(x), F.round(F.get(point, F.lit(1)), places).alias(y)


def event_positions(spark, sf_dir):
    rows = _poses(spark, sf_dir).withColumn("p", tensors.frame_at(F.col("points"), F.col("label") * 5 - 5))
    return rows.select("vec_id", *_xy("p"), fn.inside_court(F.col("p")).alias("on_court"))


def landings(spark, sf_dir):
    rows = _poses(spark, sf_dir).withColumn("p", tensors.last_visible(F.col("points")))
    return rows.where(F.forall("p", lambda v: v.between(-0.2, 1))).select("vec_id", *_xy("p"))


def projected_points(spark, sf_dir):
    rows = _poses(spark, sf_dir).select("vec_id", F.posexplode("points").alias("joint", "p")).withColumn("c", tensors.project(F.col("p"), MATRIX))
    rows = rows.withColumn("court", tensors.on_unit_court(F.col("c"), -0.5, 1.5, -0.8, 0.9)).withColumn("back", tensors.project(F.col("c"), tensors.inverse(MATRIX)))
    return rows.select("vec_id", F.col("joint").cast("long").alias("joint"), *_xy("court"), *_xy("back", 6, "back_x", "back_y"))


def _boxed(spark, sf_dir):
    """The box is made of the last four values, ten times as large where the label is odd."""
    scale = F.when(F.col("label") % 2 == 1, 10.0).otherwise(1.0)
    return _poses(spark, sf_dir).withColumn("scale", scale).withColumn("box", F.transform(F.slice("vector", 61, 4), lambda v: v * F.col("scale")))


_BOX = "b AS (SELECT *, CASE WHEN label % 2 = 1 THEN 10.0 ELSE 1.0 END * vector[61] AS x1, CASE WHEN label % 2 = 1 THEN 10.0 ELSE 1.0 END * vector[62] AS y1, CASE WHEN label % 2 = 1 THEN 10.0 ELSE 1.0 END * vector[63] AS x2, CASE WHEN label % 2 = 1 THEN 10.0 ELSE 1.0 END * vector[64] AS y2 FROM p)"


def unit_joints(spark, sf_dir):
    rows = _boxed(spark, sf_dir).select("vec_id", F.posexplode(tensors.unit_joints(F.col("points"), F.col("box"))).alias("joint", "p"))
    return rows.select("vec_id", F.col("joint").cast("long").alias("joint"), *_xy("p"))


def feet_points(spark, sf_dir):
    return _boxed(spark, sf_dir).select("vec_id", *_xy(tensors.feet(F.col("points"), F.col("box"))))


def sure_joints(spark, sf_dir):
    scores = F.transform("points", lambda p, i: (i * 7 % 10) / F.lit(10.0))
    rows = _poses(spark, sf_dir).select("vec_id", F.posexplode(tensors.sure_joints(F.col("points"), scores, 0.3)).alias("joint", "p"))
    return rows.select("vec_id", F.col("joint").cast("long").alias("joint"), *_xy("p"))


def framed_points(spark, sf_dir):
    rows = _poses(spark, sf_dir).select("vec_id", F.explode("points").alias("p")).withColumn("seen", F.get("p", F.lit(0)) > 0)
    rows = rows.withColumn("f", tensors.framed(F.get("p", F.lit(0)), F.get("p", F.lit(1)), 1280.0, 720.0, F.col("seen")))
    return rows.groupBy("vec_id").agg(F.count_if("seen").alias("n_seen"), *[F.round(F.sum(F.get("f", F.lit(i)) * 1000), 6).alias(n) for i, n in enumerate(("x", "y"))])


def fitted_lengths(spark, sf_dir):
    zero, out = F.array(F.lit(0.0), F.lit(0.0)), None
    rows = _poses(spark, sf_dir).withColumn("points", F.slice("points", 1, (F.col("label") * 3 + 5).cast("int")))
    for n in LENGTHS:
        kept = rows.select("vec_id", F.lit(n).cast("long").alias("n"), tensors.thinned(F.col("points"), n).alias("kept"))
        one = kept.select("vec_id", "n", F.size("kept").cast("long").alias("n_kept"), F.posexplode(tensors.padded(F.col("kept"), n, zero)).alias("place", "p"))
        out = one if out is None else out.unionByName(one)
    return out.select("vec_id", "n", "n_kept", F.col("place").cast("long").alias("place"), *_xy("p"))


def pose_variants(spark, sf_dir):
    variants = tensors.pose_variants(F.slice("points", 1, 17))
    each = F.array(*[F.struct(F.lit(n).alias("variant"), c.alias("points")) for n, c in variants.items()])
    rows = _poses(spark, sf_dir).select("vec_id", F.explode(each).alias("v")).select("vec_id", "v.variant", F.posexplode("v.points").alias("place", "p"))
    return rows.select("vec_id", "variant", F.col("place").cast("long").alias("place"), *_xy("p"))


def ranged_density(spark, sf_dir):
    return measures.ranged_histogram2d(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", 45)


_ALL = [event_positions, landings, projected_points, unit_joints, feet_points, sure_joints, framed_points, fitted_lengths, pose_variants, ranged_density]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

_BACK = tensors.inverse(MATRIX)


def _homography(m: list[list[float]], x: str, y: str) -> list[str]:
    a, b, c = (f"({r[0]!r}::DOUBLE * {x} + {r[1]!r}::DOUBLE * {y} + {r[2]!r}::DOUBLE)" for r in m)
    return [f"{a} / {c}", f"{b} / {c}"]


_BONES = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(tensors.BONES))
_GATE = "CASE WHEN u.{0} <> 0 AND v.{0} <> 0 THEN {1} ELSE 0 END"

ORACLE_SQL: dict[str, str] = {
    "event_positions": f"""WITH {_E} SELECT vec_id, round(x, 6) AS x, round(y, 6) AS y, (x <> 0 OR y <> 0) AND x BETWEEN -0.2 AND 1.2 AND y BETWEEN -0.2 AND 1.2 AS on_court FROM p WHERE i = least(greatest(label * 5 - 5, 0), 31)""",
    "landings": f"""WITH {_E}, l AS (SELECT vec_id, max(i) AS i FROM p WHERE x <> 0 OR y <> 0 GROUP BY vec_id)
        SELECT vec_id, round(x, 6) AS x, round(y, 6) AS y FROM p JOIN l USING (vec_id, i) WHERE x BETWEEN -0.2 AND 1 AND y BETWEEN -0.2 AND 1""",
    "projected_points": f"""WITH {_E}, c AS (SELECT vec_id, i, {_homography(MATRIX, 'x', 'y')[0]} AS cx, {_homography(MATRIX, 'x', 'y')[1]} AS cy FROM p)
        SELECT vec_id, i AS joint, round((cx + 0.5) / 2, 6) AS x, round((cy + 0.8) / 1.7, 6) AS y, round({_homography(_BACK, 'cx', 'cy')[0]}, 6) + 0 AS back_x, round({_homography(_BACK, 'cx', 'cy')[1]}, 6) + 0 AS back_y FROM c""",
    "unit_joints": f"""WITH {_E}, {_BOX}, d AS (SELECT *, greatest(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 1) AS unit FROM b)
        SELECT vec_id, i AS joint, round(CASE WHEN x > 0 OR y > 0 THEN (x - (x1 + x2) / 2) / unit ELSE 0 END, 6) AS x, round(CASE WHEN x > 0 OR y > 0 THEN (y - (y1 + y2) / 2) / unit ELSE 0 END, 6) AS y FROM d""",
    "feet_points": f"""WITH {_E}, {_BOX} SELECT vec_id, round(coalesce(avg(x) FILTER (i IN (15, 16) AND (x > 0 OR y > 0)), any_value((x1 + x2) / 2)), 6) AS x,
        round(coalesce(avg(y) FILTER (i IN (15, 16) AND (x > 0 OR y > 0)), any_value(y2)), 6) AS y FROM b GROUP BY vec_id""",
    "sure_joints": f"WITH {_E} SELECT vec_id, i AS joint, round(CASE WHEN i * 7 % 10 >= 3 THEN x ELSE 0 END, 6) AS x, round(CASE WHEN i * 7 % 10 >= 3 THEN y ELSE 0 END, 6) AS y FROM p",
    "framed_points": f"""WITH {_E} SELECT vec_id, count(*) FILTER (x > 0) AS n_seen, round(sum(CASE WHEN x > 0 THEN x / 1280.0::DOUBLE * 1000 ELSE 0 END), 6) AS x, round(sum(CASE WHEN x > 0 THEN y / 720.0::DOUBLE * 1000 ELSE 0 END), 6) AS y FROM p GROUP BY vec_id""",
    "fitted_lengths": f"""WITH {_E}, s AS (SELECT vec_id, n, i, x, y, least(label * 3 + 5, 32) AS size FROM p, (SELECT unnest({list(LENGTHS)}) AS n) WHERE i < label * 3 + 5),
        t AS (SELECT *, CASE WHEN size > n THEN size // n + CAST(size % n > n // 2 AS INTEGER) ELSE 1 END AS stride FROM s), k AS (SELECT *, i // stride AS place FROM t WHERE i % stride = 0 AND i // stride < n),
        c AS (SELECT vec_id, n, count(*) AS n_kept FROM k GROUP BY vec_id, n), g AS (SELECT vec_id, n, n_kept, unnest(generate_series(0, n - 1)) AS place FROM c)
        SELECT vec_id, CAST(n AS BIGINT) AS n, n_kept, CAST(place AS BIGINT) AS place, round(coalesce(x, 0), 6) AS x, round(coalesce(y, 0), 6) AS y FROM g LEFT JOIN k USING (vec_id, n, place)""",
    "pose_variants": f"""WITH {_E}, pairs(i, a, b) AS (VALUES {_BONES}), z AS (SELECT u.vec_id, pairs.i, {_GATE.format('x', '(u.x + v.x) / 2')} AS mx, {_GATE.format('y', '(u.y + v.y) / 2')} AS my, {_GATE.format('x', 'v.x - u.x')} AS bx, {_GATE.format('y', 'v.y - u.y')} AS "by"
            FROM pairs JOIN p u ON u.i = a JOIN p v ON v.vec_id = u.vec_id AND v.i = b),
        r AS (SELECT vec_id, unnest(['J', 'JnB_interp', 'JnB_bone', 'Jn2B']) AS variant, i AS place, x, y FROM p WHERE i < 17 UNION ALL SELECT vec_id, unnest(['JnB_interp', 'Jn2B']), 17 + i, mx, my FROM z
            UNION ALL SELECT vec_id, 'JnB_bone', 17 + i, bx, "by" FROM z UNION ALL SELECT vec_id, 'Jn2B', 36 + i, bx, "by" FROM z)
        SELECT vec_id, variant, CAST(place AS BIGINT) AS place, round(x, 6) AS x, round(y, 6) AS y FROM r""",
    "ranged_density": """WITH l AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_extendedprice) AS c, max(l_extendedprice) AS d FROM lineitem)
        SELECT CAST(least(floor((l_quantity - a) / (b - a) * 45), 44) AS INTEGER) AS bx, CAST(least(floor((l_extendedprice - c) / (d - c) * 45), 44) AS INTEGER) AS "by", count(*) AS n FROM lineitem, l GROUP BY 1, 2""",
}
