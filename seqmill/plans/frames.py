"""Registered queries of aliases, mask statistics, regions of grids, trails, windows and evaluation groups, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqmill.operators import aliases, evaluation, masks, regions, sequences, trajectory
from seqmill.plans.base import JUDGED, LOG, judged, log, table

TOKENS = ["click", "error", "purchase", "signup", "view"]


def _manifest(spark, sf_dir):
    """One to three events of a user share a frame; clips are their ids."""
    return log(spark, sf_dir).where("rank % 7 <> 1").select("rally", F.floor(F.col("rank") / 3).alias("frame"), "rank", F.col("event_id").alias("clip_id"), (F.col("event_id") % 4 + 20).alias("frame_count"), "token")


def _expansion(spark, sf_dir):
    m = _manifest(spark, sf_dir)
    quality = m.select("clip_id", (F.col("clip_id") % 3 + 20).alias("frame_count"), "rank", (F.col("clip_id") % 10).alias("missing"))
    targets = m.select("rally", "frame", (F.col("clip_id") + 1_000_000_000).alias("clip_id"))
    return aliases.expand(m, quality, targets, ["rally", "frame"], "rank", "clip_id")


def expanded_aliases(spark, sf_dir):
    """Each row after the expansion, with its validation."""
    found = _expansion(spark, sf_dir)
    return found.rows.join(found.quality.select("clip_id", F.col("frame_count").alias("checked_frames"), F.col("rank").alias("checked_rank"), "missing"), "clip_id")


def alias_repairs(spark, sf_dir):
    return _expansion(spark, sf_dir).counts


def manifest_contract(spark, sf_dir):
    """Orders as a manifest, their lines as its validation, their clerks as the files they name."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("clip"), (F.col("o_orderkey") % 7 + 1).alias("frames"), F.when(F.col("o_orderkey") % 5 > 0, F.dayofmonth("o_orderdate")).alias("event"), F.lit(2).alias("low"), F.lit(27).alias("high"), F.col("o_orderpriority").alias("file"))
    checked = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("clip")).agg(F.count("*").alias("frames"))
    files = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0 AND o_orderpriority <> '1-URGENT'").select("o_orderpriority")
    return aliases.source_contract(o, checked, files, "clip", "frames", "event", "low", "high", "file")


def _tensors(spark, sf_dir):
    """A vector as a frame of two units with two joints each, their positions and a third point; labels are clips."""
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(F.abs(x) < 0.05, 0.0).otherwise(x))
    point = lambda i: F.array(F.get("v", F.lit(i)), F.get("v", F.lit(i + 1)))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("clip"), v.alias("v"))
    rows = rows.select("vec_id", "clip", F.array(F.array(point(0), point(2)), F.array(point(4), point(6))).alias("joints"), F.transform(F.array(point(8), point(10)), lambda p: F.transform(p, lambda x: F.when(x != 0, 0.5 + 4 * x).otherwise(0.0))).alias("positions"), point(12).alias("shuttle"))
    nonzero = lambda x: x != 0
    pose = masks.reduced(masks.mapped(F.col("joints"), 3, nonzero), ["unit", "joint", "xy"], ["joint", "xy"], "all")
    place = masks.reduced(masks.mapped(F.col("positions"), 2, nonzero), ["unit", "xy"], ["xy"], "any")
    rows = rows.withColumns({"pose_observed": pose, "position_observed": place})
    return rows.withColumns({"pose_valid": F.transform("pose_observed", lambda p, i: p | (F.col("vec_id") % 3 == i)), "position_valid": F.transform("position_observed", lambda p, i: p | (F.col("vec_id") % 4 == i))})


def _rounded(rows):
    return rows.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes])


def clip_statistics(spark, sf_dir):
    return _rounded(masks.clip_statistics(_tensors(spark, sf_dir), ["clip"], joints=2))


def branch_statistics(spark, sf_dir):
    return _rounded(masks.branch_statistics(_tensors(spark, sf_dir), ["clip"]))


def largest_regions(spark, sf_dir):
    """A vector as eight lines of eight cells."""
    lines = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, F.lit(8)))
    return regions.largest_region(table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(lines).alias("y", "line")), ["vec_id"], "y", "line", 0.05)


def point_trails(spark, sf_dir):
    p = log(spark, sf_dir).select("rally", (F.col("rank") * 3 + F.col("event_id") % 3).alias("frame"), F.col("value").alias("x"), (F.col("confidence") * 100).alias("y"), (F.col("token") != "error").alias("seen"))
    made = trajectory.trails(p, ["rally"], "frame", "x", "y", 20, "seen", width=1000)
    text = F.array_join(F.transform("trail", lambda t: F.concat_ws(":", t["frame"], F.bround(t["x"]).cast("long"))), " ")
    return made.select("rally", "frame", F.size("trail").cast("long").alias("n_points"), text.alias("trail"))


def clamped_windows(spark, sf_dir):
    e = log(spark, sf_dir).select("rally", (F.col("rank") * 7 + F.col("rank") % 3).alias("frame"), F.lit(5).cast("long").alias("lo")).withColumn("hi", F.lit(1_000_000).cast("long"))
    return sequences.clamped_windows(e, "rally", "frame", "lo", "hi", 24)


def evaluation_groups(spark, sf_dir):
    code = lambda c: F.array_position(F.array(*[F.lit(t) for t in TOKENS]), F.col(c)).cast("int") - 1
    rows = judged(spark, sf_dir).select(
        (F.col("rally") % 4).alias("video"), F.when(F.col("event_id") % 7 == 0, -1).otherwise(code("token")).alias("truth"), code("guess").alias("predicted"), F.when(F.col("rally") % 3 == 0, "test").when(F.col("rally") % 3 == 1, "val").otherwise("train").alias("split"),
        F.when(F.col("event_id") % 11 == 0, "shared").alias("alias"), F.when(F.col("event_id") % 13 == 0, 1.0).otherwise(F.col("confidence")).alias("missing"), (F.col("rank") % 5 / 4).alias("top"), (F.col("rank") % 9 / 8).alias("bottom"), (F.col("event_id") % 17 / 20).alias("both"), "value",
    )
    groups = evaluation.standing_groups("truth", "split", "alias", "missing", "top", "bottom", "both")
    unit = ("exact_label_video_", "video", groups["exact_label_clean"])
    return _rounded(evaluation.group_scores(rows, groups, "truth", "predicted", {"near": F.col("value") > 60}, unit))


_ALL = (expanded_aliases, alias_repairs, manifest_contract, clip_statistics, branch_statistics, largest_regions, point_trails, clamped_windows, evaluation_groups)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

_SHARED = f"""WITH {LOG}, m AS (SELECT rally, rank // 3 AS frame, rank, event_id AS clip_id, event_id % 4 + 20 AS frame_count, token FROM s WHERE rank % 7 <> 1),
    n AS (SELECT *, count(*) OVER w AS n, last_value(clip_id) OVER (w ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS source, row_number() OVER (w ORDER BY rank) AS i, row_number() OVER (w ORDER BY clip_id) AS j FROM m WINDOW w AS (PARTITION BY rally, frame))"""

_FRAMES = f"""e AS (SELECT vec_id, CAST(label AS BIGINT) AS clip, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CASE WHEN abs(x) < 0.05 THEN 0.0 ELSE x END) AS v FROM embeddings),
    f AS (SELECT vec_id, clip, {", ".join(f"v[{i + 1}] AS j{i}" for i in range(8))}, {", ".join(f"CASE WHEN v[{i + 9}] <> 0 THEN 0.5 + 4 * v[{i + 9}] ELSE 0.0 END AS p{i}" for i in range(4))}, v[13] AS s0, v[14] AS s1 FROM e),
    g AS (SELECT *, j0 * j1 * j2 * j3 <> 0 AS po0, j4 * j5 * j6 * j7 <> 0 AS po1, p0 <> 0 OR p1 <> 0 AS qo0, p2 <> 0 OR p3 <> 0 AS qo1 FROM f),
    h AS (SELECT *, po0 OR vec_id % 3 = 0 AS pv0, po1 OR vec_id % 3 = 1 AS pv1, qo0 OR vec_id % 4 = 0 AS qv0, qo1 OR vec_id % 4 = 1 AS qv1 FROM g)"""


def _zeros(names):
    return " + ".join(f"CAST({n} = 0 AS INTEGER)" for n in names)


def _outer(p, q):
    return f"CAST({p} < -0.2 OR {p} > 1.2 AS INTEGER) + CAST({q} < -0.2 OR {q} > 1.2 AS INTEGER)"


def _rate(flag, name):
    return f"round(avg(CAST({flag} AS INTEGER)), 9) AS {name}"


_J, _P = [f"j{i}" for i in range(8)], [f"p{i}" for i in range(4)]
_OUT = f"CASE WHEN {{0}} THEN {_outer('p0', 'p1')} ELSE 0 END + CASE WHEN {{1}} THEN {_outer('p2', 'p3')} ELSE 0 END"
_ANY_POSE = [" OR ".join(f"{j} <> 0" for j in half) for half in (_J[:4], _J[4:])]
_LABELLED, _CLEAN, _TEST = "truth >= 0", "alias IS NULL", "split = 'test'"
_OURS = f"{_TEST} AND {_CLEAN}"
_GROUPS = {
    "all_candidates": "true", "exact_label_all": _LABELLED, "exact_label_clean": f"{_LABELLED} AND {_CLEAN}", "simultaneous_event_alias_diagnostic": "alias IS NOT NULL",
    "reference_test_primary": _OURS, "reference_test_all_including_aliases": _TEST, "reference_val_diagnostic": f"split = 'val' AND {_CLEAN}", "reference_val_all_including_aliases": "split = 'val'",
    "exact_label_pose_dropout_lt_50": f"{_LABELLED} AND missing < 0.5", "reference_test_pose_dropout_lt_50": f"{_OURS} AND missing < 0.5", "exact_label_pose_dropout_lt_25": f"{_LABELLED} AND missing < 0.25",
    "reference_test_pose_dropout_lt_25": f"{_OURS} AND missing < 0.25", "exact_label_all_pose_missing": f"{_LABELLED} AND missing = 1", "reference_test_top_pose_valid_ge_75": f"{_OURS} AND top >= 0.75",
    "reference_test_top_pose_valid_lt_50": f"{_OURS} AND top < 0.5", "reference_test_bottom_pose_valid_ge_75": f"{_OURS} AND bottom >= 0.75", "reference_test_both_pose_missing_lt_10": f"{_OURS} AND both_ < CAST(0.1 AS DOUBLE)",
}
_CODES = "list_position(['click', 'error', 'purchase', 'signup', 'view'], {}) - 1"

ORACLE_SQL: dict[str, str] = {
    "expanded_aliases": f"""{_SHARED}, c AS (SELECT rally, frame, arg_max(frame_count, (CAST(frame_count = source % 3 + 20 AS INTEGER), rank)) AS frame_count, arg_max(token, (CAST(frame_count = source % 3 + 20 AS INTEGER), rank)) AS token FROM n GROUP BY rally, frame)
        SELECT rally, frame, rank, clip_id, frame_count, token, '' AS alias_source, clip_id % 3 + 20 AS checked_frames, rank AS checked_rank, clip_id % 10 AS missing FROM n WHERE n = 1
        UNION ALL SELECT n.rally, n.frame, n.rank, t.clip_id + 1000000000, c.frame_count, c.token, CAST(n.source AS VARCHAR), n.source % 3 + 20, n.rank, n.source % 10
        FROM n JOIN n AS t ON t.rally = n.rally AND t.frame = n.frame AND t.j = n.i JOIN c ON c.rally = n.rally AND c.frame = n.frame WHERE n.n > 1""",
    "alias_repairs": f"{_SHARED} SELECT count(*) FILTER (i = 1) AS groups_repaired, count(*) AS aliased_rows FROM n WHERE n > 1",
    "manifest_contract": """WITH q AS (SELECT l_orderkey, count(*) AS frames FROM lineitem GROUP BY 1), f AS (SELECT DISTINCT o_orderpriority AS file FROM orders WHERE o_orderkey % 3 = 0 AND o_orderpriority <> '1-URGENT'),
        o AS (SELECT o_orderkey, o_orderkey % 7 + 1 AS own, q.frames, f.file, CASE WHEN o_orderkey % 5 > 0 THEN day(o_orderdate) END AS event FROM orders LEFT JOIN q ON l_orderkey = o_orderkey LEFT JOIN f ON file = o_orderpriority)
        SELECT 'duplicate_keys' AS "check", count(*) - count(DISTINCT o_orderkey) AS n FROM o UNION ALL SELECT 'missing_validation', count(*) FILTER (frames IS NULL) FROM o UNION ALL SELECT 'frame_count_mismatches', count(*) FILTER (own <> frames) FROM o
        UNION ALL SELECT 'missing_sidecars', count(*) FILTER (file IS NULL) FROM o UNION ALL SELECT 'event_outside_window', count(*) FILTER (event NOT BETWEEN 2 AND 27) FROM o""",
    "clip_statistics": f"""WITH {_FRAMES} SELECT clip, count(*) AS frame_count, true AS valid_shape,
        {", ".join(_rate(f"{a}{b}{u}", f"p{u + 1}_{w}_{k}_rate") for a, w in (("p", "pose"), ("q", "position")) for b, k in (("o", "observed"), ("v", "valid")) for u in (0, 1))},
        {", ".join(f"count(*) FILTER (NOT {a}v0 AND NOT {a}v1) AS both_{w}_missing_frames, {_rate(f'(NOT {a}v0 AND NOT {a}v1)', f'both_{w}_missing_rate')}, count(*) FILTER ({a}v0 AND NOT {a}o0) + count(*) FILTER ({a}v1 AND NOT {a}o1) AS {w}_recovered_values" for a, w in (("p", "pose"), ("q", "position")))},
        {_rate("(s0 <> 0 OR s1 <> 0)", "shuttle_visible_rate")}, round(sum({_zeros(_J)}) / (8 * count(*)), 9) AS pose_tensor_zero_rate, round(sum({_zeros(_P)}) / (4 * count(*)), 9) AS position_tensor_zero_rate,
        CAST(sum({_OUT.format("qv0", "qv1")}) AS BIGINT) AS position_values_outside, count(*) FILTER (qv0 AND p1 > 0.5 OR qv1 AND p3 <= 0.5) AS side_inconsistent_frames, {_rate("(qv0 AND p1 > 0.5 OR qv1 AND p3 <= 0.5)", "side_inconsistent_rate")} FROM h GROUP BY clip""",
    "branch_statistics": f"""WITH {_FRAMES}, k AS (SELECT *, ({_ANY_POSE[0]}) AND ({_ANY_POSE[1]}) AS posed FROM h) SELECT clip, count(*) AS length, {_rate("posed", "both_pose_valid_rate")}, {_rate("(qo0 AND qo1)", "both_position_valid_rate")},
        round(sum({_zeros(_J)}) / (8 * count(*)), 9) AS pose_zero_rate, round(sum({_zeros(_P)}) / (4 * count(*)), 9) AS position_zero_rate, {_rate("(s0 = 0 AND s1 = 0)", "shuttle_zero_rate")}, CAST(sum({_OUT.format("qo0", "qo1")}) AS BIGINT) AS position_values_outside,
        round(sum({_OUT.format("qo0", "qo1")}) / greatest(2 * sum(CAST(qo0 AS INTEGER) + CAST(qo1 AS INTEGER)), 1), 9) AS position_outside_rate, {_rate("((NOT qo0 OR p1 <= 0.5) AND (NOT qo1 OR p3 > 0.5))", "side_consistency_rate")} FROM k GROUP BY clip""",
    "largest_regions": """WITH RECURSIVE a AS (SELECT vec_id, embedding, unnest(generate_series(0, 63)) AS i FROM embeddings), g AS (SELECT vec_id, i // 8 AS y, i % 8 AS x FROM a WHERE CAST(embedding[i + 1] AS DOUBLE) > CAST(0.05 AS DOUBLE)),
        r(vec_id, start, y, x) AS (SELECT vec_id, y * 8 + x, y, x FROM g UNION SELECT r.vec_id, r.start, g.y, g.x FROM r JOIN g ON g.vec_id = r.vec_id AND abs(g.y - r.y) <= 1 AND abs(g.x - r.x) <= 1),
        b AS (SELECT DISTINCT vec_id, x0, y0, w, h, first FROM (SELECT vec_id, start, min(x) AS x0, min(y) AS y0, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, min(y * 8 + x) AS first FROM r GROUP BY vec_id, start)),
        c AS (SELECT *, count(*) OVER (PARTITION BY vec_id) AS n FROM b QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY w * h DESC, first DESC) = 1)
        SELECT vec_id, coalesce(x0 + w // 2, 0) AS x, coalesce(y0 + h // 2, 0) AS y, coalesce(w * h, 0) AS area, coalesce(n, 0) AS n_regions FROM embeddings LEFT JOIN c USING (vec_id)""",
    "point_trails": f"""WITH {LOG}, p AS (SELECT rally, rank * 3 + event_id % 3 AS frame, value AS x, confidence * 100 AS y, token <> 'error' AS seen FROM s),
        t AS (SELECT a.rally, a.frame, count(b.frame) AS n_points, coalesce(string_agg(b.frame || ':' || CAST(round_even(b.x, 0) AS BIGINT), ' ' ORDER BY b.frame), '') AS trail FROM p a LEFT JOIN p b ON b.rally = a.rally AND b.frame BETWEEN a.frame - 20 AND a.frame AND b.seen AND b.x > 0 AND b.y > 0 GROUP BY a.rally, a.frame) SELECT * FROM t""",
    "clamped_windows": f"""WITH {LOG}, f AS (SELECT rally, rank * 7 + rank % 3 AS frame, rank FROM s), g AS (SELECT *, lag(frame) OVER w AS prev_event, lead(frame) OVER w AS next_event FROM f WINDOW w AS (PARTITION BY rally ORDER BY frame)),
        h AS (SELECT *, coalesce(CAST(round_even((prev_event + frame) / 2, 0) AS BIGINT), 5) AS window_start, coalesce(CAST(round_even((next_event + frame) / 2, 0) AS BIGINT), 1000000) AS window_end FROM g)
        SELECT rally, frame, rank AS event_rank, window_start, window_end, greatest(frame - 24, 5) AS context_start, least(frame + 24, 1000000) AS context_end, prev_event, next_event, frame - 5 AS event_local, greatest(window_start - 5, 0) AS window_start_local, greatest(window_end - 5, 0) AS window_end_local FROM h""",
    "evaluation_groups": f"""WITH {LOG}, {JUDGED}, r AS (SELECT rally % 4 AS video, CASE WHEN event_id % 7 = 0 THEN -1 ELSE {_CODES.format("token")} END AS truth, {_CODES.format("guess")} AS predicted, CASE rally % 3 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split,
            CASE WHEN event_id % 11 = 0 THEN 'shared' END AS alias, CASE WHEN event_id % 13 = 0 THEN 1.0::DOUBLE ELSE confidence END AS missing, rank % 5 / 4 AS top, rank % 9 / 8 AS bottom, event_id % 17 / 20 AS both_, value > 60 AS near FROM j),
        n AS (SELECT unnest([{", ".join(f"'{g}'" for g in _GROUPS)}]) AS grp UNION ALL SELECT DISTINCT 'exact_label_video_' || video FROM r),
        g AS ({" UNION ALL ".join(f"SELECT '{name}' AS grp, truth, predicted, near FROM r WHERE {p}" for name, p in _GROUPS.items())} UNION ALL SELECT 'exact_label_video_' || video, truth, predicted, near FROM r WHERE {_LABELLED} AND {_CLEAN}),
        a AS (SELECT grp, count(*) AS n_rows, count(*) FILTER (truth >= 0) AS labelled_rows, avg(CAST(truth = predicted AS INTEGER)) FILTER (truth >= 0) AS accuracy, avg(CAST(near AS INTEGER)) FILTER (truth >= 0) AS near FROM g GROUP BY grp),
        t AS (SELECT grp, truth AS c, count(*) AS support, count(*) FILTER (truth = predicted) AS hit FROM g WHERE truth >= 0 GROUP BY ALL), p AS (SELECT grp, predicted AS c, count(*) AS called FROM g WHERE truth >= 0 GROUP BY ALL),
        k AS (SELECT grp, coalesce(hit / called, 0) AS pr, hit / support AS re FROM t LEFT JOIN p USING (grp, c)), m AS (SELECT grp, avg(pr) AS macro_precision, avg(re) AS macro_recall, avg(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END) AS macro_f1, count(*) AS n_classes FROM k GROUP BY grp)
        SELECT grp, coalesce(n_rows, 0) AS n_rows, coalesce(labelled_rows, 0) AS labelled_rows, round(coalesce(accuracy, 0), 9) AS accuracy, round(near, 9) AS near, round(macro_precision, 9) AS macro_precision, round(macro_recall, 9) AS macro_recall, round(macro_f1, 9) AS macro_f1, coalesce(n_classes, 0) AS n_classes
        FROM n LEFT JOIN a USING (grp) LEFT JOIN m USING (grp)""",
}
