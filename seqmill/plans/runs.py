"""Registered queries of tracks and run reports, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqmill.operators import measures, reports, scores, sequences, summaries, tracking
from seqmill.plans.base import JUDGED, LOG, SPANS, STATES, judged, log, spans, table
from seqmill.plans.tables import bouts


def trajectory_coverage(spark, sf_dir):
    return tracking.trajectory_coverage(log(spark, sf_dir), ["rally"], "rank", "value", "confidence", F.col("token") != "error", 100.0, 0.9)


def frame_batches(spark, sf_dir):
    return tracking.batches(log(spark, sf_dir), "rally", "rank", 8)


def sampled_frames(spark, sf_dir):
    return tracking.sampled_frames(spans(spark, sf_dir), "rally", 12, 3, 7, skip_short=True)


def _people(spark, sf_dir):
    """Four events of a bout stand for the people of one frame: value is the place across, confidence the place along."""
    e = bouts(spark, sf_dir).withColumn("x", F.col("value") / 100).withColumn("frame", F.floor((F.col("rank") - 1) / 4))
    box = F.array(F.lit(0.0), F.lit(0.0), F.col("value"), F.col("confidence") * 100)
    points = F.array(F.array("x", "confidence"), F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(0.0), "x"))
    return tracking.court_candidates(e.withColumn("box", box).withColumn("points", points), "x", "confidence", "box", "points", 0.1, 2)


def court_filter(spark, sf_dir):
    p = _people(spark, sf_dir)
    return p.groupBy("rally").agg(F.count_if("on_court").alias("n_kept"), F.count_if(~F.col("on_court")).alias("n_rejected"), F.count_if(F.col("on_court") & F.col("pose_valid")).alias("n_posed"), F.round(F.max("area"), 6).alias("area"))


def player_tracks(spark, sf_dir):
    p = _people(spark, sf_dir)
    seen = p.withColumn("x", F.when(F.col("on_court"), F.col("x"))).withColumn("y", F.when(F.col("on_court"), F.col("confidence")))
    return tracking.two_slots(seen, ["rally"], "frame", "x", "y", "area", 0.5, 0.4, 3)


def stopped_runs(spark, sf_dir):
    return reports.early_stopping(log(spark, sf_dir).select("rally", "rank", "value"), ["rally"], "rank", "value", 6)


def label_decisions(spark, sf_dir):
    j = judged(spark, sf_dir)
    side = lambda c: F.concat(F.when(c >= 0.5, F.lit("Top_")).otherwise(F.lit("Bottom_")), F.lit(""))
    j = j.select("event_id", F.when(F.col("token") != "error", F.concat(side(F.col("confidence")), "token")).alias("truth"), F.concat(side(F.col("value") / 70), "guess").alias("guess"))
    j = j.withColumn("top", F.array(F.col("guess"), F.lit("Top_view"), F.lit("Bottom_click")))
    return reports.decisions(j, "truth", "guess", "top").groupBy("correct", "side_correct", "name_correct", "top_correct").agg(F.count("*").alias("n"))


def run_delta(spark, sf_dir):
    report = lambda rows: scores.macro_averages(measures.class_metrics(rows, "token", "guess"), 25)
    j = judged(spark, sf_dir)
    out = reports.baseline_delta(report(j), report(j.withColumn("guess", F.when(F.col("value") < 40, F.lit("view")).otherwise(F.col("guess")))), ["f1_supported", "recall_all"])
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


def sure_examples(spark, sf_dir):
    return reports.highlights(judged(spark, sf_dir).select("event_id", "token", "guess", "confidence"), "event_id", "confidence", F.col("token") == F.col("guess"))


def _favourites(spark, sf_dir):
    """The commonest state of every rally, ties by name."""
    n = log(spark, sf_dir).groupBy("rally", "token").agg(F.count("*").alias("n"))
    return n.groupBy("rally").agg(F.min_by("token", F.struct((-F.col("n")).alias("n"), F.col("token").alias("t"))).alias("label"))


_FAVOURITES = "v AS (SELECT rally, token AS label FROM (SELECT rally, token, row_number() OVER (PARTITION BY rally ORDER BY count(*) DESC, token) AS r FROM s GROUP BY rally, token) WHERE r = 1)"


def random_labels(spark, sf_dir):
    out = reports.random_rand(_favourites(spark, sf_dir), "rally", "label", 5, 200)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


def random_transitions(spark, sf_dir):
    out = reports.random_transition_gap(sequences.transitions(log(spark, sf_dir), "rally", "rank", "token", STATES), STATES, 50)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


def correlation_tests(spark, sf_dir):
    """p and q values of the correlations of state shares with mean value, over units as if there were 16."""
    c = summaries.correlations(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]).withColumn("r", F.col("r") * 0.9 + 0.05)
    c = scores.significance(c, "r", 16).withColumn("p", reports.t_probability(F.col("t"), 14))
    return measures.benjamini_hochberg(c, "p").select("a", "b", F.round("p", 7).alias("p"), F.round("q", 7).alias("q"))


def cluster_profiles(spark, sf_dir):
    f = summaries.rates(log(spark, sf_dir), ["rally"], **{s: F.col("token") == s for s in STATES}).join(_favourites(spark, sf_dir), "rally")
    return reports.cluster_profiles(f, "label", STATES, 2, 2)


def cluster_stability(spark, sf_dir):
    return reports.bootstrap_stability(table(spark, sf_dir, "embeddings").select("embedding"), "embedding", 2, 3, 1)


_ALL = (
    trajectory_coverage, frame_batches, sampled_frames, court_filter, player_tracks, stopped_runs, label_decisions, run_delta, sure_examples, random_labels, random_transitions,
    correlation_tests, cluster_profiles, cluster_stability,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

_MACRO = """(SELECT avg(CASE WHEN hit > 0 THEN 2 * (hit / called) * (hit / support) / (hit / called + hit / support) ELSE 0 END) FILTER (support > 0) AS f, sum(CASE WHEN support > 0 THEN hit / support ELSE 0 END) / 25 AS r FROM
    (SELECT label, count(*) FILTER (token = label) AS support, count(*) FILTER ({g} = label) AS called, count(*) FILTER (token = label AND {g} = label) AS hit FROM j, (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS label) GROUP BY label))"""
_CELLS = "c AS (SELECT cur, nxt, count(*) / sum(count(*)) OVER (PARTITION BY cur) AS prob FROM (SELECT token AS cur, lead(token) OVER (PARTITION BY rally ORDER BY rank) AS nxt FROM s) WHERE cur IN {i} AND nxt IN {i} GROUP BY cur, nxt)"
_PAIRED = (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_extendedprice", "l_discount"), ("l_extendedprice", "l_tax"), ("l_discount", "l_tax"))
_SEEN = f"""{LOG}, b AS (SELECT *, value / 100 AS x, confidence AS y, greatest(value * confidence * 100, 0) AS area FROM s),
    k AS (SELECT *, x BETWEEN CAST(-0.1 AS DOUBLE) AND CAST(1.1 AS DOUBLE) AND y BETWEEN CAST(-0.1 AS DOUBLE) AND CAST(1.1 AS DOUBLE) AS kept, CAST(x <> 0 OR y <> 0 AS INTEGER) + CAST(x <> 0 AS INTEGER) >= 2 AS posed FROM b)"""

ORACLE_SQL: dict[str, str] = {
    "trajectory_coverage": f"""WITH {LOG} SELECT rally, count(*) AS n_rows, count(*) FILTER (token <> 'error') AS n_visible, count(*) FILTER (token <> 'error' AND NOT (value BETWEEN 0 AND 100 AND confidence BETWEEN 0 AND CAST(0.9 AS DOUBLE))) AS n_outside,
        min(rank) AS first_frame, max(rank) AS last_frame, count(*) FILTER (token <> 'error') / count(*) AS coverage FROM s GROUP BY rally""",
    "frame_batches": f"""WITH {LOG}, c AS (SELECT rally, rank, count(*) OVER (PARTITION BY rally) AS n FROM s), g AS (SELECT rally, n, unnest(generate_series(0, (n + 7) // 8 * 8 - 1)) AS p FROM (SELECT DISTINCT rally, n FROM c))
        SELECT rally, p // 8 AS batch, p % 8 AS slot, least(p + 1, n) AS rank, p < n AS real FROM g""",
    "sampled_frames": f"""WITH {LOG}, {SPANS}, f AS (SELECT DISTINCT rally, unnest(generate_series(start, "end", 3)) AS frame FROM i WHERE "end" - start + 1 >= 3),
        r AS (SELECT *, row_number() OVER (PARTITION BY rally ORDER BY md5('7:' || rally || ':' || frame), frame) AS r FROM f) SELECT rally, frame FROM r WHERE r <= 12""",
    "court_filter": f"WITH {_SEEN} SELECT rally, count(*) FILTER (kept) AS n_kept, count(*) FILTER (NOT kept) AS n_rejected, count(*) FILTER (kept AND posed) AS n_posed, round(max(area), 6) AS area FROM k GROUP BY rally",
    "stopped_runs": f"""WITH {LOG}, a AS (SELECT rally, rank, value, coalesce(value > max(value) OVER (PARTITION BY rally ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_best, max(value) OVER (PARTITION BY rally ORDER BY rank) AS best FROM s),
        b AS (SELECT *, CAST(rank - max(CASE WHEN is_best THEN rank END) OVER (PARTITION BY rally ORDER BY rank) AS INTEGER) AS stale FROM a),
        e AS (SELECT rally, min(rank) AS last FROM b WHERE stale >= 6 GROUP BY rally) SELECT b.* FROM b LEFT JOIN e ON b.rally = e.rally WHERE last IS NULL OR rank <= last""",
    "label_decisions": f"""WITH {LOG}, {JUDGED}, d AS (SELECT token, guess, confidence >= 0.5 AS ts, value / 70 >= 0.5 AS gs FROM j),
        o AS (SELECT token <> 'error' AS known, token = guess AND ts = gs AS c, ts = gs AS sc, token = guess AS nc, (token = guess AND ts = gs) OR (ts AND token = 'view') OR (NOT ts AND token = 'click') AS tc FROM d)
        SELECT CASE WHEN known THEN c END AS correct, CASE WHEN known THEN sc END AS side_correct, CASE WHEN known THEN nc END AS name_correct, CASE WHEN known THEN tc END AS top_correct, count(*) AS n FROM o GROUP BY 1, 2, 3, 4""",
    "run_delta": f"""WITH {LOG}, {JUDGED} SELECT round(a.f - b.f, 9) AS f1_supported_delta, round(a.r - b.r, 9) AS recall_all_delta FROM {_MACRO.format(g='guess')} a, {_MACRO.format(g="CASE WHEN value < 40 THEN 'view' ELSE guess END")} b""",
    "sure_examples": f"""WITH {LOG}, {JUDGED}, e AS (SELECT event_id, token, guess, confidence, token = guess AS ok FROM j), u AS (
        (SELECT *, 0 AS k, 'sure_right' AS kind FROM e WHERE ok ORDER BY confidence DESC, event_id LIMIT 8) UNION ALL (SELECT *, 1, 'sure_wrong' FROM e WHERE NOT ok ORDER BY confidence DESC, event_id LIMIT 8)
        UNION ALL (SELECT *, 2, 'unsure' FROM e ORDER BY confidence, event_id LIMIT 8)) SELECT event_id, token, guess, confidence, kind FROM u QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY k) = 1""",
    "random_labels": f"""WITH {LOG}, {_FAVOURITES}, d AS (SELECT draw, label AS a, CAST('0x' || substr(md5(draw || ':' || rally), 1, 8) AS BIGINT) % 5 AS b FROM v, (SELECT unnest(generate_series(0, 199)) AS draw)),
        c AS (SELECT draw, a, b, count(*) AS n FROM d GROUP BY draw, a, b), x AS (SELECT draw, sum(n * (n - 1) / 2) AS c, sum(n) AS n FROM c GROUP BY draw),
        y AS (SELECT draw, sum(n * (n - 1) / 2) AS sa FROM (SELECT draw, sum(n) AS n FROM c GROUP BY draw, a) GROUP BY draw), z AS (SELECT draw, sum(n * (n - 1) / 2) AS sb FROM (SELECT draw, sum(n) AS n FROM c GROUP BY draw, b) GROUP BY draw),
        r AS (SELECT (c - sa * sb / (n * (n - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2)) AS ari FROM x JOIN y USING (draw) JOIN z USING (draw)) SELECT round(avg(ari), 6) AS mean_ari, round(quantile_cont(ari, 0.95), 6) AS p95_ari FROM r""",
    "random_transitions": f"""WITH {LOG}, {_CELLS.format(i=tuple(STATES))}, g AS (SELECT seed, a.x AS cur, b.x AS nxt, (CAST('0x' || substr(md5(seed || ':' || a.x || ':' || b.x), 1, 8) AS BIGINT) + 1) / 4294967296.0 AS u
            FROM (SELECT unnest(generate_series(0, 49)) AS seed), (SELECT unnest({STATES}) AS x) a, (SELECT unnest({STATES}) AS x) b WHERE a.x IN (SELECT cur FROM c)),
        q AS (SELECT seed, g.cur, coalesce(prob, 0) AS p, u / sum(u) OVER (PARTITION BY seed, g.cur) AS q FROM g LEFT JOIN c ON g.cur = c.cur AND g.nxt = c.nxt),
        r AS (SELECT seed, sum((p - q) * (p - q)) AS sq, sum((p + 1e-9) * ln((p + 1e-9) / (q + 1e-9))) AS kl FROM q GROUP BY seed, cur), e AS (SELECT sqrt(sum(sq)) AS f, avg(kl) AS k FROM r GROUP BY seed)
        SELECT round(avg(f), 6) AS frobenius, round(avg(k), 6) AS row_kl FROM e""",
    "correlation_tests": "WITH c AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) * 0.9 + 0.05 AS r FROM lineitem" for a, b in _PAIRED) + """), t AS (SELECT *, atan(abs(r * sqrt(14 / (1 - r * r))) / sqrt(14)) AS g FROM c),
        p AS (SELECT a, b, 1 - sin(g) * (1 + cos(g)**2 / 2 + 3 / 8 * cos(g)**4 + 5 / 16 * cos(g)**6 + 35 / 128 * cos(g)**8 + 63 / 256 * cos(g)**10 + 231 / 1024 * cos(g)**12) AS p FROM t),
        r AS (SELECT *, row_number() OVER (ORDER BY p) AS r FROM p) SELECT a, b, round(p, 7) AS p, round(least(1, min(p * 6 / r) OVER (ORDER BY r DESC)), 7) AS q FROM r""",
    "cluster_profiles": f"""WITH {LOG}, {_FAVOURITES}, f AS (SELECT rally, label, x.state, avg(CAST(token = x.state AS INTEGER)) AS share FROM s JOIN v USING (rally), (SELECT unnest({STATES}) AS state) x GROUP BY rally, label, x.state),
        d AS (SELECT label, state, avg(share) - (SELECT avg(share) FROM f g WHERE g.state = f.state) AS d, count(*) AS n FROM f GROUP BY label, state),
        r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d DESC, state) AS hi, row_number() OVER (PARTITION BY label ORDER BY d, state) AS lo, state || '(' || printf('%+.3f', d) || ')' AS t FROM d)
        SELECT label, max(n) AS n_units, string_agg(t, ', ' ORDER BY hi) FILTER (hi <= 2) AS above, string_agg(t, ', ' ORDER BY lo) FILTER (lo <= 2) AS below FROM r GROUP BY label""",
}
