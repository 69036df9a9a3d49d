"""Registered queries of summaries, joins with accounting, scores, moments and units, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqmill import functions as fn
from seqmill.operators import clusterings, intervals, joins, measures, moments, scores, sequences, summaries, units
from seqmill.plans.base import JUDGED, LOG, SPANS, STATES, judged, log, spans, table


def bouts(spark, sf_dir):
    """The log with a user's events in bouts of ten: bounded sessions."""
    return log(spark, sf_dir).withColumn("bout", (F.floor((F.col("rank") - 1) / 10) + 1).cast("long"))


_B = f"{LOG}, b AS (SELECT *, (rank - 1) // 10 + 1 AS bout FROM s)"


def rally_summary(spark, sf_dir):
    rows = bouts(spark, sf_dir).withColumn("o", F.when(F.col("token") == "purchase", F.when(F.col("value") > 100, "won").otherwise("lost")))
    return summaries.sequence_summary(rows, ["rally", "bout"], "rank", "token", "o")


def set_summary(spark, sf_dir):
    return summaries.distinct_summary(bouts(spark, sf_dir), ["rally"], ["bout", "token"])


def match_summary(spark, sf_dir):
    rows = bouts(spark, sf_dir).withColumn("match", F.floor(F.col("rally") / 10).cast("long"))
    return summaries.match_summary(rows, "match", "rally", "bout")


def token_frequencies(spark, sf_dir):
    return summaries.most_common(log(spark, sf_dir), "token", "rally")


def group_rates(spark, sf_dir):
    return summaries.rates(log(spark, sf_dir), ["token"], sure=F.col("confidence") >= 0.8, late=F.col("rank") > 20, dear=F.col("value") > 150)


def state_profiles(spark, sf_dir):
    out = summaries.state_profile(log(spark, sf_dir), "rally", "token", STATES, "confidence")
    return out.select("rally", "n", *[F.round(c, 9).alias(c) for c in out.columns[2:]])


def token_crosstab(spark, sf_dir):
    return summaries.crosstab(judged(spark, sf_dir), "token", "guess")


def _moved(spark, sf_dir):
    w = Window.partitionBy("rally").orderBy("rank")
    return log(spark, sf_dir).withColumn("distance", F.abs(F.col("value") - F.lag("value").over(w)))


_MOVED = "m AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY rally ORDER BY rank)) AS distance FROM s)"


def movement_profiles(spark, sf_dir):
    out = summaries.movement_profile(_moved(spark, sf_dir), ["rally"], "token", "value", "distance", F.col("confidence") >= 0.5)
    return out.select("rally", "n_events", "n_displacements", *[F.round(c, 6).alias(c) for c in out.columns[3:]])


def numeric_summaries(spark, sf_dir):
    out = summaries.numeric_summary(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"])
    return out.select("name", "n", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


def weighted_discounts(spark, sf_dir):
    return summaries.weighted_mean(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_discount", "l_quantity").select("l_returnflag", F.round("mean", 6).alias("mean"))


def coverage_counts(spark, sf_dir):
    return summaries.coverage(log(spark, sf_dir), sure=F.col("confidence") >= 0.8, purchases=F.col("token") == "purchase", early=F.col("rank") <= 3)


def contract_checks(spark, sf_dir):
    return summaries.contract(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], no_quantity=F.col("l_quantity") < 1, steep=F.col("l_discount") > 0.09)


def feature_correlations(spark, sf_dir):
    got = summaries.correlations(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return got.select("a", "b", F.round("r", 6).alias("r"))


def correlation_intervals(spark, sf_dir):
    got = summaries.correlations(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return scores.significance(got, "r", 16).select("a", "b", *[F.round(c, 5).alias(c) for c in ("t", "low", "high")])


def binary_scores(spark, sf_dir):
    return scores.binary_confusion(judged(spark, sf_dir), F.col("token") == "purchase", F.col("guess") == "purchase")


def macro_scores(spark, sf_dir):
    out = scores.macro_averages(measures.class_metrics(judged(spark, sf_dir), "token", "guess"), 25)
    return out.select("n_supported", *[F.round(c, 9).alias(c) for c in out.columns[1:]])


def micro_scores(spark, sf_dir):
    hit, called, true = (F.col("token") == F.col("guess")) & (F.col("guess") == "purchase"), F.col("guess") == "purchase", F.col("token") == "purchase"
    per = judged(spark, sf_dir).groupBy("rally").agg(F.count_if(hit).alias("m"), F.count_if(called).alias("p"), F.count_if(true).alias("t"))
    return scores.micro_scores(per, "m", "p", "t")


def _sweep(spark, sf_dir):
    rows = joins.with_grid(judged(spark, sf_dir), least=[0.2, 0.5, 0.8], most=[0.9, 1.0])
    called = F.col("confidence").between(F.col("least"), F.col("most"))
    rows = rows.select("least", "most", (called & (F.col("token") == F.col("guess"))).cast("int").alias("m"), called.cast("int").alias("p"), F.lit(1).alias("t"))
    return scores.micro_scores(rows, "m", "p", "t", "least", "most")


def parameter_sweep(spark, sf_dir):
    return _sweep(spark, sf_dir)


def best_parameters(spark, sf_dir):
    return scores.best_candidate(_sweep(spark, sf_dir).withColumn("all", F.lit(1)), ["all"], F.desc("f1"), F.asc("least"), F.asc("most")).drop("all")


def join_accounting(spark, sf_dir):
    big = table(spark, sf_dir, "lineitem").where("l_quantity >= 45").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return joins.accounting(joins.left_marked(table(spark, sf_dir, "orders"), big, ["o_orderkey"]))


def three_way_lineage(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderpriority")
    urgent = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), "c_nationkey")
    nations = table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    rows = joins.left_marked(joins.left_marked(orders, urgent, ["k"], "in_credit"), F.broadcast(nations), ["c_nationkey"], "in_region")  # nations are 25 rows by definition
    return rows.groupBy("o_orderpriority", "in_credit", "in_region").agg(F.count("*").alias("n"))


def long_bouts(spark, sf_dir):
    rows = bouts(spark, sf_dir)
    good = rally_summary(spark, sf_dir).where("n_events >= 5").select("rally", "bout", "n_events")
    return rows.join(good, ["rally", "bout"]).groupBy("token").agg(F.count("*").alias("n"), F.sum("n_events").alias("total"))


def default_ids(spark, sf_dir):
    last = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").cast("string").alias("clip"))
    return joins.with_default(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), last, ["c_custkey"], "clip", F.concat_ws("_", "c_custkey", "c_nationkey"))


def problem_rows(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return joins.split_problems(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), urgent, ["c_custkey"], "no urgent order")[1]


def disagreeing_keys(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_nationkey")
    return joins.disagreeing(a, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), "s_nationkey"), ["k"], "c_nationkey", "s_nationkey")


def _points(spark, sf_dir):
    return log(spark, sf_dir).select("rally", "event_id", (F.col("rank") * 2 + 1).alias("frame"))


def claimed_points(spark, sf_dir):
    s = spans(spark, sf_dir)
    return joins.claimed(_points(spark, sf_dir), s.withColumn("place", F.col("end") * 1000 + F.col("start")), "rally", "frame", "place").select("rally", "event_id", "start", "end")


def unclaimed_points(spark, sf_dir):
    return joins.unclaimed(_points(spark, sf_dir), spans(spark, sf_dir), "rally", "frame")


def holding_spans(spark, sf_dir):
    return joins.holding(spans(spark, sf_dir), log(spark, sf_dir).where("token <> 'view'").select("rally", (F.col("rank") * 2 + 1).alias("frame")), "rally", "frame")


def ordinal_pairs(spark, sf_dir):
    b = bouts(spark, sf_dir)
    left, right = b.select("rally", "bout", "rank", "token"), b.select("rally", "bout", (-F.col("rank")).alias("back"), F.col("token").alias("other"))
    return joins.ordinal_join(left, right, ["rally", "bout"], "rank", "back").groupBy("token", "other").agg(F.count("*").alias("n"))


def reference_errors(spark, sf_dir):
    """Lengths of context windows against those of midpoint windows; an error only where both are there."""
    e = log(spark, sf_dir).select("rally", (F.col("rank") * 7 + F.col("rank") % 3).alias("frame"))
    mine = moments.context_windows(e, "rally", "frame", 30.0).select("rally", "frame", (F.col("window_end") - F.col("window_start") + 1).alias("length"))
    other = e.where("frame % 2 = 0").select("rally", "frame", F.lit(20).cast("long").alias("reference_length"))
    return joins.left_marked(mine, other, ["rally", "frame"]).select("rally", "frame", "length", "matched", F.when(F.col("matched"), F.abs(F.col("length") - F.col("reference_length"))).alias("error"))


def raw_ngrams(spark, sf_dir):
    return moments.ngram_counts(sequences.token_lists(log(spark, sf_dir), "rally", "rank", "token"), 2)


def context_windows(spark, sf_dir):
    return moments.context_windows(log(spark, sf_dir).select("rally", (F.col("rank") * 7 + F.col("rank") % 3).alias("frame")), "rally", "frame", 30.0)


def serve_moments(spark, sf_dir):
    return moments.serves(log(spark, sf_dir), "rally", "rank", "value", 50.0).select("rally", "rank", F.round("score", 6).alias("score"))


def gap_recovery(spark, sf_dir):
    e = log(spark, sf_dir).select("rally", "rank", F.when(F.col("confidence") >= 0.6, F.col("value")).alias("v"))
    return moments.recovered_gaps(e, "rally", "rank", "v", 2, 4).select("rally", "rank", "observed", "valid", F.round("recovered", 6).alias("recovered"))


def _activity(spark, sf_dir):
    e = bouts(spark, sf_dir).where("token != 'view'").withColumn("frame", F.col("rank") * 3)
    return moments.activity(e, "rally", "bout", "frame", 1, 200)


def activity_spans(spark, sf_dir):
    return _activity(spark, sf_dir)


def rest_spans(spark, sf_dir):
    return moments.rest(_activity(spark, sf_dir), log(spark, sf_dir), "rally", 1, 200)


def strongest_states(spark, sf_dir):
    profile = summaries.state_profile(log(spark, sf_dir), "rally", "token", STATES, "confidence")
    return scores.strongest(profile, ["rally"], {s: f"p_{s}" for s in STATES}, 20).select("rally", "state", F.round("value", 9).alias("value"))


def dearest_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


def structured_order(spark, sf_dir):
    """Place of every event in the chronological order of its bout."""
    w = Window.partitionBy("rally", "bout").orderBy("rank")
    return bouts(spark, sf_dir).select("rally", "bout", "event_id", F.row_number().over(w).alias("place"))


def vocabulary(spark, sf_dir):
    j = judged(spark, sf_dir)
    return j.select("token").union(j.select("guess")).distinct()


def _motifs(spark, sf_dir, odd):
    return sequences.ngram_support(sequences.token_lists(log(spark, sf_dir).where(f"rally % 2 = {odd}"), "rally", "rank", "token"), 2).select("pattern", "support")


def motif_agreement(spark, sf_dir):
    out = scores.motif_agreement(_motifs(spark, sf_dir, 0), _motifs(spark, sf_dir, 1), "pattern", "support", 10)
    return out.select("n_shared", F.round("jaccard", 9).alias("jaccard"), F.round("overlap_at_k", 9).alias("overlap_at_k"), "n_union", F.round("rho", 6).alias("rho"))


def rank_correlation(spark, sf_dir):
    per = log(spark, sf_dir).groupBy("token", F.col("rank").alias("r")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("v")).where("r <= 20")
    return scores.spearman(per, "n", "v").select("n", F.round("rho", 6).alias("rho"))


def _pairs(spark, sf_dir):
    w = Window.partitionBy("rally").orderBy("rank")
    return log(spark, sf_dir).select(F.col("token").alias("cur"), F.lead("token").over(w).alias("nxt")).where("nxt IS NOT NULL")


_PAIRS = "p AS (SELECT * FROM (SELECT token AS cur, lead(token) OVER (PARTITION BY rally ORDER BY rank) AS nxt FROM s) WHERE nxt IS NOT NULL)"


def unigram_baseline(spark, sf_dir):
    return scores.unigram_baseline(_pairs(spark, sf_dir), "cur", "nxt")


def baseline_errors(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    own = summaries.crosstab(p, "cur", "nxt").withColumnRenamed("share", "prob")
    return scores.absolute_errors(own, scores.unigram_baseline(p, "cur", "nxt"), ["cur", "nxt"], "prob").select("cur", "nxt", F.round("error", 9).alias("error"))


def feature_fidelity(spark, sf_dir):
    j = judged(spark, sf_dir)
    side = lambda c: summaries.rates(j.withColumn("t", F.col(c)), ["rally"], **{s: F.col("t") == s for s in STATES})
    out = scores.fidelity(side("token"), side("guess"), "rally", STATES)
    return out.select("feature", "n", F.round("pearson", 6).alias("pearson"), F.round("mae", 9).alias("mae"))


def split_counts(spark, sf_dir):
    split = fn.split_of(F.col("rally"), "ignored", train="0-40,60", val="41-59", test="61-80")
    return log(spark, sf_dir).groupBy(split.alias("split")).agg(F.count("*").alias("n"), F.count_distinct("rally").alias("rallies"))


def split_overlap(spark, sf_dir):
    """Users that two of three time splits share."""
    e = log(spark, sf_dir).withColumn("split", F.when(F.col("rank") <= 5, "train").when(F.col("rank") <= 8, "val").otherwise("test"))
    d = e.select("split", "rally").distinct()
    other = d.select(F.col("split").alias("other"), "rally")
    return d.join(other, "rally").where("split < other").groupBy("split", "other").agg(F.count("*").alias("n_shared"))


def common_units(spark, sf_dir):
    """Units that two labelled tables share, in their order."""
    a = log(spark, sf_dir).where("confidence >= 0.9").select("rally").distinct()
    return a.intersect(log(spark, sf_dir).where("token = 'signup'").select("rally"))


def tier_counts(spark, sf_dir):
    e = log(spark, sf_dir).withColumn("rate", F.when(F.col("rank") % 7 == 0, F.lit(1.0)).otherwise(F.col("confidence")))
    return e.groupBy(fn.dropout_tier(F.col("rate"), F.col("token") != "error").alias("tier")).agg(F.count("*").alias("n"))


def scalar_rules(spark, sf_dir):
    """Complement mean, provenance, transition names, ratio text and the court test on every event."""
    c = F.col("confidence")
    blank = F.when(c >= 0.3, c)
    kept = fn.first_source(manifest=F.when(c >= 0.7, F.col("rank")), truth=F.when(c >= 0.4, F.col("rank") + 100), midpoint=F.lit(0).cast("long"))
    return log(spark, sf_dir).select(
        "event_id", F.round(fn.complement_mean(blank, F.lit(0.5), F.lit(-1.0)), 6).alias("visible"), kept["value"].alias("frame"), kept["source"].alias("frame_source"),
        fn.transition_name(F.when(c >= 0.1, F.col("rank") % 4)).alias("transition"), fn.ratio_text(c, 3).alias("ratio"), fn.inside_court(F.array(c, F.col("value") / 200)).alias("on_court"),
        fn.side_and_name(F.concat("token", F.lit("_x"), F.col("rank").cast("string")))["name"].alias("stroke"), fn.translated(F.col("token"), {"click": "clear", "view": "drop"}).alias("word"),
    )


def interval_reasons(spark, sf_dir):
    e = log(spark, sf_dir).select("rally", "rank", (F.col("confidence") >= 0.5).cast("int").alias("raw"))
    runs = intervals.state_intervals(intervals.smooth_states(e, "rally", "rank", "raw", 4), "rally", "rank", "state")
    return runs.groupBy(fn.length_verdict(F.col("end") - F.col("start"), 2, 6).alias("reason")).agg(F.count("*").alias("n"))


def rotated_positions(spark, sf_dir):
    e = log(spark, sf_dir).select("event_id", units.centred(F.col("confidence"), F.col("value") / 200, F.col("token") == "view").alias("p"))
    return e.where("p IS NOT NULL").select("event_id", F.round("p.lateral", 6).alias("lateral"), F.round("p.forward", 6).alias("forward"))


def supported_rallies(spark, sf_dir):
    return units.supported_units(_moved(spark, sf_dir), ["rally"], "distance", 12).groupBy("rally").agg(F.count("*").alias("n"))


def active_features(spark, sf_dir):
    return units.active_features(table(spark, sf_dir, "lineitem").withColumn("still", F.lit(1.0)), ["l_quantity", "l_tax", "still"]).select("name", F.round("spread", 6).alias("spread"), "active")


def cluster_sweep(spark, sf_dir):
    return units.kmeans_sweep(table(spark, sf_dir, "embeddings").select("embedding"), "embedding", [2, 3, 4], starts=2)


def _nation_units(spark, sf_dir):
    """(nation, region, profile): what a nation's customers order; 25 units at any size of the tables."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice", (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("urgent"))
    own = orders.join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), "c_custkey").groupBy("c_nationkey")
    profile = F.array(F.avg("o_totalprice") / 10000, F.avg("urgent") * 10, F.avg("c_acctbal") / 1000, F.stddev_pop("o_totalprice") / 10000)
    nations = F.broadcast(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey"))  # 25 rows by definition
    return own.agg(profile.alias("profile")).join(nations, "c_nationkey").select(F.col("c_nationkey").alias("nation"), F.col("n_regionkey").alias("region"), "profile")


def cluster_search(spark, sf_dir):
    """k from 2 to 8 with 50 starts, and 100 resamples of 20 starts each."""
    out = clusterings.sweep(_nation_units(spark, sf_dir), "nation", "profile", [2, 3, 4, 5, 6, 7, 8])
    return out.withColumns({c: F.round(c, 6) for c in ("silhouette", "mean_ari", "std_ari")})


def best_clustering(spark, sf_dir):
    return clusterings.choose(cluster_search(spark, sf_dir))


def label_silhouette(spark, sf_dir):
    """How well regions part the profiles of their nations."""
    u = _nation_units(spark, sf_dir).select(F.col("nation").cast("long").alias("id"), F.col("profile").alias("vector"), F.col("region").cast("int").alias("cluster"))
    return clusterings.silhouettes(u.select("id", "vector"), u.select("id", F.lit(0).alias("k"), "cluster")).select(F.round("silhouette", 6).alias("silhouette"))


def chosen_clusters(spark, sf_dir):
    return units.clusters(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", 3).groupBy("cluster").agg(F.count("*").alias("n"))


def principal_axes(spark, sf_dir):
    rows = units.principal_components(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", 2)
    return rows.select("vec_id", *[F.round(F.abs(F.get("components", F.lit(i))), 6).alias(f"pc{i + 1}") for i in range(2)])


def natural_join(spark, sf_dir):
    """Inner join on all shared columns."""
    e = bouts(spark, sf_dir)
    a, b = e.select("rally", "bout", "rank", "token"), e.where("token = 'purchase'").select("rally", "bout").distinct()
    return a.join(b, [c for c in a.columns if c in b.columns]).groupBy("token").agg(F.count("*").alias("n"))


_ALL = (
    rally_summary, set_summary, match_summary, token_frequencies, group_rates, state_profiles, token_crosstab, movement_profiles, numeric_summaries, weighted_discounts, coverage_counts,
    contract_checks, feature_correlations, correlation_intervals, binary_scores, macro_scores, micro_scores, parameter_sweep, best_parameters, join_accounting, three_way_lineage, long_bouts,
    default_ids, problem_rows, disagreeing_keys, claimed_points, unclaimed_points, holding_spans, ordinal_pairs, reference_errors, raw_ngrams, context_windows, serve_moments, gap_recovery,
    activity_spans, rest_spans, strongest_states, dearest_orders, structured_order, vocabulary, motif_agreement, rank_correlation, unigram_baseline, baseline_errors, feature_fidelity,
    split_counts, split_overlap, common_units, tier_counts, scalar_rules, interval_reasons, rotated_positions, supported_rallies, active_features, cluster_sweep, cluster_search, best_clustering, label_silhouette, chosen_clusters, principal_axes, natural_join,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

_FRAMES = f"""{LOG}, f AS (SELECT rally, rank * 7 + rank % 3 AS frame FROM s), g AS (SELECT *, lag(frame) OVER w AS prev_event, lead(frame) OVER w AS next_event FROM f WINDOW w AS (PARTITION BY rally ORDER BY frame)),
    x AS (SELECT *, greatest(coalesce(prev_event, frame - 15), frame - 45, 0) AS window_start, least(coalesce(next_event + 7, frame + 15), frame + 52) AS e FROM g)"""
_POINTS = "t AS (SELECT rally, event_id, rank * 2 + 1 AS frame FROM s)"
_REPORT = f"""{LOG}, {JUDGED}, l AS (SELECT DISTINCT token AS label FROM j UNION SELECT DISTINCT guess FROM j),
    c AS (SELECT label, (SELECT count(*) FROM j WHERE token = label) AS support, (SELECT count(*) FROM j WHERE guess = label) AS called, (SELECT count(*) FROM j WHERE token = label AND guess = label) AS hit FROM l),
    k AS (SELECT label, support, CASE WHEN called > 0 THEN hit / called ELSE 0 END AS p, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS r, CASE WHEN hit > 0 THEN 2 * (hit / called) * (hit / support) / (hit / called + hit / support) ELSE 0 END AS f FROM c)"""
_SWEEP = f"""{LOG}, {JUDGED}, g AS (SELECT least, most FROM (SELECT unnest([0.2, 0.5, 0.8]::DOUBLE[]) AS least), (SELECT unnest([0.9, 1.0]::DOUBLE[]) AS most)),
    c AS (SELECT least, most, count(*) FILTER (confidence BETWEEN least AND most AND token = guess) AS tp, count(*) FILTER (confidence BETWEEN least AND most) AS n_predicted, count(*) AS n_truth FROM j, g GROUP BY least, most),
    d AS (SELECT *, CASE WHEN n_predicted > 0 THEN tp / n_predicted ELSE 0 END AS precision, CASE WHEN n_truth > 0 THEN tp / n_truth ELSE 0 END AS recall FROM c),
    z AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM d)"""
_ACTIVE = f"""{_B}, i AS (SELECT rally, CAST(greatest(0, min(rank * 3) - 1) AS BIGINT) AS start, CAST(least(199, max(rank * 3) + 1) AS BIGINT) AS "end" FROM b WHERE token <> 'view' GROUP BY rally, bout),
    o AS (SELECT *, max("end") OVER (PARTITION BY rally ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i WHERE start <= "end"),
    n AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY rally ORDER BY start, "end") AS g FROM o),
    m AS (SELECT rally, min(start) AS start, max("end") AS "end" FROM n GROUP BY rally, g)"""
_CORR = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _corr(names, what):
    return " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {what.format(r=f'corr({a}, {b})')} FROM lineitem" for i, a in enumerate(names) for b in names[i + 1 :])


def _ranked(src, *cols):
    each = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS r_{c}" for c in cols)
    return f"(SELECT *, {each} FROM {src})"


def _motif_sql(odd):
    return f"""(SELECT pattern, count(DISTINCT rally) / CAST((SELECT count(DISTINCT rally) FROM s WHERE rally % 2 = {odd}) AS DOUBLE) AS support FROM
        (SELECT rally, token || ' > ' || lead(token) OVER (PARTITION BY rally ORDER BY rank) AS pattern FROM s WHERE rally % 2 = {odd}) WHERE pattern IS NOT NULL GROUP BY pattern)"""


ORACLE_SQL: dict[str, str] = {
    "label_silhouette": """WITH u AS (SELECT c_nationkey AS id, any_value(n_regionkey) AS c, [avg(o_totalprice) / 10000, avg(CAST(o_orderpriority = '1-URGENT' AS INTEGER)) * 10, avg(c_acctbal) / 1000, stddev_pop(o_totalprice) / 10000] AS v
            FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY c_nationkey),
        d AS (SELECT a.id, a.c AS own, b.c AS c, avg(list_distance(a.v, b.v)) AS m FROM u a JOIN u b ON a.id <> b.id GROUP BY a.id, a.c, b.c),
        s AS (SELECT id, max(m) FILTER (c = own) AS a, min(m) FILTER (c <> own) AS b FROM d GROUP BY id) SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM s""",
    "rally_summary": f"""WITH {_B}, o AS (SELECT *, CASE WHEN token = 'purchase' THEN CASE WHEN value > 100 THEN 'won' ELSE 'lost' END END AS o FROM b)
        SELECT rally, bout, count(*) AS n_events, arg_min(token, rank) AS first_token, arg_max(token, rank) AS last_token, arg_max(o, rank) FILTER (o IS NOT NULL) AS outcome FROM o GROUP BY rally, bout""",
    "set_summary": f"WITH {_B} SELECT rally, count(*) AS n_rows, count(DISTINCT bout) AS n_bout, count(DISTINCT token) AS n_token FROM b GROUP BY rally",
    "match_summary": f"WITH {_B} SELECT rally // 10 AS match, count(DISTINCT (rally, bout)) AS n_sequences, array_to_string(list_sort(list(DISTINCT rally)), ',') AS groups FROM b GROUP BY 1",
    "token_frequencies": "SELECT user_id AS rally, event_type AS token, count(*) AS n FROM events GROUP BY 1, 2",
    "group_rates": f"WITH {LOG} SELECT token, count(*) AS n, avg(CAST(confidence >= 0.8 AS INTEGER)) AS sure, avg(CAST(rank > 20 AS INTEGER)) AS late, avg(CAST(value > 150 AS INTEGER)) AS dear FROM s GROUP BY token",
    "state_profiles": f"WITH {LOG} SELECT rally, count(token) AS n, round(avg(confidence), 9) AS mean_weight, " + ", ".join(f"round(avg(CAST(token = '{x}' AS INTEGER)), 9) AS p_{x}" for x in STATES) + " FROM s GROUP BY rally",
    "token_crosstab": f"WITH {LOG}, {JUDGED} SELECT token, guess, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY token) AS share FROM j GROUP BY token, guess",
    "movement_profiles": f"""WITH {LOG}, {_MOVED} SELECT rally, count(*) AS n_events, count(distance) AS n_displacements, round(avg(value), 6) AS mean_x, round(stddev_pop(value), 6) AS std_x, round(avg(distance), 6) AS mean_distance, round(stddev_pop(distance), 6) AS std_distance,
        round(count(*) FILTER (token = 'purchase' AND distance IS NOT NULL) / nullif(count(distance), 0), 6) AS moved_rate, round(count(*) FILTER (token = 'click' AND confidence >= 0.5) / nullif(count(*) FILTER (confidence >= 0.5), 0), 6) AS sure_rate,
        round(avg(CAST(token = 'view' AS INTEGER)), 6) AS view_rate FROM m GROUP BY rally""",
    "numeric_summaries": " UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) AS n, round(avg({c}), 6) AS mean, round(median(CAST({c} AS DOUBLE)), 6) AS median, round(CAST(min({c}) AS DOUBLE), 6) AS least, round(CAST(max({c}) AS DOUBLE), 6) AS greatest, round(avg(abs({c})), 6) AS mae, round(avg(CAST({c} = 0 AS INTEGER)), 6) AS exact_rate FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")),
    "weighted_discounts": "SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS mean FROM lineitem GROUP BY l_returnflag",
    "coverage_counts": f"WITH {LOG} " + " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) FILTER ({w}) AS n, count(*) FILTER ({w}) / count(*) AS share FROM s" for n, w in (("sure", "confidence >= 0.8"), ("purchases", "token = 'purchase'"), ("early", "rank <= 3"))),
    "contract_checks": """SELECT 'duplicate_keys' AS "check", CAST(count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS BIGINT) AS n FROM lineitem UNION ALL SELECT 'no_quantity', count(*) FILTER (l_quantity < 1) FROM lineitem
        UNION ALL SELECT 'steep', count(*) FILTER (l_discount > CAST(0.09 AS DOUBLE)) FROM lineitem""",
    "feature_correlations": _corr(_CORR, "round({r}, 6) AS r"),
    "correlation_intervals": f"WITH c AS ({_corr(_CORR[:3], '{r} AS r')}) SELECT a, b, round(r * sqrt(14.0 / (1 - r * r)), 5) AS t, round((exp(2 * (atanh(r) - 1.959963984540054 / sqrt(13.0))) - 1) / (exp(2 * (atanh(r) - 1.959963984540054 / sqrt(13.0))) + 1), 5) AS low, round((exp(2 * (atanh(r) + 1.959963984540054 / sqrt(13.0))) - 1) / (exp(2 * (atanh(r) + 1.959963984540054 / sqrt(13.0))) + 1), 5) AS high FROM c",
    "binary_scores": f"""WITH {LOG}, {JUDGED}, c AS (SELECT count(*) FILTER (token = 'purchase' AND guess = 'purchase') AS tp, count(*) FILTER (token <> 'purchase' AND guess = 'purchase') AS fp, count(*) FILTER (token = 'purchase' AND guess <> 'purchase') AS fn, count(*) FILTER (token <> 'purchase' AND guess <> 'purchase') AS tn FROM j)
        SELECT *, (tp + tn) / (tp + fp + fn + tn) AS accuracy, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) AS f1 FROM c""",
    "macro_scores": f"WITH {_REPORT} SELECT count(*) FILTER (support > 0) AS n_supported, " + ", ".join(f"round(avg({a}) FILTER (support > 0), 9) AS {n}_supported, round(sum({a}) / 25, 9) AS {n}_all" for n, a in (("precision", "p"), ("recall", "r"), ("f1", "f"))) + " FROM k",
    "micro_scores": f"""WITH {LOG}, {JUDGED}, c AS (SELECT count(*) FILTER (token = guess AND guess = 'purchase') AS tp, count(*) FILTER (guess = 'purchase') AS n_predicted, count(*) FILTER (token = 'purchase') AS n_truth FROM j)
        SELECT *, tp / n_predicted AS precision, tp / n_truth AS recall, 2 * (tp / n_predicted) * (tp / n_truth) / (tp / n_predicted + tp / n_truth) AS f1 FROM c""",
    "parameter_sweep": f"WITH {_SWEEP} SELECT * FROM z",
    "best_parameters": f"WITH {_SWEEP} SELECT * FROM z ORDER BY f1 DESC, least, most LIMIT 1",
    "join_accounting": "SELECT count(*) FILTER (m) AS n_matched, count(*) FILTER (NOT m) AS n_unmatched, avg(CAST(m AS INTEGER)) AS match_rate FROM (SELECT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 45) AS m FROM orders)",
    "three_way_lineage": """SELECT o_orderpriority, c_custkey IS NOT NULL AS in_credit, n_nationkey IS NOT NULL AS in_region, count(*) AS n FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey
        LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey GROUP BY 1, 2, 3""",
    "long_bouts": f"WITH {_B}, n AS (SELECT *, count(*) OVER (PARTITION BY rally, bout) AS n_events FROM b) SELECT token, count(*) AS n, CAST(sum(n_events) AS BIGINT) AS total FROM n WHERE n_events >= 5 GROUP BY token",
    "default_ids": """SELECT c_custkey, c_nationkey, coalesce(CAST(o AS VARCHAR), c_custkey || '_' || c_nationkey) AS clip, CASE WHEN o IS NULL THEN 'synthesised' ELSE 'joined' END AS source FROM customer
        LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS o FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey) ON o_custkey = c_custkey""",
    "problem_rows": "SELECT c_custkey, c_name, 'no urgent order' AS reason FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "disagreeing_keys": "SELECT c_custkey AS k, c_nationkey, s_nationkey FROM customer JOIN supplier ON c_custkey = s_suppkey WHERE c_nationkey IS DISTINCT FROM s_nationkey",
    "claimed_points": f"""WITH {LOG}, {SPANS}, {_POINTS} SELECT t.rally, event_id, arg_min(i.start, i."end" * 1000 + i.start) AS start, arg_min(i."end", i."end" * 1000 + i.start) AS "end" FROM t JOIN i ON t.rally = i.rally AND frame BETWEEN i.start AND i."end" GROUP BY t.rally, event_id""",
    "unclaimed_points": f'WITH {LOG}, {SPANS}, {_POINTS} SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.rally = t.rally AND t.frame BETWEEN i.start AND i."end")',
    "holding_spans": f"""WITH {LOG}, {SPANS}, {_POINTS} SELECT * FROM i WHERE EXISTS (SELECT 1 FROM t JOIN s USING (event_id) WHERE token <> 'view' AND i.rally = t.rally AND t.frame BETWEEN i.start AND i."end")""",
    "ordinal_pairs": f"""WITH {_B}, n AS (SELECT *, row_number() OVER (PARTITION BY rally, bout ORDER BY rank) AS a, row_number() OVER (PARTITION BY rally, bout ORDER BY rank DESC) AS z FROM b)
        SELECT x.token, y.token AS other, count(*) AS n FROM n x JOIN n y ON x.rally = y.rally AND x.bout = y.bout AND x.a = y.z GROUP BY 1, 2""",
    "reference_errors": f"WITH {_FRAMES}, l AS (SELECT rally, frame, greatest(e - 1, window_start) - window_start + 1 AS length FROM x) SELECT rally, frame, length, frame % 2 = 0 AS matched, CASE WHEN frame % 2 = 0 THEN abs(length - 20) END AS error FROM l",
    "raw_ngrams": f"WITH {LOG} SELECT pattern, count(*) AS n FROM (SELECT token || ' > ' || lead(token) OVER (PARTITION BY rally ORDER BY rank) AS pattern FROM s) WHERE pattern IS NOT NULL GROUP BY pattern",
    "context_windows": f"WITH {_FRAMES} SELECT rally, frame, prev_event, next_event, window_start, greatest(e - 1, window_start) AS window_end FROM x",
    "serve_moments": f"WITH {LOG}, d AS (SELECT rally, rank, value - lead(value) OVER (PARTITION BY rally ORDER BY rank) AS score FROM s) SELECT rally, min(rank) AS rank, round(arg_min(score, rank), 6) AS score FROM d WHERE score >= 50 GROUP BY rally",
    "gap_recovery": f"""WITH {LOG}, v AS (SELECT rally, rank, CASE WHEN confidence >= 0.6 THEN value END AS v, CASE WHEN confidence >= 0.6 THEN rank END AS k, max(rank) OVER (PARTITION BY rally) AS high FROM s),
        n AS (SELECT *, last_value(k IGNORE NULLS) OVER a AS pf, last_value(v IGNORE NULLS) OVER a AS pv, first_value(k IGNORE NULLS) OVER z AS nf, first_value(v IGNORE NULLS) OVER z AS nv FROM v
            WINDOW a AS (PARTITION BY rally ORDER BY rank ROWS UNBOUNDED PRECEDING), z AS (PARTITION BY rally ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
        g AS (SELECT *, coalesce(nf, high + 1) - coalesce(pf, 0) - 1 AS gap FROM n),
        r AS (SELECT rally, rank, v IS NOT NULL AS observed, CASE WHEN v IS NOT NULL THEN v WHEN gap <= 2 AND pf IS NOT NULL THEN pv WHEN gap <= 4 AND pf IS NOT NULL AND nf IS NOT NULL THEN (1 - (rank - pf) / (gap + 1)) * pv + (rank - pf) / (gap + 1) * nv END AS x FROM g)
        SELECT rally, rank, observed, x IS NOT NULL AS valid, round(x, 6) AS recovered FROM r""",
    "activity_spans": f"WITH {_ACTIVE} SELECT * FROM m",
    "rest_spans": f"""WITH {_ACTIVE}, q AS (SELECT rally, greatest(0, start - 1) AS a, least(199, "end" + 1) AS z FROM m), frames AS (SELECT rally, f FROM (SELECT DISTINCT rally FROM s), (SELECT unnest(generate_series(0, 199)) AS f)),
        free AS (SELECT rally, f FROM frames WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.rally = frames.rally AND f BETWEEN a AND z)), u AS (SELECT *, f - row_number() OVER (PARTITION BY rally ORDER BY f) AS g FROM free)
        SELECT rally, CAST(min(f) AS BIGINT) AS start, CAST(max(f) AS BIGINT) AS "end" FROM u GROUP BY rally, g""",
    "strongest_states": f"""WITH {LOG}, n AS (SELECT rally, count(*) AS n FROM s GROUP BY rally), c AS (SELECT rally, token, count(*) / any_value(n) AS p FROM s JOIN n USING (rally) WHERE token IN {tuple(STATES)} GROUP BY rally, token),
        r AS (SELECT *, row_number() OVER (PARTITION BY rally ORDER BY p DESC, token) AS r FROM c) SELECT rally, token AS state, round(p, 9) AS value FROM r WHERE r = 1 ORDER BY p DESC, rally LIMIT 20""",
    "dearest_orders": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "structured_order": f"WITH {_B} SELECT rally, bout, event_id, row_number() OVER (PARTITION BY rally, bout ORDER BY rank) AS place FROM b",
    "vocabulary": f"WITH {LOG}, {JUDGED} SELECT token FROM j UNION SELECT guess FROM j",
    "motif_agreement": f"""WITH {LOG}, a AS {_motif_sql(0)}, b AS {_motif_sql(1)}, ta AS (SELECT pattern FROM a ORDER BY support DESC, pattern LIMIT 10), tb AS (SELECT pattern FROM b ORDER BY support DESC, pattern LIMIT 10),
        o AS (SELECT count(*) AS n_shared FROM ta JOIN tb USING (pattern)), n AS (SELECT count(*) AS n FROM (SELECT pattern FROM ta UNION SELECT pattern FROM tb)),
        u AS (SELECT coalesce(a.support, 0) AS x, coalesce(b.support, 0) AS y FROM a FULL JOIN b USING (pattern)), c AS (SELECT corr(r_x, r_y) AS rho, count(*) AS n_union FROM {_ranked('u', 'x', 'y')})
        SELECT n_shared, round(n_shared / n, 9) AS jaccard, round(n_shared / 10, 9) AS overlap_at_k, n_union, round(rho, 6) AS rho FROM o, n, c""",
    "rank_correlation": f"WITH {LOG}, t AS (SELECT token, rank AS k, count(*) AS n, round(sum(value), 2) AS v FROM s WHERE rank <= 20 GROUP BY token, rank) SELECT count(*) AS n, round(corr(r_n, r_v), 6) AS rho FROM {_ranked('t', 'n', 'v')}",
    "unigram_baseline": f"WITH {LOG}, {_PAIRS} SELECT a.cur, b.nxt, b.prob FROM (SELECT DISTINCT cur FROM p) a, (SELECT nxt, count(*) / sum(count(*)) OVER () AS prob FROM p GROUP BY nxt) b",
    "baseline_errors": f"""WITH {LOG}, {_PAIRS}, o AS (SELECT cur, nxt, count(*) / sum(count(*)) OVER (PARTITION BY cur) AS prob FROM p GROUP BY cur, nxt), u AS (SELECT a.cur, b.nxt, b.prob FROM (SELECT DISTINCT cur FROM p) a, (SELECT nxt, count(*) / sum(count(*)) OVER () AS prob FROM p GROUP BY nxt) b)
        SELECT cur, nxt, round(abs(coalesce(o.prob, 0) - coalesce(u.prob, 0)), 9) AS error FROM o FULL JOIN u USING (cur, nxt)""",
    "feature_fidelity": f"WITH {LOG}, {JUDGED}, " + "r AS (" + " UNION ALL ".join(f"SELECT '{x}' AS feature, rally, avg(CAST(token = '{x}' AS INTEGER)) AS a, avg(CAST(guess = '{x}' AS INTEGER)) AS b FROM j GROUP BY rally" for x in STATES) + ") SELECT feature, count(*) AS n, round(corr(a, b), 6) AS pearson, round(avg(abs(a - b)), 9) AS mae FROM r GROUP BY feature",
    "split_counts": """SELECT CASE WHEN user_id BETWEEN 0 AND 40 OR user_id = 60 THEN 'train' WHEN user_id BETWEEN 41 AND 59 THEN 'val' WHEN user_id BETWEEN 61 AND 80 THEN 'test' ELSE 'ignored' END AS split, count(*) AS n, count(DISTINCT user_id) AS rallies FROM events GROUP BY 1""",
    "split_overlap": f"WITH {LOG}, d AS (SELECT DISTINCT CASE WHEN rank <= 5 THEN 'train' WHEN rank <= 8 THEN 'val' ELSE 'test' END AS split, rally FROM s) SELECT a.split, b.split AS other, count(*) AS n_shared FROM d a JOIN d b USING (rally) WHERE a.split < b.split GROUP BY 1, 2",
    "common_units": f"WITH {LOG} SELECT rally FROM s WHERE confidence >= 0.9 INTERSECT SELECT rally FROM s WHERE token = 'signup'",
    "tier_counts": f"""WITH {LOG}, r AS (SELECT token, CASE WHEN rank % 7 = 0 THEN 1.0 ELSE confidence END AS r FROM s) SELECT CASE WHEN token <> 'error' THEN 'exact_label_' ELSE 'candidate_only_' END ||
        CASE WHEN r = 1 THEN 'all_pose_missing' WHEN r >= 0.5 THEN 'pose_dropout_ge_50' WHEN r >= 0.25 THEN 'pose_dropout_25_50' ELSE 'pose_dropout_lt_25' END AS tier, count(*) AS n FROM r GROUP BY 1""",
    "scalar_rules": f"""WITH {LOG} SELECT event_id, round(CASE WHEN confidence >= 0.3 THEN 1 - (confidence + 0.5) / 2 ELSE -1 END, 6) AS visible, CASE WHEN confidence >= 0.7 THEN rank WHEN confidence >= 0.4 THEN rank + 100 ELSE 0 END AS frame,
        CASE WHEN confidence >= 0.7 THEN 'manifest' WHEN confidence >= 0.4 THEN 'truth' ELSE 'midpoint' END AS frame_source,
        CASE WHEN confidence < 0.1 THEN 'queued' ELSE ['inactive_to_inactive', 'inactive_to_active', 'active_to_active', 'active_to_inactive'][rank % 4 + 1] END AS transition, printf('%.3f', confidence) AS ratio,
        (confidence <> 0 OR value <> 0) AND confidence BETWEEN -0.2 AND 1.2 AND value / 200 BETWEEN CAST(-0.2 AS DOUBLE) AND CAST(1.2 AS DOUBLE) AS on_court, 'x' || rank AS stroke,
        CASE token WHEN 'click' THEN 'clear' WHEN 'view' THEN 'drop' ELSE token END AS word FROM s""",
    "rotated_positions": f"""WITH {LOG}, c AS (SELECT event_id, CASE WHEN token = 'view' THEN 1 - confidence ELSE confidence END AS x, CASE WHEN token = 'view' THEN 2 * (value / 200) ELSE 2 * (1 - value / 200) END AS y FROM s)
        SELECT event_id, round(x, 6) AS lateral, round(y, 6) AS forward FROM c WHERE x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1""",
    "supported_rallies": f"WITH {LOG}, {_MOVED} SELECT rally, count(*) AS n FROM m GROUP BY rally HAVING count(distance) >= 12",
    "active_features": "SELECT 'l_quantity' AS name, round(CAST(max(l_quantity) - min(l_quantity) AS DOUBLE), 6) AS spread, max(l_quantity) - min(l_quantity) > 1e-12 AS active FROM lineitem UNION ALL SELECT 'l_tax', round(CAST(max(l_tax) - min(l_tax) AS DOUBLE), 6), max(l_tax) - min(l_tax) > 1e-12 FROM lineitem UNION ALL SELECT 'still', 0, false",
    "natural_join": f"WITH {_B} SELECT token, count(*) AS n FROM b WHERE (rally, bout) IN (SELECT (rally, bout) FROM b WHERE token = 'purchase') GROUP BY token",
}
