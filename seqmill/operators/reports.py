"""Reports on runs: decisions, deltas, early stopping, highlights, random baselines, p-values, cluster profiles and stability."""

from __future__ import annotations

from math import pi

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqmill import functions as fn
from seqmill.operators import measures


def decisions(rows: DataFrame, truth: str, guess: str, top: str) -> DataFrame:
    """Adds what of a "side_name" label is right: all of it, side, name, any of ``top``; null where there is no truth."""
    t, g = fn.side_and_name(F.col(truth)), fn.side_and_name(F.col(guess))
    known = lambda c: F.when(F.col(truth).isNotNull(), c)
    rows = rows.withColumn("correct", known(F.col(truth).eqNullSafe(F.col(guess)))).withColumn("side_correct", known(t["side"].eqNullSafe(g["side"])))
    return rows.withColumn("name_correct", known(t["name"].eqNullSafe(g["name"]))).withColumn("top_correct", known(F.array_contains(top, F.col(truth))))


def baseline_delta(run: DataFrame, baseline: DataFrame, names: list[str]) -> DataFrame:
    """One row from two of one row: each measure of the run less that of the baseline."""
    both = run.select(*[F.col(n).alias(f"_a{i}") for i, n in enumerate(names)]).crossJoin(baseline.select(*[F.col(n).alias(f"_b{i}") for i, n in enumerate(names)]))  # one row by one
    return both.select(*[(F.col(f"_a{i}") - F.col(f"_b{i}")).alias(f"{n}_delta") for i, n in enumerate(names)])


def early_stopping(history: DataFrame, keys: list[str], epoch: str, metric: str, patience: int) -> DataFrame:
    """Epochs up to the one that stops the run, with is_best, the best so far and the epochs without improvement."""
    w = Window.partitionBy(*keys).orderBy(epoch)
    before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    rows = history.withColumn("_n", F.row_number().over(w)).withColumn("is_best", F.coalesce(F.col(metric) > F.max(metric).over(before), F.col(metric).isNotNull()))
    rows = rows.withColumn("best", F.max(metric).over(upto)).withColumn("stale", F.col("_n") - F.coalesce(F.max(F.when(F.col("is_best"), F.col("_n"))).over(upto), F.lit(0)))
    stopped = F.coalesce(F.max((F.col("stale") >= patience).cast("int")).over(before), F.lit(0))
    return rows.withColumn("_stopped", stopped).where("_stopped = 0").drop("_n", "_stopped")


def highlights(rows: DataFrame, key: str, score: str, correct: Column, each: int = 8) -> DataFrame:
    """The surest right rows, the surest wrong ones and the least sure, without repeating a key."""
    kinds = (("sure_right", correct, F.desc(score)), ("sure_wrong", ~correct, F.desc(score)), ("unsure", F.lit(True), F.asc(score)))
    parts = [rows.where(c).orderBy(o, key).limit(each).select("*", F.lit(i).alias("_kind"), F.lit(name).alias("kind")) for i, (name, c, o) in enumerate(kinds)]
    some = parts[0].unionByName(parts[1]).unionByName(parts[2])  # at most three times ``each`` rows
    return some.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("_kind"))).where("_r = 1").drop("_r", "_kind")


def _drawn(*parts: Column) -> Column:
    """A number below 2^32 that depends on its parts alone, the same in every run and engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def random_rand(rows: DataFrame, unit: str, label: str, k: int, draws: int = 1000) -> DataFrame:
    """One row: mean and 95th percentile of the adjusted Rand index of ``label`` against random labels in ``draws`` draws.

    Units are profiles (sequences, players), so rows times draws stay small; counts combine before the shuffle.
    """
    pairs = lambda n: n * (n - 1) / 2
    drawn = rows.select(unit, label, F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    drawn = drawn.select("draw", F.col(label).alias("a"), (_drawn(F.col("draw"), F.col(unit)) % k).alias("b"))
    cells = drawn.groupBy("draw", "a", "b").agg(F.count("*").alias("n"))
    side = lambda c, name: cells.groupBy("draw", c).agg(F.sum("n").alias("n")).groupBy("draw").agg(F.sum(pairs(F.col("n"))).alias(name))
    each = cells.groupBy("draw").agg(F.sum(pairs(F.col("n"))).alias("c"), F.sum("n").alias("n")).join(side("a", "sa"), "draw").join(side("b", "sb"), "draw")
    expected = F.col("sa") * F.col("sb") / pairs(F.col("n"))
    ari = F.try_divide(F.col("c") - expected, (F.col("sa") + F.col("sb")) / 2 - expected)
    return each.select(ari.alias("ari")).agg(F.avg("ari").alias("mean_ari"), F.percentile("ari", F.lit(0.95)).alias("p95_ari"))


def random_transition_gap(table: DataFrame, states: list[str], seeds: int = 50) -> DataFrame:
    """One row: distances of a transition table to random ones on its active rows, averaged over ``seeds`` draws."""
    spark = table.sparkSession
    cells = spark.range(seeds).select(F.col("id").alias("seed")).select("seed", F.explode(F.array(*[F.lit(s) for s in states])).alias("cur")).select("seed", "cur", F.explode(F.array(*[F.lit(s) for s in states])).alias("nxt"))
    cells = cells.join(F.broadcast(table.select("cur").distinct()), "cur", "left_semi")  # states: a fixed vocabulary
    cells = cells.withColumn("u", (_drawn(F.col("seed"), F.col("cur"), F.col("nxt")) + 1) / F.lit(2.0**32))
    cells = cells.withColumn("q", F.col("u") / F.sum("u").over(Window.partitionBy("seed", "cur")))
    both = cells.join(F.broadcast(table.select("cur", "nxt", F.col("prob").alias("p"))), ["cur", "nxt"], "left").fillna(0.0, ["p"])
    p, q = F.col("p") + measures.EPS, F.col("q") + measures.EPS
    rows = both.groupBy("seed", "cur").agg(F.sum((F.col("p") - F.col("q")) ** 2).alias("sq"), F.sum(p * F.log(p / q)).alias("kl"))
    each = rows.groupBy("seed").agg(F.sqrt(F.sum("sq")).alias("frobenius"), F.avg("kl").alias("row_kl"))
    return each.agg(F.avg("frobenius").alias("frobenius"), F.avg("row_kl").alias("row_kl"))


def t_probability(t: Column, df: int) -> Column:
    """Two-sided p of Student's t with a whole number of degrees of freedom, by its finite series.

    One term for two degrees, so for units by the hundred at most; precise to about 1e-15.
    """
    angle = F.atan(F.abs(t) / df**0.5)
    c2, odd = F.cos(angle) ** 2, df % 2
    term, total = F.lit(1.0), F.lit(1.0)
    for i in range(1, (df - odd) // 2):
        a = 2 * i - 1 if not odd else 2 * i
        term = term * c2 * (a / (a + 1))
        total = total + term
    if not odd:
        inside = F.sin(angle) * total
    else:
        inside = (angle + (F.sin(angle) * F.cos(angle) * total if df > 1 else F.lit(0.0))) * (2 / pi)
    return F.greatest(F.lit(0.0), 1 - inside)


def cluster_profiles(rows: DataFrame, cluster: str, features: list[str], above: int = 5, below: int = 3) -> DataFrame:
    """Per cluster: its size, and the features furthest above and below the mean of all rows, as text."""
    mean = F.array(*[F.avg(f) for f in features])
    whole = rows.agg(mean.alias("_all"))
    names = F.array(*[F.lit(f) for f in features])
    out = rows.groupBy(cluster).agg(F.count("*").alias("n_units"), mean.alias("_own")).crossJoin(F.broadcast(whole))  # one row
    out = out.withColumn("_d", F.zip_with("_own", "_all", lambda a, b: a - b))
    low = F.array_sort(F.zip_with(names, "_d", lambda n, d: F.struct(d.alias("d"), n.alias("n"))))
    text = F.array_join(F.transform(F.slice(low, 1, below), lambda p: F.concat(p["n"], F.lit("("), F.format_string("%+.3f", p["d"]), F.lit(")"))), ", ")
    return out.select(cluster, "n_units", fn.delta_text(names, F.col("_d"), above).alias("above"), text.alias("below"))


def bootstrap_stability(rows: DataFrame, vector: str, k: int, repeats: int = 100, starts: int = 5, seed: int = 0) -> DataFrame:
    """One row: k, fits made, mean and population deviation of the adjusted Rand index of k-means refits on resamples.

    Each resample draws every row a Poisson(1) number of times, so no row leaves its executor;
    one with under ``k`` different vectors is skipped. The driver holds one number a resample.
    """
    points = rows.select(array_to_vector(vector).alias("features")).cache()

    def best(sample: DataFrame, first: int):
        fits = [KMeans(k=k, seed=first + i, featuresCol="features", predictionCol="cluster").fit(sample) for i in range(starts)]
        return min(fits, key=lambda m: m.summary.trainingCost)

    base, got = best(points, seed), []
    labelled = base.transform(points).withColumnRenamed("cluster", "base")
    for r in range(repeats):
        sample = points.sample(withReplacement=True, fraction=1.0, seed=seed + r)
        if sample.distinct().limit(k).count() < k:
            continue
        ari = measures.adjusted_rand(best(sample, seed).transform(labelled), "base", "cluster").first()["ari"]
        got.append((1.0 if ari is None else float(ari),))
    points.unpersist()
    scores = rows.sparkSession.createDataFrame(got, "ari double")
    return scores.agg(F.lit(k).alias("k"), F.count("*").alias("fits"), F.avg("ari").alias("mean_ari"), F.stddev_pop("ari").alias("std_ari"))


# The status texts below are fixed values of the reports.


def sample_status(positive: Column, negative: Column) -> Column:
    """Whether a video gave images of both kinds."""
    return F.when((positive > 0) & (negative > 0), "ok").when(positive > 0, "missing_negative_images").when(negative > 0, "missing_positive_images").otherwise("decode_or_write_failed")


def coverage_status(hits: Column, covered: Column) -> Column:
    """Verdict on how many annotated hits lie in accepted intervals."""
    some = F.when(covered == 0, "failed_zero_annotation_coverage").when(covered / F.nullif(hits, F.lit(0)) < 0.5, "needs_calibration_low_annotation_coverage").otherwise("passed_annotation_coverage_smoke")
    return F.when(hits > 0, some).otherwise("not_evaluated")


def review_status(rates: dict[str, tuple[Column, float]], clean: Column) -> Column:
    """quality_ready if every rate is within its bound and ``clean`` holds."""
    ok = clean
    for rate, most in rates.values():
        ok = ok & (rate <= most)
    return F.when(ok, "quality_ready").otherwise("completed_needs_quality_review")


def completion_status(made: Column, wanted: Column, problems: Column, quality: Column) -> Column:
    return F.when(made == 0, "blocked").when((made != wanted) | (problems > 0), "partial_with_problems").otherwise(quality)
