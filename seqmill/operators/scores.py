"""Scores and agreement: micro and macro averages, binary confusion, ranks, motif and profile agreement, set overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqmill import functions as fn


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def micro_scores(rows: DataFrame, matched: str, predicted: str, truth: str, *keys: str) -> DataFrame:
    """Precision, recall and F1 from counts summed over rows; zero where there is nothing to divide by."""
    sums = rows.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for n, c in (("tp", matched), ("n_predicted", predicted), ("n_truth", truth))])
    out = sums.withColumn("precision", _ratio(F.col("tp"), F.col("n_predicted"))).withColumn("recall", _ratio(F.col("tp"), F.col("n_truth")))
    return out.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def binary_confusion(rows: DataFrame, truth: Column, guess: Column) -> DataFrame:
    """One row: tp, fp, fn, tn, accuracy, precision, recall, f1."""
    c = rows.agg(F.count_if(truth & guess).alias("tp"), F.count_if(~truth & guess).alias("fp"), F.count_if(truth & ~guess).alias("fn"), F.count_if(~truth & ~guess).alias("tn"))
    c = c.withColumn("accuracy", _ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")))
    c = c.withColumn("precision", _ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", _ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return c.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def macro_averages(report: DataFrame, n_classes: int) -> DataFrame:
    """Means of a class report over the classes that have support, and over all ``n_classes``."""
    names = ("precision", "recall", "f1")
    supported = [F.avg(F.when(F.col("support") > 0, F.col(c))).alias(f"{c}_supported") for c in names]
    return report.agg(F.count_if(F.col("support") > 0).alias("n_supported"), *supported, *[(F.sum(c) / n_classes).alias(f"{c}_all") for c in names])


def ranked(rows: DataFrame, value: str, alias: str) -> DataFrame:
    """Average ranks of a bounded table (motifs, features, units): one window over all of it."""
    w = Window.partitionBy(F.lit(0))
    tied = Window.partitionBy(value)
    return rows.withColumn(alias, F.rank().over(w.orderBy(value)) + (F.count("*").over(tied) - 1) / 2)


def spearman(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation of two columns of a bounded table; null for under two rows or no variation."""
    r = ranked(ranked(pairs, a, "_ra"), b, "_rb").agg(fn.pearson("_ra", "_rb").alias("rho"), F.count("*").alias("n"))
    return r.select("n", "rho")


def top_k(rows: DataFrame, name: str, value: str, k: int) -> DataFrame:
    """The k names of largest value, ties by name."""
    return rows.orderBy(F.desc(value), F.asc(name)).limit(k)


def set_overlap(left: DataFrame, right: DataFrame, name: str, k: int) -> DataFrame:
    """One row: Jaccard of two name sets, and their overlap by ``k`` (not by their size)."""
    a, b = (x.select(name).distinct().withColumn(f"_{i}", F.lit(1)) for i, x in enumerate((left, right)))
    both = a.join(b, name, "full").agg(F.count("*").alias("_any"), F.count_if(F.col("_0").isNotNull() & F.col("_1").isNotNull()).alias("n_shared"))
    return both.select("n_shared", _ratio(F.col("n_shared"), F.col("_any")).alias("jaccard"), (F.col("n_shared") / k).alias("overlap_at_k"))


def motif_agreement(left: DataFrame, right: DataFrame, name: str, value: str, k: int) -> DataFrame:
    """Top-k overlap of two motif tables, and the rank correlation over their union (missing: 0)."""
    union = left.select(name, F.col(value).alias("_a")).join(right.select(name, F.col(value).alias("_b")), name, "full").fillna(0, ["_a", "_b"])
    rho = spearman(union, "_a", "_b").select(F.col("n").alias("n_union"), "rho")
    return set_overlap(top_k(left, name, value, k), top_k(right, name, value, k), name, k).join(rho, F.lit(True))  # two rows of one


def unigram_baseline(pairs: DataFrame, cur: str, nxt: str) -> DataFrame:
    """Transition table in which every active state is followed by the marginal distribution of next tokens."""
    n = pairs.groupBy(nxt).agg(F.count("*").alias("_n"))
    total = n.agg(F.sum("_n").alias("_all"))
    marginal = n.join(F.broadcast(total), F.lit(True)).select(nxt, (F.col("_n") / F.col("_all")).alias("prob"))  # one row
    return pairs.select(cur).distinct().join(F.broadcast(marginal), F.lit(True))  # states by states, a fixed vocabulary


def absolute_errors(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """|left - right| cell by cell; a missing cell is zero."""
    a, b = left.select(*keys, F.col(value).alias("_a")), right.select(*keys, F.col(value).alias("_b"))
    return a.join(b, keys, "full").select(*keys, F.abs(F.coalesce("_a", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0))).alias("error"))


def fidelity(left: DataFrame, right: DataFrame, unit: str, names: list[str]) -> DataFrame:
    """Per feature, over the units that both have: Pearson correlation (null without variation) and mean absolute error."""
    long = lambda rows, v: rows.select(unit, F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias(v)) for n in names])).alias("r")).select(unit, "r.*")
    r = long(left, "_a").join(long(right, "_b"), [unit, "feature"]).groupBy("feature").agg(fn.pearson("_a", "_b").alias("pearson"), F.avg(F.abs(F.col("_a") - F.col("_b"))).alias("mae"), F.count("*").alias("n"))
    return r.select("feature", "n", "pearson", "mae")


def significance(pairs: DataFrame, r: str, n: int) -> DataFrame:
    """Adds t, Fisher's 95 % interval (low, high) and z of correlations over ``n`` units (n > 3)."""
    c = F.col(r)
    t = c * F.sqrt(F.lit(n - 2.0) / (1 - c * c))
    z, half = F.atanh(c), 1.959963984540054 / (n - 3) ** 0.5
    return pairs.withColumn("t", t).withColumn("low", F.tanh(z - half)).withColumn("high", F.tanh(z + half))


def best_candidate(rows: DataFrame, group: list[str], *order: Column) -> DataFrame:
    """The first row of each group in the given order (metric down, errors up, id up)."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where("_r = 1").drop("_r")


def strongest(rows: DataFrame, key: list[str], values: dict[str, str], k: int) -> DataFrame:
    """The column of largest value of each row (ties: the first; rows of zeros go), then the k largest of all."""
    structs = F.array(*[F.struct(F.col(c).alias("value"), F.lit(-i).alias("i"), F.lit(name).alias("state")) for i, (name, c) in enumerate(values.items())])
    rows = rows.select(*key, F.array_max(structs).alias("m")).select(*key, "m.state", "m.value").where("value > 0")
    return rows.orderBy(F.desc("value"), *key).limit(k)
