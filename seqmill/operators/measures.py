"""Distances of distributions, evaluation of classifiers, profiles and spatial bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-9


def distribution_gap(a: DataFrame, b: DataFrame, token: str) -> DataFrame:
    """KL both ways, chi-square and total variation of two token columns, as one row."""
    share = lambda df, name: df.groupBy(token).agg(F.count("*").alias("c")).select(token, (F.col("c") / F.sum("c").over(Window.partitionBy())).alias(name))
    both = share(a, "p").join(share(b, "q"), token, "full").fillna(0.0, ["p", "q"])
    kl = lambda x, y: F.sum((F.col(x) + EPS) * F.log((F.col(x) + EPS) / (F.col(y) + EPS)))
    d = F.col("p") - F.col("q")
    return both.agg(kl("p", "q").alias("kl"), kl("q", "p").alias("kl_reverse"), (F.sum(d * d / (F.col("p") + F.col("q") + EPS)) / 2).alias("chi2"), (F.sum(F.abs(d)) / 2).alias("tv"))


def transition_gap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Frobenius distance over all cells, and mean row KL over rows where both have mass."""
    cells = a.select("cur", "nxt", F.col("prob").alias("p")).join(b.select("cur", "nxt", F.col("prob").alias("q")), ["cur", "nxt"], "full").fillna(0.0, ["p", "q"])
    rows = cells.groupBy("cur").agg(F.sum((F.col("p") - F.col("q")) ** 2).alias("sq"), F.sum((F.col("p") + EPS) * F.log((F.col("p") + EPS) / (F.col("q") + EPS))).alias("kl"), F.sum("p").alias("mp"), F.sum("q").alias("mq"))
    return rows.agg(F.sqrt(F.sum("sq")).alias("frobenius"), F.avg(F.when((F.col("mp") > 0) & (F.col("mq") > 0), F.col("kl"))).alias("row_kl"))


def class_metrics(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support of every class, from one confusion count."""
    cells = rows.where(F.col(truth).isNotNull()).groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    sides = cells.select(F.explode(F.array(F.struct(F.col("t").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("called"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("called"), F.lit(0).cast("long").alias("hit")))).alias("x")).select("x.*")
    out = sides.where("label IS NOT NULL").groupBy("label").agg(*[F.sum(c).alias(c) for c in ("support", "called", "hit")])
    precision, recall = (F.coalesce(F.try_divide("hit", c), F.lit(0.0)) for c in ("called", "support"))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return out.select("label", "support", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def group_accuracy(rows: DataFrame, groups: dict[str, Column], correct: Column) -> DataFrame:
    """Accuracy in overlapping groups: a row counts in every group whose predicate holds."""
    tags = F.array_compact(F.array(*[F.when(p, F.lit(name)) for name, p in groups.items()]))
    return rows.select(F.explode(tags).alias("grp"), correct.cast("int").alias("ok")).groupBy("grp").agg(F.count("*").alias("n"), F.avg("ok").alias("accuracy"))


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """Inverse-frequency weights with mean 1."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    raw = F.sum("n").over(Window.partitionBy()) / F.col("n")
    counts = counts.withColumn("_raw", raw)
    return counts.select(label, "n", (F.col("_raw") / F.avg("_raw").over(Window.partitionBy())).alias("weight"))


def null_profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, nulls or blanks, and distinct values of each column, in one pass."""
    blank = lambda c: F.sum(F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), 1).otherwise(0))
    cols = [F.struct(F.lit(c).alias("name"), blank(c).alias("n_blank"), F.count_distinct(c).alias("n_distinct")) for c in columns]
    return rows.agg(F.count("*").alias("n_rows"), F.array(*cols).alias("x")).select("n_rows", F.explode("x").alias("x")).select("x.name", "n_rows", "x.n_blank", "x.n_distinct")


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def histogram2d(rows: DataFrame, x: str, y: str, x_range: tuple[float, float], y_range: tuple[float, float], bins: int) -> DataFrame:
    """Counts on a grid; points outside are dropped and the upper edge is in the last bin."""
    def bucket(c: str, lo: float, hi: float) -> Column:
        return F.least(F.floor((F.col(c) - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")

    inside = rows.where(F.col(x).between(*x_range) & F.col(y).between(*y_range))
    return inside.groupBy(bucket(x, *x_range).alias("bx"), bucket(y, *y_range).alias("by")).agg(F.count("*").alias("n"))


def ranged_histogram2d(rows: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    """Counts on a grid over the range of the data, found by an aggregate of one row; rows with a null go, a range of one value is one middle bin."""
    lo_hi = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(*[f(c).alias(f"_{i}{n}") for i, c in enumerate((x, y)) for n, f in (("lo", F.min), ("hi", F.max))])
    placed = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).join(F.broadcast(lo_hi), F.lit(True))  # one row

    def bucket(c: str, i: int) -> Column:
        lo, hi = F.col(f"_{i}lo"), F.col(f"_{i}hi")
        return F.when(hi > lo, F.least(F.floor((F.col(c) - lo) / (hi - lo) * bins), F.lit(bins - 1))).otherwise(bins // 2).cast("int")

    return placed.groupBy(bucket(x, 0).alias("bx"), bucket(y, 1).alias("by")).agg(F.count("*").alias("n"))


def benjamini_hochberg(rows: DataFrame, p: str) -> DataFrame:
    """Step-up q-values. The tests of one family are few, so one window holds them."""
    m = F.count("*").over(Window.partitionBy())
    rank = F.row_number().over(Window.partitionBy().orderBy(p))
    rows = rows.withColumn("_r", rank).withColumn("_q", F.col(p) * m / rank)
    return rows.withColumn("q", F.least(F.lit(1.0), F.min("_q").over(Window.partitionBy().orderBy(F.desc("_r"))))).drop("_r", "_q")


def adjusted_rand(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings, as one row."""
    pairs = lambda n: n * (n - 1) / 2
    cells = rows.groupBy(a, b).agg(F.count("*").alias("n"))
    both = cells.agg(F.sum(pairs(F.col("n"))).alias("c"), F.sum("n").alias("n"))
    side = lambda k, name: cells.groupBy(k).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias(name))
    out = both.crossJoin(F.broadcast(side(a, "sa"))).crossJoin(F.broadcast(side(b, "sb")))
    expected = F.col("sa") * F.col("sb") / pairs(F.col("n"))
    return out.select(F.try_divide(F.col("c") - expected, (F.col("sa") + F.col("sb")) / 2 - expected).alias("ari"))


def softmax_top(rows: DataFrame, logits: str, k: int = 3) -> DataFrame:
    """Probabilities of a logit array and the k best classes (ties: lower index)."""
    peak = F.array_max(logits)
    rows = rows.withColumn("_e", F.transform(logits, lambda x: F.exp(x - peak)))
    rows = rows.withColumn("probs", F.transform("_e", lambda x: x / F.aggregate("_e", F.lit(0.0), lambda s, y: s + y))).drop("_e")
    order = F.array_sort(F.transform("probs", lambda x, i: F.struct((-x).alias("p"), i.alias("i"))))
    return rows.withColumn("top", F.transform(F.slice(order, 1, k), lambda x: x["i"]))


def standardised(rows: DataFrame, vector: str, dims: int) -> DataFrame:
    """``vector`` with each of its ``dims`` features as a population standard score; constant features are 0."""
    x = [F.get(vector, F.lit(i)).cast("double") for i in range(dims)]
    stats = rows.agg(F.array(*[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")) for c in x])).scalar()
    score = lambda i: F.when(F.col("_stats")[i]["std"] > 1e-12, (x[i] - F.col("_stats")[i]["mean"]) / F.col("_stats")[i]["std"]).otherwise(x[i] * 0)
    return rows.withColumn("_stats", stats).withColumn(vector, F.array(*[score(i) for i in range(dims)])).drop("_stats")


def centroids(rows: DataFrame, label: str, vector: str, dims: int) -> DataFrame:
    """(label, n, centroid): the mean vector of each label, combined before the shuffle."""
    return rows.groupBy(label).agg(F.count("*").alias("n"), F.array(*[F.avg(F.get(vector, F.lit(i)).cast("double")) for i in range(dims)]).alias("centroid"))


def centroid_distance(rows: DataFrame, key: str, label: str, vector: str, dims: int) -> DataFrame:
    """(key, label, distance): Euclidean distance of each vector to the centroid of its label."""
    both = rows.select(key, label, vector).join(centroids(rows, label, vector, dims), label)
    square = F.aggregate(F.zip_with(vector, "centroid", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)
    return both.select(key, label, F.sqrt(square).alias("distance"))
