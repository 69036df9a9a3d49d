"""Many k-means fits at once: a round of every fit (k, start, resample) is one pass over the rows.

Rows stay on the executors; a pass gives each fit's sums by cluster, added up by Spark, and the
driver holds the centres alone (``MOST_VALUES`` numbers at once; more fits go in turns). A resample
weighs each row by a Poisson(1) number drawn by hash of seed and row id, so it repeats exactly.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Numbers in the centres of fits that run together.
MOST_VALUES = 2_000_000
#: Rows up to which the fits, not the rows, are spread over tasks.
FEW = 50_000
#: Rows for which the exact silhouette, which needs all distances, is computed.
MOST_UNITS = 20_000
_CDF = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(18)])


@dataclass(frozen=True)
class Fit:
    fit: int
    k: int
    start: int
    resample: int = -1  # -1: every row once


def _uniform(ids: np.ndarray, *seeds: int) -> np.ndarray:
    """A number in (0, 1) for each id, by a mixing hash."""
    x = ids.astype(np.int64).view(np.uint64)
    for s in seeds:
        x = x + np.uint64((s * 0x9E3779B97F4A7C15 + 0xD1342543DE82EF95) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
    return ((x >> np.uint64(11)).astype(float) + 0.5) / 2**53


def weights(ids: np.ndarray, resample: int, seed: int) -> np.ndarray:
    if resample < 0:
        return np.ones(len(ids))
    return np.searchsorted(_CDF, _uniform(ids, seed, resample, 1)).astype(float)


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :], 0)


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = _squared(x, c)
    label = d.argmin(1)
    return label, d[np.arange(len(x)), label]


def _pass(points: DataFrame, each: Callable[[np.ndarray, np.ndarray, int], list[tuple]], schema: str) -> DataFrame:
    """What ``each`` gives for (ids, vectors, lane) of every batch."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lanes = np.asarray(batch.column("lane"))
            for lane in np.unique(lanes).tolist():
                part = batch.filter(pa.array(lanes == lane))
                x = np.asarray(part.column("vector").flatten()).reshape(part.num_rows, -1)
                if out := each(np.asarray(part.column("id")), x, lane):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return points.mapInArrow(run, schema)


def _in_lanes(points: DataFrame, lanes: int) -> DataFrame:
    """Few rows once for each lane: a lane computes its share of the fits, so that these, not the rows, spread over tasks."""
    if lanes == 1:
        return points.withColumn("lane", F.lit(0))
    return points.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).repartition(lanes, "lane")


def _points(rows: DataFrame, key: str, vector: str) -> DataFrame:
    whole = F.col(vector).isNotNull() & ~F.exists(vector, lambda v: v.isNull() | F.isnan(v.cast("double")))
    return rows.where(whole).select(F.xxhash64(F.col(key).cast("string")).alias("id"), F.col(vector).cast("array<double>").alias("vector"))


def _seeded(points: DataFrame, fits: list[Fit], seed: int, lanes: int) -> dict[int, np.ndarray]:
    """k-means++: each next centre is drawn with probability in proportion to weight times squared distance.

    The draw is a race: the smallest of -ln(u) / chance over all rows wins, so one pass draws for all fits.
    """
    centres: dict[int, np.ndarray] = {}
    for j in range(max(f.k for f in fits)):
        open_ = [f for f in fits if f.k > j]

        def each(ids: np.ndarray, x: np.ndarray, lane: int, open_=open_, j=j) -> list[tuple]:
            out = []
            for f in open_[lane::lanes]:
                chance = weights(ids, f.resample, seed) * (_nearest(x, centres[f.fit])[1] if j else 1)
                with np.errstate(divide="ignore"):
                    race = np.where(chance > 0, -np.log(_uniform(ids, seed, f.start, f.k, f.resample + 2, j)) / chance, np.inf)
                i = int(race.argmin())
                out.append((f.fit, float(race[i]), int(ids[i]), x[i].tolist()))
            return out

        won = _pass(points, each, "fit int, race double, id long, vector array<double>").groupBy("fit").agg(F.min(F.struct("race", "id", "vector")).alias("won"))
        for r in won.select("fit", "won.vector").collect():  # a row for each fit
            new = np.array([r.vector])
            centres[r.fit] = np.concatenate((centres[r.fit], new)) if j else new
    return centres


def _rounds(points: DataFrame, fits: list[Fit], seed: int, most: int, lanes: int) -> dict[int, tuple[np.ndarray, float]]:
    """(centres, cost) of every fit after at most ``most`` rounds, or when no centre moves; a cluster without rows keeps its centre."""
    centres, costs, moving = _seeded(points, fits, seed, lanes), dict.fromkeys([f.fit for f in fits], math.nan), list(fits)
    for _ in range(most):
        if not moving or not centres:
            break

        def each(ids: np.ndarray, x: np.ndarray, lane: int, moving=moving) -> list[tuple]:
            out = []
            for f in moving[lane::lanes]:
                w = weights(ids, f.resample, seed)
                label, far = _nearest(x, centres[f.fit])
                member = np.zeros((f.k, len(x)))
                member[label, np.arange(len(x))] = w
                sums, n, cost = member @ x, member.sum(1), np.bincount(label, far * w, minlength=f.k)
                out += [(f.fit, c, float(n[c]), float(cost[c]), sums[c].tolist()) for c in range(f.k)]
            return out

        dim = next(iter(centres.values())).shape[1]
        sums = _pass(points, each, "fit int, cluster int, n double, cost double, sums array<double>").groupBy("fit", "cluster")
        got = sums.agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(dim)]).alias("sums")).collect()  # a row for each centre
        new = {f.fit: centres[f.fit].copy() for f in moving}
        cost = dict.fromkeys(new, 0.0)
        for r in got:
            cost[r.fit] += r.cost
            if r.n > 0:
                new[r.fit][r.cluster] = np.array(r.sums) / r.n
        costs |= cost
        moving = [f for f in moving if np.abs(new[f.fit] - centres[f.fit]).max() > 1e-9]
        centres |= new
    return {f.fit: (centres[f.fit], costs[f.fit]) for f in fits if f.fit in centres}


def fit_all(points: DataFrame, fits: list[Fit], dim: int, seed: int = 0, most: int = 100, lanes: int = 1) -> dict[int, tuple[np.ndarray, float]]:
    """Centres and cost of every fit, in turns of bounded size."""
    out, turn, held, points = {}, [], 0, _in_lanes(points, lanes).persist()
    for f in [*fits, None]:
        if turn and (f is None or held + f.k * dim > MOST_VALUES):
            out |= _rounds(points, turn, seed, most, lanes)
            turn, held = [], 0
        if f is not None:
            turn.append(f)
            held += f.k * dim
    points.unpersist()
    return out


def _best(fits: list[Fit], done: dict[int, tuple[np.ndarray, float]]) -> dict[tuple[int, int], np.ndarray]:
    """Centres of the start of least cost for each (k, resample); ties go to the first start."""
    out: dict[tuple[int, int], tuple[float, int]] = {}
    for f in fits:
        if f.fit in done:
            at, mine = (f.k, f.resample), (done[f.fit][1], f.fit)
            out[at] = min(out.get(at, mine), mine)
    return {at: done[i][0] for at, (_, i) in out.items()}


def _labels(points: DataFrame, models: dict[tuple[int, int], np.ndarray]) -> DataFrame:
    """(id, k, resample, cluster): every row under every model."""
    keys = sorted(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("vector").flatten()).reshape(batch.num_rows, -1) if batch.num_rows else None
            for k, resample in keys if batch.num_rows else []:
                label = _nearest(x, models[k, resample])[0].astype(np.int32)
                const = [pa.array(np.full(len(x), v, np.int32)) for v in (k, resample)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), *const, pa.array(label)], names=["id", "k", "resample", "cluster"])

    return points.mapInArrow(run, "id long, k int, resample int, cluster int")


def silhouettes(points: DataFrame, labels: DataFrame) -> DataFrame:
    """(k, silhouette): mean of (b - a) / max(a, b) over the rows, by Euclidean distances, for each clustering of (id, k, cluster).

    Exact, so every row meets every other: blocks of rows meet a table of at most ``MOST_UNITS``
    units, and more raise. A row alone in its cluster counts 0; one cluster gives null.
    """
    table = points.join(labels, "id").groupBy("id", "vector").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "cluster")))).alias("in"))
    units = table.limit(MOST_UNITS + 1).collect()  # bounded, checked next
    if len(units) > MOST_UNITS:
        raise ValueError(f"the exact silhouette takes at most {MOST_UNITS} units")
    if not units:
        return points.sparkSession.createDataFrame([], "k int, silhouette double")
    units.sort(key=lambda r: r.id)
    every, ids = np.array([r.vector for r in units]), np.array([r.id for r in units])
    members = {}
    for k in units[0]["in"]:
        of = np.array([r["in"][k] for r in units])
        members[k] = (of, np.eye(max(of) + 1)[of])

    def each(own: np.ndarray, x: np.ndarray, lane: int) -> list[tuple]:
        far = np.sqrt(_squared(x, every))
        at = np.searchsorted(ids, own)
        far[np.arange(len(x)), at] = 0
        out = []
        for k, (of, member) in members.items():
            n, sums, mine = member.sum(0), far @ member, of[at]
            row = np.arange(len(x))
            a = sums[row, mine] / np.maximum(n[mine] - 1, 1)
            with np.errstate(divide="ignore", invalid="ignore"):
                other = np.where(n > 0, sums / n, np.inf)
            other[row, mine] = np.inf
            b = other.min(1)
            with np.errstate(divide="ignore", invalid="ignore"):
                s = np.where((n[mine] > 1) & (np.maximum(a, b) > 0), (b - a) / np.maximum(a, b), 0.0)
            out.append((int(k), float(s.sum()) if (n > 0).sum() > 1 else math.nan, len(x)))
        return out

    sums = _pass(_in_lanes(points, 1), each, "k int, s double, n long").groupBy("k").agg((F.sum("s") / F.sum("n")).alias("silhouette"))
    return sums.select("k", F.when(~F.isnan("silhouette"), F.col("silhouette")).alias("silhouette"))


def rand_scores(labels: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """(by, ari): adjusted Rand index of two labellings for each group; 1 where both are trivial."""
    pairs = lambda n: n * (n - 1) / 2
    cells = labels.groupBy(*by, a, b).agg(F.count("*").alias("n"))
    side = lambda c: F.sum("n").over(Window.partitionBy(*by, c))  # noqa: E731  (a row for each pair of clusters)
    first = lambda c: F.row_number().over(Window.partitionBy(*by, c).orderBy(a, b)) == 1
    rows = cells.select(*by, "n", *[F.when(first(c), pairs(side(c))).alias(f"_{i}") for i, c in enumerate((a, b))])
    sums = rows.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(pairs(F.col("n"))).alias("c"), F.sum("_0").alias("x"), F.sum("_1").alias("y"))
    expected = F.col("x") * F.col("y") / pairs(F.col("n"))
    top = (F.col("x") + F.col("y")) / 2 - expected
    return sums.select(*by, F.when(top == 0, 1.0).otherwise(F.try_divide(F.col("c") - expected, top)).alias("ari"))


def sweep(rows: DataFrame, key: str, vector: str, ks: list[int], starts: int = 50, resamples: int = 100, resample_starts: int = 20, seed: int = 0) -> DataFrame:
    """Per k: silhouette, mean_ari and std_ari over resamples, fits (resamples that count), least_size, least_share.

    Each k's labels are those of the start of least cost; a resample's centres label every row, and
    the adjusted Rand index compares both. A resample with fewer rows of weight than k clusters
    doesn't count. Rows with a null in their vector go; ``key`` names the rows.
    """
    points = _points(rows, key, vector).persist()
    try:
        one = points.select(F.size("vector").alias("d")).agg(F.max("d").alias("d"), F.min("d").alias("low"), F.count("*").alias("n")).first()
        if one.n and one.d != one.low:
            raise ValueError("vectors differ in length")
        ks = [k for k in ks if k <= one.n]
        spark = rows.sparkSession
        if not ks:
            return spark.createDataFrame([], "k int, silhouette double, mean_ari double, std_ari double, fits long, least_size long, least_share double")
        plans = [(k, s, -1) for k in ks for s in range(starts)] + [(k, s, r) for k in ks for r in range(resamples) for s in range(resample_starts)]
        fits = [Fit(i, *p) for i, p in enumerate(plans)]
        models = _best(fits, fit_all(points, fits, one.d, seed, lanes=min(16, len(fits)) if one.n <= FEW else 1))
        models = {at: c for at, c in models.items() if at[1] < 0 or len(np.unique(c, axis=0)) == at[0]}
        labels = _labels(points, models).persist()
        base = labels.where("resample < 0").select("id", "k", F.col("cluster").alias("base"))
        shares = base.groupBy("k", "base").agg(F.count("*").alias("n")).groupBy("k").agg(F.min("n").alias("least_size"), F.count("*").alias("_used"))
        least = F.when(F.col("_used") == F.col("k"), F.col("least_size")).otherwise(0).cast("long")
        ari = rand_scores(labels.where("resample >= 0").join(base, ["id", "k"]), ["k", "resample"], "base", "cluster")
        ari = ari.groupBy("k").agg(F.avg("ari").alias("mean_ari"), F.stddev_pop("ari").alias("std_ari"), F.count("*").alias("fits"))
        scored = silhouettes(points, base.select("id", "k", F.col("base").alias("cluster")))
        out = shares.join(scored, "k").join(ari, "k", "left").select("k", "silhouette", "mean_ari", "std_ari", F.coalesce("fits", F.lit(0).cast("long")).alias("fits"), least.alias("least_size"), (least / F.lit(one.n)).alias("least_share"))
        return spark.createDataFrame(out.collect(), out.schema)  # a row for each k
    finally:
        points.unpersist()


def choose(results: DataFrame, least: int = 2) -> DataFrame:
    """The best k: those whose clusters all have ``least`` rows first, then by silhouette, mean_ari, least_share, and the smallest."""
    order = F.desc(F.col("least_size") >= least), F.desc_nulls_last("silhouette"), F.desc_nulls_last("mean_ari"), F.desc_nulls_last("least_share"), F.asc("k")
    return results.orderBy(*order).limit(1)
