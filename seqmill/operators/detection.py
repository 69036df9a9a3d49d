"""Event detectors over a grid of parameters, and the search for the best parameters.

Windows over a trajectory measure what every detector looks at; each candidate of a grid is then a
row of thresholds. Whole trajectories, many at a time, are settled for all candidates in arrays, so
no point is shuffled once per candidate; candidates that share a detector's parameters share its
suppressed events. A key is one trajectory (a rally): bounded, as a task holds it in memory.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from seqmill.operators.intervals import matched
from seqmill.operators.scans import begins, blocks, one_axis
from seqmill.operators.scores import _f1, _ratio, best_candidate
from seqmill.operators.trajectory import suppressed


@dataclass(frozen=True)
class Candidate:
    candidate: int
    distance: int
    prominence: float
    radius: int
    angle: float
    step: float
    slope: float


def grid(distance: list[int], prominence: list[float], radius: list[int], angle: list[float], step: list[float], slope: list[float]) -> list[Candidate]:
    """All combinations, numbered from 1 in the order of the arguments."""
    combos = list(product(distance, prominence, radius, angle, step, slope))
    if not combos:
        raise ValueError("the grid is empty")
    return [Candidate(i, *c) for i, c in enumerate(combos, 1)]


def _table(spark: SparkSession, candidates: list[Candidate]) -> DataFrame:
    return spark.createDataFrame([tuple(asdict(c).values()) for c in candidates], "candidate int, distance int, prominence double, radius int, angle double, step double, slope double")


def measured(points: DataFrame, keys: list[str], frame: str, x: str, y: str, radii: list[int], *more: str) -> DataFrame:
    """(keys, more, frame, rise, prominence_<radius>, cosine, least_step, longest_gap): all points, laid out by keys.

    Points without a frame or a place, or with a coordinate of 0 or less, are not in view and measure
    nothing. ``rise`` is the speed up to the next point (y points down), prominences are those of
    peaks, over points not frames, ``cosine`` is that of the turn.
    """
    rows = points.select(*keys, *more, F.col(frame).cast("long").alias("frame"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).repartition(*keys)
    seen = (F.col("_x") > 0) & (F.col("_y") > 0) & F.col("frame").isNotNull()
    rows = rows.select(*keys, *more, "frame", *[F.when(seen, F.col(c)).alias(n) for c, n in (("frame", "_at"), ("_x", "_x"), ("_y", "_y"))])
    w = Window.partitionBy(*keys).orderBy("_at", "_x", "_y")  # points out of view come first, as nulls
    before, after = ({c: f(c).over(w) for c in ("_at", "_x", "_y")} for f in (F.lag, F.lead))
    gap_in, gap_out = F.col("_at") - before["_at"], after["_at"] - F.col("_at")
    length = lambda dx, dy: F.sqrt(dx * dx + dy * dy)  # noqa: E731  # hypot rounds otherwise
    step_in, step_out = length(F.col("_x") - before["_x"], F.col("_y") - before["_y"]), length(after["_x"] - F.col("_x"), after["_y"] - F.col("_y"))
    dot = (F.col("_x") - before["_x"]) * (after["_x"] - F.col("_x")) + (F.col("_y") - before["_y"]) * (after["_y"] - F.col("_y"))
    size = step_in * step_out
    cosine = F.when(size == 0, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot / size)))
    lowest = lambda a, b: F.coalesce(F.min("_y").over(w.rowsBetween(a, b)), F.col("_y"))
    is_peak = (F.col("_y") >= before["_y"]) & (F.col("_y") >= after["_y"])
    return rows.select(
        *keys, *more, "frame", ((F.col("_y") - after["_y"]) / F.greatest(gap_out, F.lit(1))).alias("rise"),
        *[F.when(is_peak, F.col("_y") - F.least(lowest(-r, -1), lowest(1, r))).alias(f"prominence_{r}") for r in sorted(set(radii))],
        F.when(size.isNotNull(), cosine).alias("cosine"), F.when(size.isNotNull(), F.least(step_in, step_out)).alias("least_step"), F.greatest(gap_in, gap_out).alias("longest_gap"),
    )


REASONS = ("serve_drop", "y_peak", "trajectory_kink")  # in the order of ties


def _reaching(values: pa.ChunkedArray, least: float) -> np.ndarray:
    """As in SQL: NaN reaches everything, null nothing."""
    return pc.fill_null(pc.invert(pc.less(values, least)), False).to_numpy()


def _ranks(rows: np.ndarray, scores: np.ndarray, ties: np.ndarray | int) -> np.ndarray:
    """0 for the highest score; equal scores go by tie, then by row."""
    out = np.empty(len(rows), np.int64)
    out[np.lexsort((rows, np.broadcast_to(ties, len(rows)), np.where(np.isnan(scores), -np.inf, -scores)))] = np.arange(len(rows))
    return out


def _turns(cosines: pa.ChunkedArray) -> np.ndarray:
    """Degrees by the C library's arc cosine, as SQL engines take it. That of the JVM may differ in the last bit, which orders turns by equal angles."""
    out, at = np.zeros(len(cosines)), np.flatnonzero(cosines.is_valid().to_numpy())
    out[at] = np.degrees(np.fromiter(map(math.acos, cosines.drop_null().to_pylist()), float, len(at)))
    return out


def _serves(table: pa.Table, at: np.ndarray, starts: np.ndarray, slope: float) -> tuple[np.ndarray, np.ndarray]:
    """Each key's first row, and its score, that rises by ``slope``; of one frame's rows the least rise."""
    rise, rows = table.column("rise").to_numpy(), np.flatnonzero(_reaching(table.column("rise"), slope))
    rows = rows[np.lexsort((rise[rows], at[rows]))]
    rows = rows[np.diff(np.searchsorted(starts, rows, "right"), prepend=0) > 0]
    return rows, rise[rows]


def _found(table: pa.Table, at: np.ndarray, starts: np.ndarray, candidates: list[Candidate]) -> Iterator[tuple[Candidate, np.ndarray, np.ndarray, np.ndarray]]:
    """Each candidate with its events in order: rows, scores and ties (places in ``REASONS``).

    What stays of the scores above a threshold doesn't depend on those below, so candidates that
    differ in a threshold share the suppression of its lowest value.
    """
    turns, steps = _turns(table.column("cosine")), table.column("least_step")
    for distance in sorted({c.distance for c in candidates}):
        own, pool = [c for c in candidates if c.distance == distance], {}
        near = pc.fill_null(pc.less_equal(table.column("longest_gap"), distance), False).to_numpy()
        for slope in {c.slope for c in own}:
            pool[0, slope] = _serves(table, at, starts, slope)
        for radius in {c.radius for c in own}:
            heights = table.column(f"prominence_{radius}")
            rows = np.flatnonzero(_reaching(heights, min(c.prominence for c in own if c.radius == radius)))
            pool[1, radius] = rows, heights.to_numpy()[rows]
        for step in {c.step for c in own}:
            rows = np.flatnonzero(near & _reaching(steps, step) & ~(turns < min(c.angle for c in own if c.step == step)))
            pool[2, step] = rows, turns[rows]
        for (tie, setting), (rows, scores) in pool.items():
            if tie:
                kept = suppressed(at[rows], _ranks(rows, scores, tie), distance)
                pool[tie, setting] = rows[kept], scores[kept]
        kinds = {k: i for i, k in enumerate(pool)}
        rows, scores = (np.concatenate(parts) for parts in zip(*pool.values(), strict=True))
        kind = np.repeat(np.arange(len(pool)), [len(rows) for rows, _ in pool.values()])
        order = np.argsort(rows, kind="stable")
        rows, scores, kind = rows[order], scores[order], kind[order]
        ties = np.array([tie for tie, _ in pool])[kind]
        ranks, places = _ranks(rows, scores, ties), at[rows]
        for c in own:
            serve, peak, kink = (kind == kinds[k] for k in ((0, c.slope), (1, c.radius), (2, c.step)))
            some = np.flatnonzero(serve | (peak & ~(scores < c.prominence)) | (kink & ~(scores < c.angle)))
            some = some[suppressed(places[some], ranks[some], distance)]
            yield c, rows[some], scores[some], ties[some]


def detect(points: DataFrame, keys: list[str], frame: str, x: str, y: str, candidates: list[Candidate]) -> DataFrame:
    """(keys, candidate, frame, score, reason): serve_drop, y_peak and trajectory_kink events of every candidate.

    Peaks and kinks are suppressed each for themselves and then, with the serve, together; equal
    scores go to the serve, then the peak, then the earlier frame. A key with no event has no row.
    """
    rows = measured(points, keys, frame, x, y, [c.radius for c in candidates]).where("frame IS NOT NULL")
    far = max(c.distance for c in candidates)
    schema = StructType([*(rows.schema[k] for k in keys), *(StructField(*f) for f in (("candidate", IntegerType()), ("frame", LongType()), ("score", DoubleType()), ("reason", StringType())))])

    def run(table: pa.Table, starts: np.ndarray) -> pa.Table:
        at = one_axis(table.column("frame").to_numpy(), starts, far)
        events = [(np.full(len(rows), c.candidate), rows, scores, ties) for c, rows, scores, ties in _found(table, at, starts, candidates)]
        ids, rows, scores, ties = map(np.concatenate, zip(*events, strict=True))
        out = table.select([*keys, "frame"]).take(rows)
        return pa.table([*(out.column(k) for k in keys), pa.array(ids), out.column("frame"), pa.array(scores), pa.array(REASONS).take(pa.array(ties))], schema.names)

    return blocks(rows, keys, ["frame"], run, schema)


COUNTS = ("rally_count", "predicted_events", "ground_truth_hits", "matched_ground_truth", "error")


def search(points: DataFrame, truths: DataFrame | Column, keys: list[str], frame: str, x: str, y: str, candidates: list[Candidate], tolerance: int, split: str | None = None) -> DataFrame:
    """One row for each candidate (and value of the key ``split``): counts, precision, recall, f1, mean_abs_error and the parameters.

    Keys are those of ``points``, whatever their events; truths of other keys don't count. ``truths``
    has the keys and the frame, or is a condition that marks points as true events. A candidate that
    finds nothing has zeros and no mean error. Points and truths of a key are settled together, once
    for all candidates, and counted before they leave their task.
    """
    by = [split] if split else []
    keys = [*by, *(k for k in keys if k != split)]
    marked = lambda rows, point, hit, place: rows.select(*keys, F.col(frame).cast("long").alias("_frame"), *(c.cast("double").alias(n) for c, n in zip(place, ("_px", "_py"), strict=True)), F.lit(point).alias("_point"), hit.alias("_hit"))
    place, none = (F.col(x), F.col(y)), (F.lit(None), F.lit(None))
    if isinstance(truths, Column):
        rows = marked(points, True, F.coalesce(truths, F.lit(False)), place)
    else:
        rows = marked(points, True, F.lit(False), place).unionByName(marked(truths.dropna(subset=keys), False, F.lit(True), none))
    rows = measured(rows, keys, "_frame", "_px", "_py", [c.radius for c in candidates], "_point", "_hit")
    rows = rows.withColumns({"_placed": F.col("frame").isNotNull(), "frame": F.coalesce("frame", F.lit(0))})
    far = max(2 * tolerance + 1, *(c.distance for c in candidates))
    schema = StructType([*(rows.schema[k] for k in by), StructField("candidate", IntegerType()), *(StructField(n, LongType()) for n in COUNTS)])

    def run(table: pa.Table, starts: np.ndarray) -> pa.Table:
        at = one_axis(table.column("frame").to_numpy(), starts, far)
        point, hit, placed = (table.column(n).to_numpy() for n in ("_point", "_hit", "_placed"))
        unit = np.logical_or.reduceat(point, starts)
        parts = begins(table, by)
        counted = lambda places: np.diff(np.searchsorted(places, np.append(parts, len(at))))  # noqa: E731  # rows in each part
        real = np.flatnonzero(hit & np.repeat(unit, np.diff(starts, append=len(at))))
        units, truth_count, true_at = counted(starts[unit]), counted(real), at[real[placed[real]]]
        out = []
        for c, rows, _, _ in _found(table, at, starts, candidates):
            places, errors = matched(at[rows], true_at, tolerance)
            part = np.searchsorted(at[parts], places, "right") - 1
            sums = (np.bincount(part, weights, len(parts)).astype(np.int64) for weights in (None, errors))
            out.append((np.full(len(parts), c.candidate), units, counted(rows), truth_count, *sums))
        columns = map(np.concatenate, zip(*out, strict=True))
        return pa.table([*(table.column(k).take(np.tile(parts, len(out))) for k in by), *map(pa.array, columns)], schema.names)

    out = blocks(rows, keys, ["frame"], run, schema).groupBy("candidate", *by).agg(*[F.sum(n).alias(n) for n in COUNTS]).where("rally_count > 0")
    p, t, m = F.col("predicted_events"), F.col("ground_truth_hits"), F.col("matched_ground_truth")
    out = out.select(
        "candidate", *by, "rally_count", p, t, m, (t - m).alias("missed_ground_truth"), (p - m).alias("extra_predictions"), _ratio(m, p).alias("precision"), _ratio(m, t).alias("recall"),
        F.when(m > 0, F.col("error") / m).alias("mean_abs_error"),
    )
    out = out.withColumn("f1", _f1(F.col("precision"), F.col("recall")))
    return out.join(F.broadcast(_table(points.sparkSession, candidates)), "candidate")  # the caller's grid


def best(results: DataFrame, metric: str = "f1", by: list[str] | None = None) -> DataFrame:
    """The best candidate: highest metric, then smallest mean error (none counts as the largest), fewest extras, smallest id."""
    order = F.desc(metric), F.asc_nulls_last("mean_abs_error"), F.asc("extra_predictions"), F.asc("candidate")
    if by:
        return best_candidate(results, by, *order)
    return best_candidate(results.withColumn("_all", F.lit(0)), ["_all"], *order).drop("_all")  # a row for each candidate
