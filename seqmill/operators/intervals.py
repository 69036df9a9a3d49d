"""Interval algebra: smoothing to states, runs to intervals, unions, complements, range joins."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from seqmill.operators.scans import BUCKET, ROUNDS, Fold, cut_at_gaps, scan


def smooth_states(samples: DataFrame, key: str, order: str, raw: str, length: int) -> DataFrame:
    """Two-state hysteresis over the next ``length`` samples; rows without that many are dropped."""
    w = Window.partitionBy(key).orderBy(order)
    ahead = w.rowsBetween(0, length - 1)
    on, seen = F.sum(raw).over(ahead), F.count("*").over(ahead)
    put = F.when((F.col(raw) == 1) & (2 * on >= length), 1).when((F.col(raw) == 0) & (2 * on <= length), 0)
    rows = samples.withColumn("_put", put).withColumn("_seen", seen)
    rows = rows.withColumn("state", F.coalesce(F.last("_put", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    rows = rows.where(F.col("_seen") == length)
    before = F.coalesce(F.lag("state").over(w), F.lit(0))
    return rows.withColumn("change", (F.col("state") - before).cast("int")).drop("_put", "_seen")


def state_intervals(states: DataFrame, key: str, order: str, state: str, least: int = 1) -> DataFrame:
    """Runs of state 1 as intervals; the end is the first sample after the run, if there is one."""
    w = Window.partitionBy(key).orderBy(order)
    rows = states.withColumn("_after", F.lead(order).over(w))
    opened = (F.col(state) == 1) & (F.coalesce(F.lag(state).over(w), F.lit(0)) == 0)
    rows = rows.withColumn("_run", F.sum(opened.cast("int")).over(w)).where(F.col(state) == 1)
    out = rows.groupBy(key, "_run").agg(F.min(order).alias("start"), F.max(F.coalesce("_after", order)).alias("end"), F.count("*").alias("sample_count")).drop("_run")
    return out.withColumn("accepted", F.col("sample_count") >= least)


def merge_intervals(rows: DataFrame, key: str, start: str = "start", end: str = "end", gap: int = 1) -> DataFrame:
    """Union of intervals per key; neighbours up to ``gap`` apart merge."""
    w = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = reach.isNull() | (F.col(start) > reach + gap)
    marked = rows.withColumn("_new", new.cast("int"))
    marked = marked.withColumn("_island", F.sum("_new").over(w))
    return marked.groupBy(key, "_island").agg(F.min(start).alias("start"), F.max(end).alias("end")).drop("_island")


def complement_intervals(merged: DataFrame, key: str, low: int, high: int, within: bool = True) -> DataFrame:
    """What disjoint intervals leave of [low, high], per key.

    Without ``within`` intervals outside count too: the first gap begins at ``low``, the last ends
    at ``high``, and those between two intervals stay whole wherever they lie.
    """
    if within:
        merged = merged.where((F.col("end") >= low) & (F.col("start") <= high))
    w = Window.partitionBy(key).orderBy("start")
    head = merged.groupBy(key).agg(F.min("start").alias("s")).select(key, F.lit(low).cast("long").alias("start"), (F.col("s") - 1).alias("end"))
    tail = merged.select(key, (F.col("end") + 1).alias("start"), F.coalesce(F.lead("start").over(w) - 1, F.lit(high).cast("long")).alias("end"))
    return head.unionByName(tail).where(F.col("start") <= F.col("end"))


#: Length of the stretches into which interval joins cut the axis.
WIDTH = 1_000


def on_axis(rows: DataFrame, start: str, end: str, width: int = WIDTH) -> DataFrame:
    """``rows`` once for each stretch of ``width`` that [start, end] touches, named ``_at``; none where start > end."""
    at = lambda c: F.floor(F.col(c) / width)
    return rows.where(F.col(start) <= F.col(end)).withColumn("_at", F.explode(F.sequence(at(start), at(end))))


def points_in_intervals(points: DataFrame, intervals: DataFrame, key: str, point: str, width: int = WIDTH) -> DataFrame:
    """Points with the intervals of their key that hold them (both ends inclusive).

    Both sides meet on the key and a stretch of the axis, so a hot key spreads over tasks; a point
    lies in one stretch, so every hit comes once.
    """
    met = on_axis(points, point, point, width).join(on_axis(intervals, "start", "end", width), [key, "_at"])
    return met.where(F.col(point).between(F.col("start"), F.col("end"))).drop("_at")


def _counted(rows: DataFrame) -> DataFrame:
    """Distinct rows with ``_times``, how often each stands there."""
    return rows.groupBy(*rows.columns).agg(F.count("*").cast("int").alias("_times"))


def _repeated(rows: DataFrame, *names: str) -> DataFrame:
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*names)


def overlapping(left: DataFrame, right: DataFrame, key: str, width: int = WIDTH) -> DataFrame:
    """Intervals of ``left`` that overlap one of ``right``: a semi join by key and stretch of the axis.

    A long interval may meet in several stretches; its hits are counted down to one afterwards.
    """
    a, b = on_axis(_counted(left), "start", "end", width).alias("a"), on_axis(right.select(key, "start", "end"), "start", "end", width).alias("b")
    on = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a._at") == F.col("b._at")) & (F.col("a.start") <= F.col("b.end")) & (F.col("b.start") <= F.col("a.end"))
    return _repeated(a.join(b, on, "left_semi").drop("_at").distinct(), *left.columns)


#: An array that holds a whole sequence is no place for more events than this; scans have no such bound.
MOST_EVENTS = 100_000


def bounded(array: Column, most: int = MOST_EVENTS) -> Column:
    """The array of one sequence, or an error where the key is no bounded session: for folds of a caller's own."""
    return F.when(F.size(array) <= most, array).otherwise(F.raise_error(F.lit(f"a sequence of more than {most} events: choose a finer key")))


class _Matcher(Fold):
    """Predictions in order each take the closest free truth; free neighbours are found by path halving."""

    def __init__(self, tolerance: int) -> None:
        self.tolerance, self.left, self.right = tolerance, [], []

    def add(self, row: tuple) -> tuple:
        (self.left if row[1] else self.right).append(row[0])
        return ()

    def end(self) -> Iterator[tuple]:
        truth, n = self.right, len(self.right)
        before, after = list(range(n + 1)), list(range(n + 1))  # place i stands for truth i - 1 in before, i in after

        def free(link: list[int], i: int) -> int:
            while link[i] != i:
                link[i] = link[link[i]]
                i = link[i]
            return i

        for x in self.left:
            at = bisect_right(truth, x)
            i, j = free(before, at) - 1, free(after, at)
            below, above = (x - truth[i] if i >= 0 else None), (truth[j] - x if j < n else None)
            take = i if below is not None and (above is None or below <= above) else j if above is not None else None
            if take is None or abs(truth[take] - x) > self.tolerance:
                continue
            if take == i:  # of equal truths the first goes
                take = free(after, bisect_left(truth, truth[i]))
            before[take + 1], after[take] = take, take + 1
            yield x, truth[take], abs(truth[take] - x)


def matched(left: np.ndarray, right: np.ndarray, tolerance: int) -> tuple[np.ndarray, np.ndarray]:
    """What ``greedy_match`` finds for events at sorted places on one axis: the places of left events that claim one, and their errors.

    In each round the first event of every chain claims the closest free one; events further apart
    than twice the tolerance can't want the same.
    """
    places, errors = [], []
    for _ in range(ROUNDS):
        if not len(left) or not len(right):
            break
        after = np.searchsorted(right, left, "right")
        below = np.where(after > 0, left - right[after - 1], tolerance + 1)
        above = np.where(after < len(right), right[np.minimum(after, len(right) - 1)] - left, tolerance + 1)
        error, take = np.minimum(below, above), np.where(below <= above, after - 1, after)
        near = error <= tolerance
        left, error, take = left[near], error[near], take[near]
        first = np.diff(left, prepend=left[:1] - 2 * tolerance - 1) > 2 * tolerance
        places.append(left[first])
        errors.append(error[first])
        left, right = left[~first], np.delete(right, take[first])
    if len(left) and len(right):
        rest = _Matcher(tolerance)
        rest.left, rest.right = left.tolist(), right.tolist()
        found = [(x, error) for x, _, error in rest.end()]
        places.append(np.array([x for x, _ in found], np.int64))
        errors.append(np.array([e for _, e in found], np.int64))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *places]), np.concatenate([none, *errors])


def greedy_match(left: DataFrame, right: DataFrame, key: str | list[str], frame: str, tolerance: int, width: int | None = BUCKET) -> DataFrame:
    """Left events in order each take the closest unclaimed right one within the tolerance.

    Ties go to the earlier right event; events that share a frame are claimed one by one. Events of
    either side further apart than the tolerance never meet, so a key is cut there and each
    component is matched in a scan, in time in proportion to its events. ``width`` is that of ``cut_at_gaps``.
    """
    keys = [key] if isinstance(key, str) else key
    side = lambda rows, left: rows.select(*keys, F.col(frame).cast("long").alias("frame_"), F.lit(left).alias("left_"))
    both = side(left, True).unionByName(side(right, False))
    parts = cut_at_gaps(both, keys, "frame_", tolerance + 1, width).select(*keys, "part", "frame_", "left_")
    schema = StructType([StructField(c, LongType()) for c in ("predicted", "truth", "error")])
    return scan(parts, [*keys, "part"], ["frame_"], lambda: _Matcher(tolerance), schema).drop("part")
