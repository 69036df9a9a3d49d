"""Trajectories: peaks, kinks, bounded interpolation, jump gates and suppression."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from seqmill.operators.scans import BUCKET, ROUNDS, Fold, cut_at_gaps, scan


def peaks(points: DataFrame, key: str, order: str, value: str, radius: int, prominence: float) -> DataFrame:
    """Local maxima (plateaus pass) whose prominence within ``radius`` points is large enough."""
    w = Window.partitionBy(key).orderBy(order)
    left = F.coalesce(F.min(value).over(w.rowsBetween(-radius, -1)), F.col(value))
    right = F.coalesce(F.min(value).over(w.rowsBetween(1, radius)), F.col(value))
    rows = points.withColumn("prominence", F.col(value) - F.least(left, right))
    rows = rows.withColumn("_p", F.lag(value).over(w)).withColumn("_n", F.lead(value).over(w))
    return rows.where((F.col(value) >= F.col("_p")) & (F.col(value) >= F.col("_n")) & (F.col("prominence") >= prominence)).drop("_p", "_n")


def turning_angles(points: DataFrame, key: str, order: str, x: str, y: str) -> DataFrame:
    """Angle in degrees between the steps into and out of each point; a step of no length turns by 0."""
    w = Window.partitionBy(key).orderBy(order)
    rows = points.select(key, order, *[(F.col(c) - F.lag(c).over(w)).alias(f"_{c}1") for c in (x, y)], *[(F.lead(c).over(w) - F.col(c)).alias(f"_{c}2") for c in (x, y)])
    size = F.hypot(f"_{x}1", f"_{y}1") * F.hypot(f"_{x}2", f"_{y}2")
    cosine = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (F.col(f"_{x}1") * F.col(f"_{x}2") + F.col(f"_{y}1") * F.col(f"_{y}2")) / size))
    return rows.where(size.isNotNull()).select(key, order, F.when(size == 0, 0.0).otherwise(F.degrees(F.acos(cosine))).alias("angle"))


def interpolate(points: DataFrame, key: str, frame: str, value: str, most: int) -> DataFrame:
    """Fill gaps of at most ``most`` missing frames linearly between their known neighbours."""
    w = Window.partitionBy(key).orderBy(frame)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), F.col(frame))
    a, b = F.last(at, True).over(back), F.first(at, True).over(ahead)
    u, v = F.last(value, True).over(back), F.first(value, True).over(ahead)
    filled = F.when((b - a - 1 <= most) & (b > a), u + (v - u) * (F.col(frame) - a) / (b - a))
    return points.withColumn("filled", F.coalesce(F.col(value), filled))


class _Gate(Fold):
    """Carries the last point kept: (frame, x, y)."""

    def __init__(self, speed: float, frame_size: tuple[float, float] | None = None, marks: bool = False) -> None:
        self.speed, self.size, self.marks, self.last = speed, frame_size, marks, None

    def add(self, row: tuple) -> tuple:
        frame, x, y = row
        why = None if x is not None and y is not None else "missing"
        if why is None and self.size and not (0 <= x <= self.size[0] and 0 <= y <= self.size[1]):
            why = "out_of_frame"
        if why is None and self.last is not None:
            gap = frame - self.last[0]
            gap = max(gap, 1) if self.marks else gap
            far = math.sqrt((x - self.last[1]) ** 2 + (y - self.last[2]) ** 2)
            if (far / gap > self.speed) if self.marks else (far > self.speed * gap):
                why = "jump"
        if why is None:
            self.last = (frame, x, y)
        if self.marks:
            return ((frame, None if why else x, None if why else y, why is None, why),)
        return () if why else ((frame, x, y),)


def _gated(points: DataFrame, key: str | list[str], frame: str, x: str, y: str, fold, more: tuple[StructField, ...] = ()) -> DataFrame:
    keys = [key] if isinstance(key, str) else key
    rows = points.select(*keys, frame, F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y))
    return scan(rows, keys, [frame, x, y], fold, StructType([rows.schema[frame], rows.schema[x], rows.schema[y], *more]))


def jump_gate(points: DataFrame, key: str | list[str], frame: str, x: str, y: str, speed: float) -> DataFrame:
    """Drop points that move faster than ``speed`` per frame from the last one kept.

    What is kept depends on what was kept before: a scan that carries the last point, however long the key.
    """
    return _gated(points.where(F.col(x).isNotNull() & F.col(y).isNotNull()), key, frame, x, y, lambda: _Gate(speed))


def denoised(points: DataFrame, key: str | list[str], frame: str, x: str, y: str, speed: float, width: float, height: float) -> DataFrame:
    """Every point with ``visible`` and the ``reason`` it lost its place for: missing, out_of_frame or jump.

    A point outside the picture is not seen and is no measure for the next ones; a seen point must
    not be further than ``speed`` a frame (one frame at least) from the last one that stayed.
    """
    more = StructField("visible", BooleanType()), StructField("reason", StringType())
    return _gated(points, key, frame, x, y, lambda: _Gate(speed, (width, height), True), more)


class _Suppressor(Fold):
    """Candidates of one component; memory holds this component alone."""

    def __init__(self, distance: int | None) -> None:
        self.distance, self.rows = distance, []

    def add(self, row: tuple) -> tuple:
        self.rows.append(row)
        return ()

    def end(self) -> Iterator[tuple]:
        kept: list = []
        for row in sorted(self.rows, key=lambda r: (-r[1], r[2], r[0])):
            distance, frame = self.distance if self.distance is not None else row[3], row[0]
            at = bisect_left(kept, frame)
            if (at == len(kept) or kept[at] - frame >= distance) and (at == 0 or frame - kept[at - 1] >= distance):
                kept.insert(at, frame)
                yield frame, row[1], *row[4:]


def suppressed(at: np.ndarray, rank: np.ndarray, distance: int) -> np.ndarray:
    """What ``suppress`` keeps of events at sorted places on one axis, as a mask; the smallest of the distinct ranks goes first.

    In each round the first event of every component stays and those too close to it go.
    """
    kept, left = np.zeros(len(at), bool), np.arange(len(at))
    for _ in range(ROUNDS):
        if not len(left):
            return kept
        a, r = at[left], rank[left]
        opens = np.flatnonzero(np.diff(a, prepend=a[0] - distance) >= distance)
        sizes = np.diff(opens, append=len(a))
        first = r == np.repeat(np.minimum.reduceat(r, opens), sizes)
        kept[left[first]] = True
        left = left[(np.abs(a - np.repeat(a[first], sizes)) >= distance) & ~first]
    rest = _Suppressor(distance)
    for i, a, r in zip(left.tolist(), at[left].tolist(), rank[left].tolist(), strict=True):
        rest.add((a, -r, 0, None, i))
    kept[[row[2] for row in rest.end()]] = True
    return kept


def suppress(candidates: DataFrame, key: str | list[str], frame: str, score: str, distance: int | str, tie: str | None = None, keep: tuple[str, ...] = (), width: int | None = BUCKET) -> DataFrame:
    """Greedy suppression: highest score first, kept if ``distance`` frames from all kept ones.

    ``distance`` is a number or the name of a key. Ties go by ``tie``, then to the earlier frame;
    candidates without a score go. ``keep`` names further columns to give back. A key is cut where
    neighbours lie ``distance`` or more apart, and each component is settled in a scan. ``width``
    is that of ``cut_at_gaps``.
    """
    keys = [key] if isinstance(key, str) else key
    rows = candidates.where(F.col(score).isNotNull()).select(*keys, *dict.fromkeys([frame, score, *keep]), (F.col(tie) if tie else F.lit(0)).alias("tie_"))
    own = F.lit(None).cast("int") if isinstance(distance, int) else F.col(distance)
    parts = cut_at_gaps(rows, keys, frame, distance, width).select(*keys, "part", frame, score, "tie_", own.alias("distance_"), *keep)
    schema = StructType([parts.schema[c] for c in (frame, score, *keep)])
    return scan(parts, [*keys, "part"], [frame], lambda: _Suppressor(distance if isinstance(distance, int) else None), schema).drop("part")


def trails(points: DataFrame, keys: list[str], frame: str, x: str, y: str, length: int, visible: str | None = None, width: int = BUCKET) -> DataFrame:
    """Per row: the seen points of the last ``length`` frames and its own, as an array of (frame, x, y) in order.

    A trail reaches back by frames, not rows, so gaps shorten it. Points that are not visible, or not right of and below
    zero, are in no trail. Rows of one frame see each other. The axis is cut into buckets of
    ``width`` frames and a bucket's last points are copied into the next, so a long key spreads over tasks.
    Rows without a frame go; null keys are one key.
    """
    if not 0 <= length < width:
        raise ValueError("a trail is shorter than a bucket")
    seen = (F.col(x) > 0) & (F.col(y) > 0) & (F.lit(True) if visible is None else F.col(visible))
    at = F.floor(F.col(frame) / width)
    copies = F.when(F.col(frame) >= (at + 1) * width - length, F.array(at, at + 1)).otherwise(F.array(at))
    rows = points.where(F.col(frame).isNotNull()).withColumn("_own", at).withColumn("_bucket", F.explode(copies))
    w = Window.partitionBy(*keys, "_bucket").orderBy(frame).rangeBetween(-length, 0)
    point = F.when(seen, F.struct(F.col(frame).alias("frame"), F.col(x).alias("x"), F.col(y).alias("y")))
    return rows.withColumn("trail", F.array_sort(F.collect_list(point).over(w))).where("_own = _bucket").drop("_own", "_bucket")
