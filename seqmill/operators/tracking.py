"""Detections to tracks: court filter, two-slot tracking, coverage of a trajectory, batches and samples of frames."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from seqmill.operators.scans import Fold, scan

#: Weight of the distance from the middle of a player's half against the area of the box.
OFF_CENTRE = 10_000.0


def court_candidates(people: DataFrame, x: str, y: str, box: str, points: str, margin: float = 0.1, least: int = 5) -> DataFrame:
    """``people`` with on_court (within the margin), area of the box and pose_valid (``least`` joints that are not zero)."""
    side = lambda i: F.get(box, F.lit(i + 2)) - F.get(box, F.lit(i))
    near = F.col(x).between(-margin, 1 + margin) & F.col(y).between(-margin, 1 + margin)
    seen = F.size(F.filter(points, lambda p: F.exists(p, lambda v: v != 0)))
    return people.withColumn("on_court", near).withColumn("area", F.greatest(side(0) * side(1), F.lit(0.0))).withColumn("pose_valid", seen >= least)


class _Slots(Fold):
    """Carries where both players were last seen and the people of the frame being read."""

    def __init__(self, split: float, reach: float, memory: int) -> None:
        self.split, self.reach, self.memory = split, reach, memory
        self.last: list[tuple[float, float, int] | None] = [None, None]
        self.frame, self.people = None, []

    def add(self, row: tuple) -> Iterator[tuple]:
        frame, x, y, area = row
        if self.frame is not None and frame != self.frame:
            yield from self.settle()
        self.frame = frame
        if x is not None:
            self.people.append((x, y, area))

    def end(self) -> Iterator[tuple]:
        return self.settle() if self.frame is not None else iter(())

    def settle(self) -> Iterator[tuple]:
        for player in (0, 1):
            last = self.last[player]
            known = last is not None and last[2] <= self.memory
            middle = self.split * 0.5 if player == 0 else self.split + (1 - self.split) * 0.5
            best = None
            for x, y, area in self.people:
                if y is None or (y <= self.split) != (player == 0):
                    continue
                cost = math.sqrt((x - last[0]) ** 2 + (y - last[1]) ** 2) if known else abs(y - middle) * OFF_CENTRE - area
                if best is None or cost < best[0]:
                    best = (cost, x, y)
            if best is not None and (not known or best[0] <= self.reach):
                self.last[player] = (best[1], best[2], 0)
                yield self.frame, player, best[1], best[2]
            elif last is not None:
                self.last[player] = (last[0], last[1], last[2] + 1)
        self.people = []


def two_slots(candidates: DataFrame, keys: list[str], frame: str, x: str, y: str, area: str, split: float, reach: float, memory: int = 10) -> DataFrame:
    """(keys, frame, player, x, y): who stands in the far (0) and the near (1) half in each frame.

    A player is the candidate of that half closest to where it was last seen, if within ``reach``;
    after more than ``memory`` frames without it, or at first, the one of largest area near the
    middle of the half. Ties go to the first candidate by place. Frames without anybody are rows
    with null positions. A scan that carries both places and one frame's people.
    """
    rows = candidates.select(*keys, F.col(frame).cast("long").alias("frame"), *[F.col(c).cast("double").alias(n) for c, n in ((x, "x_"), (y, "y_"), (area, "area_"))])
    kinds = (("frame", LongType()), ("player", IntegerType()), ("x", DoubleType()), ("y", DoubleType()))
    return scan(rows, keys, ["frame", "x_", "y_", "area_"], lambda: _Slots(split, reach, memory), StructType([StructField(*k) for k in kinds]))


def trajectory_coverage(points: DataFrame, keys: list[str], frame: str, x: str, y: str, visible: Column, width: float, height: float) -> DataFrame:
    """Per key: rows, visible rows, their share, visible rows outside the picture, first and last frame."""
    outside = ~(F.col(x).between(0, width) & F.col(y).between(0, height))
    counts = F.count("*").alias("n_rows"), F.count_if(visible).alias("n_visible"), F.count_if(visible & outside).alias("n_outside")
    out = points.groupBy(*keys).agg(*counts, F.min(frame).alias("first_frame"), F.max(frame).alias("last_frame"))
    return out.withColumn("coverage", F.col("n_visible") / F.col("n_rows"))


def batches(frames: DataFrame, key: str, frame: str, n: int) -> DataFrame:
    """(key, batch, slot, frame, real): groups of ``n`` frames; the last is filled up with its last frame, not real."""
    w = Window.partitionBy(key).orderBy(frame)
    rows = frames.select(key, frame, (F.row_number().over(w) - 1).cast("long").alias("_p"), F.lead(frame).over(w).isNull().alias("_last"))
    slot = F.col("_p") % n
    slots = F.when(F.col("_last"), F.sequence(slot, F.lit(n - 1).cast("long"))).otherwise(F.array(slot))
    rows = rows.select(key, F.floor(F.col("_p") / n).alias("batch"), F.explode(slots).alias("slot"), frame, slot.alias("_own"))
    return rows.select(key, "batch", "slot", frame, (F.col("slot") == F.col("_own")).alias("real"))


def sampled_frames(intervals: DataFrame, key: str, count: int, stride: int, seed: int = 0, skip_short: bool = False) -> DataFrame:
    """(key, frame): at most ``count`` frames of a key's intervals, every ``stride``-th being a candidate.

    The choice goes by a hash of seed, key and frame, so it is the same on every run;
    ``skip_short`` leaves out intervals shorter than the stride.
    """
    rows = intervals.where(F.col("end") - F.col("start") + 1 >= stride) if skip_short else intervals
    rows = rows.where("start <= end").select(key, F.explode(F.sequence("start", "end", F.lit(max(1, stride)).cast("long"))).alias("frame")).distinct()
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), F.col("frame").cast("string")))
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order, "frame"))).where(F.col("_r") <= count).drop("_r")
