"""Events within sequences: context windows, serves, short gaps, n-grams, padded activity, detector cascades."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqmill.operators.intervals import complement_intervals, merge_intervals
from seqmill.operators.trajectory import suppress


def context_windows(events: DataFrame, key: str, frame: str, fps: float) -> DataFrame:
    """Per event: from the one before to a quarter second after the next, half a second at the edges, bounded.

    Ends are inclusive, windows hold a frame at least; all in whole frames, rounded down.
    """
    half, limit = int(fps // 2), int(fps * 3 // 2)
    extra = half // 2
    w = Window.partitionBy(key).orderBy(frame)
    rows = events.withColumn("prev_event", F.lag(frame).over(w)).withColumn("next_event", F.lead(frame).over(w))
    start = F.greatest(F.coalesce("prev_event", F.col(frame) - half), F.col(frame) - limit, F.lit(0))
    end = F.least(F.coalesce(F.col("next_event") + extra, F.col(frame) + half), F.col(frame) + limit + extra)
    rows = rows.withColumn("window_start", start.cast("long")).withColumn("_end", end.cast("long"))
    return rows.withColumn("window_end", F.greatest(F.col("_end") - 1, F.col("window_start"))).drop("_end")


def serves(points: DataFrame, key: str, frame: str, y: str, speed: float) -> DataFrame:
    """First point of each key that rises to the next one by at least ``speed`` a frame (y points down)."""
    w = Window.partitionBy(key).orderBy(frame)
    rise = (F.col(y) - F.lead(y).over(w)) / F.greatest(F.lead(frame).over(w) - F.col(frame), F.lit(1))
    rows = points.select(key, frame, rise.alias("score")).where(F.col("score") >= speed)
    return rows.groupBy(key).agg(F.min(F.struct(frame, "score")).alias("_s")).select(key, f"_s.{frame}", "_s.score")


def recovered_gaps(points: DataFrame, key: str, frame: str, value: str, hold: int = 2, bridge: int = 10) -> DataFrame:
    """Gaps of up to ``hold`` frames repeat the value before; up to ``bridge`` run straight to the next; others stay.

    Frames have no gaps of their own. Adds recovered, observed and valid.
    """
    w = Window.partitionBy(key).orderBy(frame)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    seen = F.when(F.col(value).isNotNull(), F.struct(F.col(frame).alias("f"), F.col(value).cast("double").alias("v")))
    rows = points.withColumn("_p", F.last(seen, True).over(back)).withColumn("_n", F.first(seen, True).over(ahead))
    rows = rows.withColumn("_low", F.min(frame).over(Window.partitionBy(key))).withColumn("_high", F.max(frame).over(Window.partitionBy(key)))
    gap = F.coalesce(F.col("_n.f"), F.col("_high") + 1) - F.coalesce(F.col("_p.f"), F.col("_low") - 1) - 1
    share = (F.col(frame) - F.col("_p.f")) / (gap + 1)
    found = F.when(F.col(value).isNotNull(), F.col(value).cast("double")).when((gap <= hold) & F.col("_p").isNotNull(), F.col("_p.v"))
    found = found.when((gap <= bridge) & F.col("_p").isNotNull() & F.col("_n").isNotNull(), (1 - share) * F.col("_p.v") + share * F.col("_n.v"))
    rows = rows.withColumn("recovered", found).withColumn("observed", F.col(value).isNotNull())
    return rows.withColumn("valid", F.col("recovered").isNotNull()).drop("_p", "_n", "_low", "_high")


def ngram_counts(lists: DataFrame, n: int) -> DataFrame:
    """How often each contiguous n-gram occurs, repeats in one sequence included."""
    gram = lambda i: F.array_join(F.slice("tokens", i, n), " > ")
    grams = F.when(F.size("tokens") >= n, F.transform(F.sequence(F.lit(1), F.size("tokens") - n + 1), gram))
    return lists.select(F.explode(grams).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"))


def activity(events: DataFrame, key: str, sequence: str, frame: str, pad: int, length: int) -> DataFrame:
    """Union of the sequences' spans of frames, padded and cut to [0, length), per key."""
    spans = events.where(F.col(frame) >= 0).groupBy(key, sequence).agg(F.greatest(F.lit(0), F.min(frame) - pad).cast("long").alias("start"), F.least(F.lit(length - 1), F.max(frame) + pad).cast("long").alias("end"))
    return merge_intervals(spans.where("start <= end"), key)


def rest(active: DataFrame, keys: DataFrame, key: str, guard: int, length: int) -> DataFrame:
    """What guarded intervals leave of [0, length), per key of ``keys``; a key without intervals keeps all."""
    wide = active.select(key, F.greatest(F.lit(0), F.col("start") - guard).cast("long").alias("start"), F.least(F.lit(length - 1), F.col("end") + guard).cast("long").alias("end")).where("start <= end")
    whole = keys.select(key).distinct().join(wide, key, "left_anti").select(key, F.lit(0).cast("long").alias("start"), F.lit(length - 1).cast("long").alias("end"))
    return complement_intervals(merge_intervals(wide, key), key, 0, length - 1).unionByName(whole)


def cascade(candidates: list[DataFrame], key: str, frame: str, score: str, distance: int) -> DataFrame:
    """Candidates of several detectors (key, frame, score), suppressed each for itself and then together."""
    kept = [suppress(c.select(key, frame, score), key, frame, score, distance) for c in candidates]
    return suppress(reduce(DataFrame.unionByName, kept), key, frame, score, distance)
