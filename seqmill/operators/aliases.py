"""Simultaneous events that share one set of features: expansion to their targets, and the contract of a manifest.

Groups are the rows that agree in all keys; null keys agree with each other. ``validation`` has one
row per clip.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqmill.operators.joins import JoinError
from seqmill.operators.summaries import contract


class Expansion(NamedTuple):
    rows: DataFrame  # the manifest's columns and alias_source (empty text where nothing was copied)
    quality: DataFrame  # the validation's columns, one row for each row of ``rows`` that has a validation
    counts: DataFrame  # one row: groups_repaired, aliased_rows


def _meet(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    right = right.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    on = reduce(Column.__and__, [left[k].eqNullSafe(right[f"_k{i}"]) for i, k in enumerate(keys)])
    return left.join(right, on, how).drop(*[f"_k{i}" for i in range(len(keys))])


def _refuse(bad: DataFrame, columns: list[str], why: str) -> None:
    found = bad.select(*columns).limit(5).collect()
    if found:
        raise JoinError(f"{why}: {[tuple(r) for r in found]}")


def expand(manifest: DataFrame, validation: DataFrame, targets: DataFrame, keys: list[str], rank: str, order: str, clip: str = "clip_id", frames: str = "frame_count") -> Expansion:
    """Each group of several manifest rows gets the features of one canonical row, under its targets' names.

    A group's source is its last clip (by rank, then clip); canonical is the last row whose frame
    count agrees with the source's validation, else the last row. The group's i-th row takes the
    i-th target's clip (by ``order``, then clip), keeps its own rank, and has the source's validation copied.
    Rows alone in their group stay as they are, whatever their targets.
    Raises when a group and its targets differ in size or a source has no validation.
    """
    whole = Window.partitionBy(*keys)
    place = F.row_number().over(whole.orderBy(rank, clip))
    numbered = manifest.withColumns({"_n": F.count("*").over(whole), "_place": place, "_source": F.max_by(clip, F.struct(rank, clip)).over(whole)})
    single = numbered.where("_n = 1").select(*manifest.columns, F.lit("").alias("alias_source"))
    checks = validation.select(F.col(clip).alias("_source"), F.col(frames).alias("_frames"), F.lit(True).alias("_checked"))
    several = numbered.where("_n > 1").join(checks, "_source", "left")
    _refuse(several.where("_checked IS NULL"), [*keys, "_source"], "no validation of the source")

    aims = targets.select(*keys, F.col(clip).alias("_target"), F.row_number().over(whole.orderBy(order, clip)).alias("_place"))
    sizes = _meet(several.groupBy(*keys).agg(F.count("*").alias("_rows")), aims.groupBy(*keys).agg(F.count("*").alias("_aims")), keys, "left")
    _refuse(sizes.where("NOT (_rows <=> _aims)"), [*keys, "_rows", "_aims"], "rows and targets differ in number")

    copied = [c for c in manifest.columns if c not in (*keys, rank, clip)]
    agrees = F.coalesce(F.col(frames) == F.col("_frames"), F.lit(False))
    canonical = several.groupBy(*keys).agg(F.max_by(F.struct(*copied), F.struct(agrees, rank, clip)).alias("_canonical"))
    places = _meet(several.select(*keys, rank, "_place", "_source"), canonical, keys)
    places = _meet(places, aims, [*keys, "_place"])
    of = {c: F.col(f"_canonical.{c}") for c in copied} | {clip: F.col("_target")}
    aliased = places.select(*[of.get(c, F.col(c)).alias(c) for c in manifest.columns], F.col("_source").cast("string").alias("alias_source"))

    own = validation.join(single.select(clip), clip, "left_semi").select(*validation.columns)
    taken = places.select(F.col("_source").alias("_from"), F.col("_target"), F.col(rank).alias("_rank"))
    lent = validation.join(taken, F.col(clip) == F.col("_from"))
    renamed = {clip: F.col("_target"), rank: F.col("_rank")}
    lent = lent.select(*[renamed.get(c, F.col(c)).alias(c) for c in validation.columns])
    counts = several.agg(F.count_if(F.col("_place") == 1).alias("groups_repaired"), F.count("*").alias("aliased_rows"))
    return Expansion(single.unionByName(aliased), own.unionByName(lent), counts)


def source_contract(manifest: DataFrame, validation: DataFrame, sidecars: DataFrame, clip: str, frames: str, event: str, start: str, end: str, sidecar: str) -> DataFrame:
    """(check, n) of the five checks of a manifest: repeated clips, no validation, another frame count, a named file that isn't in ``sidecars``, an event outside its window.

    Nulls and empty texts break no check of frame count, file or window; a null clip has no validation.
    ``sidecars`` is a table of paths, such as an inventory of files; ``summaries.enforce`` raises.
    """
    known = validation.where(F.col(clip).isNotNull()).groupBy(clip).agg(F.max(frames).alias("_frames"), F.lit(True).alias("_checked"))
    there = sidecars.select(F.col(sidecars.columns[0]).alias(sidecar)).where(F.col(sidecar).isNotNull()).distinct().withColumn("_there", F.lit(True))
    rows = manifest.join(known, clip, "left").join(there, sidecar, "left")
    return contract(
        rows, [clip], missing_validation=F.col("_checked").isNull(), frame_count_mismatches=F.col("_checked") & F.col(frames).isNotNull() & ~F.col(frames).eqNullSafe(F.col("_frames")),
        missing_sidecars=(F.col(sidecar) != "") & F.col("_there").isNull(), event_outside_window=F.col(event).isNotNull() & ~F.coalesce(F.col(event).between(F.col(start), F.col(end)), F.lit(False)),
    )
