"""Joins with accounting: outer joins that report misses, claims of intervals, ordinal joins, grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqmill.operators.intervals import WIDTH, _counted, _repeated, on_axis, points_in_intervals


class JoinError(ValueError):
    """A join whose sides had to agree found that they don't."""


def _on(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k] == b[k] for k in keys])


def left_marked(left: DataFrame, right: DataFrame, keys: list[str], mark: str = "matched") -> DataFrame:
    """Left outer join on ``keys`` with a boolean that tells whether the row met one."""
    return left.join(right.withColumn(mark, F.lit(True)), keys, "left").withColumn(mark, F.coalesce(mark, F.lit(False)))


def accounting(joined: DataFrame, mark: str = "matched") -> DataFrame:
    """One row: n_matched, n_unmatched, match_rate of a marked join."""
    return joined.agg(F.count_if(F.col(mark)).alias("n_matched"), F.count_if(~F.col(mark)).alias("n_unmatched"), F.avg(F.col(mark).cast("int")).alias("match_rate"))


def required(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join that raises when a row of ``left`` meets nothing."""
    missing = left.join(right, keys, "left_anti")
    if not missing.isEmpty():
        raise JoinError(f"no partner for {[tuple(r) for r in missing.select(*keys).limit(5).collect()]}")
    return left.join(right, keys)


def with_default(left: DataFrame, right: DataFrame, keys: list[str], value: str, default: Column) -> DataFrame:
    """Left outer join; where nothing is met, ``value`` is made by ``default``, and ``source`` says which."""
    joined = left.join(right.select(*keys, F.col(value).alias("_met")), keys, "left")
    return joined.select(*left.columns, F.coalesce("_met", default).alias(value), F.when(F.col("_met").isNull(), "synthesised").otherwise("joined").alias("source"))


def split_problems(left: DataFrame, right: DataFrame, keys: list[str], reason: str) -> tuple[DataFrame, DataFrame]:
    """(rows joined, rows of ``left`` that met nothing with the reason): misses are a table, not an error."""
    return left.join(right, keys), left.join(right, keys, "left_anti").withColumn("reason", F.lit(reason))


def disagreeing(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Rows that meet by key but differ in what should be one value (a null differs from a value)."""
    return left.join(right, _on(left, right, keys)).where(~F.col(a).eqNullSafe(F.col(b))).select(*[left[k] for k in keys], a, b)


def claimed(points: DataFrame, intervals: DataFrame, key: str, point: str, order: str) -> DataFrame:
    """Points in intervals, each claimed by the first interval (by ``order``) that holds it.

    Equal points are claimed alike and all come back.
    """
    names, span = points.columns, list(dict.fromkeys([order, "start", "end"]))
    met = points_in_intervals(_counted(points), intervals.select(key, *span), key, point)
    first = met.groupBy(*names, "_times").agg(F.min(F.struct(*span)).alias("_first"))
    return _repeated(first.select(*names, "_times", *[f"_first.{c}" for c in span]), *names, *span)


def _held(points: DataFrame, intervals: DataFrame, key: str, point: str) -> Column:
    return (points[key] == intervals[key]) & (points["_at"] == intervals["_at"]) & points[point].between(intervals["start"], intervals["end"])


def unclaimed(points: DataFrame, intervals: DataFrame, key: str, point: str) -> DataFrame:
    """Points that no interval holds; a point without a place is held by none."""
    a, b = points.withColumn("_at", F.floor(F.col(point) / WIDTH)), on_axis(intervals.select(key, "start", "end"), "start", "end")
    return a.join(b, _held(a, b, key, point), "left_anti").drop("_at")


def holding(intervals: DataFrame, points: DataFrame, key: str, point: str) -> DataFrame:
    """Intervals that hold at least one point; equal intervals all come back."""
    a, b = on_axis(_counted(intervals), "start", "end"), on_axis(points.select(key, point).distinct(), point, point)
    return _repeated(a.join(b, _held(b, a, key, point), "left_semi").drop("_at").distinct(), *intervals.columns)


def ordinal_join(left: DataFrame, right: DataFrame, keys: list[str], order_left: str, order_right: str) -> DataFrame:
    """Rows of the same group met by position; raises when a group's sizes differ.

    Columns of ``right`` that are no key must have other names than those of ``left``.
    """
    sizes = lambda rows, name: rows.groupBy(*keys).agg(F.count("*").alias(name))
    odd = sizes(left, "_l").join(sizes(right, "_r"), keys, "full").where("NOT (_l <=> _r)")
    if not odd.isEmpty():
        raise JoinError("groups of unequal size: " + str([tuple(r) for r in odd.limit(5).collect()]))
    numbered = lambda rows, order: rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    return numbered(left, order_left).join(numbered(right, order_right), [*keys, "place"])


def with_grid(rows: DataFrame, **values: list[float]) -> DataFrame:
    """Every row with every combination of parameter values: the grid is a literal, so no join is needed."""
    for name, each in values.items():
        rows = rows.withColumn(name, F.explode(F.array(*[F.lit(v) for v in each])))
    return rows
