"""Summaries of logs: sequences, groups, profiles, frequencies, coverage and contract checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqmill import functions as fn


def sequence_summary(rows: DataFrame, keys: list[str], order: str, token: str, outcome: str) -> DataFrame:
    """Per sequence: events, first and last token in file order, and the last outcome that isn't null."""
    last = F.max(F.when(F.col(outcome).isNotNull(), F.struct(order, F.col(outcome).alias("o"))))["o"]
    return rows.groupBy(*keys).agg(F.count("*").alias("n_events"), F.min(F.struct(order, F.col(token).alias("t")))["t"].alias("first_token"), F.max(F.struct(order, F.col(token).alias("t")))["t"].alias("last_token"), last.alias("outcome"))


def distinct_summary(rows: DataFrame, keys: list[str], counted: list[str]) -> DataFrame:
    """Per group: rows, and distinct values of each of ``counted`` (nulls don't count)."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), *[F.count_distinct(c).alias(f"n_{c}") for c in counted])


def match_summary(rows: DataFrame, key: str, group: str, sequence: str) -> DataFrame:
    """Per match: distinct (group, sequence) pairs, and the distinct groups in numeric order, comma-joined.

    Pairs are made distinct first, so a match with very many rows is pre-aggregated.
    """
    pairs = rows.select(key, group, sequence).distinct()
    return pairs.groupBy(key).agg(F.count("*").alias("n_sequences"), F.array_join(F.array_sort(F.collect_set(group)).cast("array<string>"), ",").alias("groups"))


def most_common(rows: DataFrame, token: str, *keys: str) -> DataFrame:
    """Frequency table: n per token (and keys)."""
    return rows.groupBy(*keys, token).agg(F.count("*").alias("n"))


def rates(rows: DataFrame, keys: list[str], **conditions: Column) -> DataFrame:
    """Per group: n, and the share of rows for which each condition holds (null: doesn't)."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(F.coalesce(c.cast("int"), F.lit(0))).alias(name) for name, c in conditions.items()])


def state_profile(rows: DataFrame, key: str, token: str, states: list[str], weight: str) -> DataFrame:
    """Per group: n of rows with a token, mean ``weight``, and the share of each state (zeros filled in)."""
    shares = [F.coalesce(F.avg((F.col(token) == s).cast("int")), F.lit(0.0)).alias(f"p_{s}") for s in states]
    return rows.groupBy(key).agg(F.count(token).alias("n"), F.avg(weight).alias("mean_weight"), *shares)


def crosstab(rows: DataFrame, row: str, column: str) -> DataFrame:
    """Contingency table: row, column, n and the share within its row."""
    counts = rows.groupBy(row, column).agg(F.count("*").alias("n"))
    total = counts.groupBy(row).agg(F.sum("n").alias("_all"))
    return counts.join(total, row).select(row, column, "n", (F.col("n") / F.col("_all")).alias("share"))


def movement_profile(rows: DataFrame, keys: list[str], token: str, x: str, distance: str, sure: Column) -> DataFrame:
    """Means and population deviations, with rates over three denominators: all rows, rows with a distance, sure rows."""
    moved = F.col(distance).isNotNull()
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n_events"), F.count(distance).alias("n_displacements"), F.avg(x).alias("mean_x"), F.stddev_pop(x).alias("std_x"), F.avg(distance).alias("mean_distance"), F.stddev_pop(distance).alias("std_distance"),
        (F.count_if((F.col(token) == "purchase") & moved) / F.nullif(F.count(distance), F.lit(0))).alias("moved_rate"),
        (F.count_if((F.col(token) == "click") & sure) / F.nullif(F.count_if(sure), F.lit(0))).alias("sure_rate"),
        F.avg((F.col(token) == "view").cast("int")).alias("view_rate"),
    )


def numeric_summary(rows: DataFrame, names: list[str]) -> DataFrame:
    """Per column: n, mean, exact median, least, greatest, mean absolute value and the share of zeros."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("x")) for n in names])).alias("r")).select("r.*").where("x IS NOT NULL")
    return long.groupBy("name").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.median("x").alias("median"), F.min("x").alias("least"), F.max("x").alias("greatest"), F.avg(F.abs("x")).alias("mae"), F.avg((F.col("x") == 0).cast("int")).alias("exact_rate"))


def weighted_mean(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Mean of ``value`` weighted by ``weight``; null where the weights sum to nothing."""
    sound = F.col(value).isNotNull() & F.col(weight).isNotNull()
    total = F.sum(F.when(sound, F.col(weight)))
    return rows.groupBy(*keys).agg((F.sum(F.when(sound, F.col(value) * F.col(weight))) / F.nullif(total, F.lit(0))).alias("mean"))


def coverage(rows: DataFrame, **conditions: Column) -> DataFrame:
    """(name, n, share) for each condition over all rows, in one pass."""
    names = list(conditions)
    counts = rows.agg(F.count("*").alias("_all"), *[F.count_if(conditions[c]).alias(f"_{i}") for i, c in enumerate(names)])
    each = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"_{i}").alias("n"), (F.col(f"_{i}") / F.nullif(F.col("_all"), F.lit(0))).alias("share")) for i, c in enumerate(names)])
    return counts.select(F.explode(each).alias("r")).select("r.*")


class ContractError(ValueError):
    """A table breaks its contract."""


def contract(rows: DataFrame, key: list[str], **violations: Column) -> DataFrame:
    """(check, n): rows that share a key beyond the first, and rows for which each violation holds."""
    repeated = rows.groupBy(*key).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("n")).select(F.lit("duplicate_keys").alias("check"), "n")
    return repeated.unionByName(coverage(rows, **violations).select(F.col("name").alias("check"), "n"))


def enforce(checks: DataFrame) -> None:
    """Raises unless every check of ``contract`` counted nothing (a handful of rows)."""
    bad = checks.where("n != 0").orderBy("check").collect()
    if bad:
        raise ContractError(", ".join(f"{r.check}: {r.n}" for r in bad))


def correlations(rows: DataFrame, names: list[str]) -> DataFrame:
    """(a, b, r): Pearson correlation of every two columns, in one pass; null where one doesn't vary."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    got = rows.agg(*[fn.pearson(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    each = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return got.select(F.explode(each).alias("p")).select("p.*")
