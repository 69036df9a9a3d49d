"""Evaluation in overlapping groups: 17 standing predicates and one group per unit, scored in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqmill import functions as fn


def standing_groups(label: str, split: str, alias: str, missing: str, top: str, bottom: str, both_missing: str) -> dict[str, Column]:
    """The 17 groups by name. Rates that are missing or no numbers count as 0."""
    number = lambda c: F.coalesce(F.col(c).cast("string").try_cast("double"), F.lit(0.0))
    clean, labelled = fn.unaliased(F.col(alias)), F.col(label) >= 0
    test, val = F.col(split) == "test", F.col(split) == "val"
    ours = test & clean
    # The names of the groups.
    return {
        "all_candidates": F.lit(True),
        "exact_label_all": labelled,
        "exact_label_clean": labelled & clean,
        "simultaneous_event_alias_diagnostic": ~clean,
        "reference_test_primary": ours,
        "reference_test_all_including_aliases": test,
        "reference_val_diagnostic": val & clean,
        "reference_val_all_including_aliases": val,
        "exact_label_pose_dropout_lt_50": labelled & (number(missing) < 0.5),
        "reference_test_pose_dropout_lt_50": ours & (number(missing) < 0.5),
        "exact_label_pose_dropout_lt_25": labelled & (number(missing) < 0.25),
        "reference_test_pose_dropout_lt_25": ours & (number(missing) < 0.25),
        "exact_label_all_pose_missing": labelled & (number(missing) == 1),
        "reference_test_top_pose_valid_ge_75": ours & (number(top) >= 0.75),
        "reference_test_top_pose_valid_lt_50": ours & (number(top) < 0.5),
        "reference_test_bottom_pose_valid_ge_75": ours & (number(bottom) >= 0.75),
        "reference_test_both_pose_missing_lt_10": ours & (number(both_missing) < 0.1),
    }


def group_scores(rows: DataFrame, groups: dict[str, Column], label: str, predicted: str, flags: dict[str, Column], unit: tuple[str, str, Column] | None = None) -> DataFrame:
    """Rows, labelled rows, accuracy, the share of each flag, and macro averages over the classes with support.

    A row counts in each group whose predicate is true. ``label`` below zero or null is unlabelled and only
    counts as a row. ``unit`` = (prefix, column, predicate) adds a group per value of the column, present
    even where no row of it passes the predicate. Named groups that hold nothing come with zeros. Where there is
    nothing to average a share is null, accuracy zero. Rows are reduced to one confusion per group before any other step.
    """
    tags = [F.when(p, F.lit(name)) for name, p in groups.items()]
    each = F.col(label) >= 0
    counted = F.transform(F.array_compact(F.array(*tags)), lambda t: F.struct(t.alias("grp"), F.lit(1).alias("one")))
    if unit:
        prefix, column, passes = unit
        name = F.concat(F.lit(prefix), F.col(column).cast("string"))
        own = F.when(name.isNotNull(), F.struct(name.alias("grp"), F.coalesce(passes, F.lit(False)).cast("int").alias("one")))
        counted = F.concat(counted, F.array_compact(F.array(own)))
    named = F.transform(F.array(*[F.lit(g) for g in groups]), lambda g: F.struct(g.alias("grp"), F.lit(0).alias("one")))
    picked = rows.select(F.explode(counted).alias("g"), F.when(each, F.col(label)).alias("t"), F.when(each, F.col(predicted)).alias("p"), *[(f & each).cast("int").alias(f"_{n}") for n, f in flags.items()])
    sums = [F.sum("g.one").alias("n"), *[F.coalesce(F.sum(F.col(f"_{n}") * F.col("g.one")), F.lit(0)).alias(f"_{n}") for n in flags]]
    cells = picked.groupBy("g.grp", "t", "p").agg(*sums)
    empty = rows.sparkSession.range(1).select(F.explode(named).alias("g")).select("g.grp", F.lit(None).cast(cells.schema["t"].dataType).alias("t"), F.lit(None).cast(cells.schema["p"].dataType).alias("p"), F.lit(0).cast("long").alias("n"), *[F.lit(0).cast("long").alias(f"_{n}") for n in flags])
    zero, labelled = F.lit(0).cast("long"), F.when(F.col("t").isNotNull(), F.col("n")).otherwise(0)
    truth = F.struct(F.col("t").alias("c"), F.col("n").alias("rows"), labelled.alias("support"), zero.alias("called"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit"), *[F.col(f"_{n}") for n in flags])
    guess = F.struct(F.col("p").cast(cells.schema["t"].dataType).alias("c"), zero.alias("rows"), zero.alias("support"), F.when(F.col("p").isNotNull(), F.col("n")).otherwise(0).alias("called"), zero.alias("hit"), *[zero.alias(f"_{n}") for n in flags])
    names = ["rows", "support", "called", "hit", *[f"_{n}" for n in flags]]
    classes = cells.unionByName(empty).select("grp", F.explode(F.array(truth, guess)).alias("s")).groupBy("grp", "s.c").agg(*[F.sum(f"s.{n}").alias(n) for n in names])
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    precision, recall = share("hit", "called"), share("hit", "support")
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    there = lambda c: F.avg(F.when(F.col("support") > 0, c))
    return classes.groupBy("grp").agg(
        F.sum("rows").alias("n_rows"), F.sum("support").alias("labelled_rows"), F.coalesce(F.try_divide(F.sum("hit"), F.sum("support")), F.lit(0.0)).alias("accuracy"),
        *[F.try_divide(F.sum(f"_{n}"), F.sum("support")).alias(n) for n in flags],
        there(precision).alias("macro_precision"), there(recall).alias("macro_recall"), there(f1).alias("macro_f1"), F.count_if(F.col("support") > 0).alias("n_classes"),
    )
