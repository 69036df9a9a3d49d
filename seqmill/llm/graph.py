"""Connected components of a link table, wholly in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqmill.llm.common import settle


def components(edges: DataFrame) -> DataFrame:
    """(node, label): every node of ``edges`` (a, b) with the smallest node it reaches.

    Each round takes the smallest label among the neighbours and then the label's own label, so
    the rounds grow with the logarithm of a chain's length. Labels only fall; an unchanged sum
    ends the rounds. Minimums combine before the shuffle; hub nodes are a skewed join, which
    adaptive execution splits.
    """
    both = settle(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    total = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
    while total is not None:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        hop = labels.join(near, "node").select("node", F.least("label", "m").alias("l"))
        jump = hop.join(labels.select(F.col("node").alias("l"), F.col("label").alias("l2")), "l", "left")
        labels = settle(jump.select("node", F.least("l", F.coalesce("l2", "l")).alias("label")))
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if now == total:
            break
        total = now
    return labels
