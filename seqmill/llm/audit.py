"""Interaction of filters: what each removes after any others have run, for every order, from packed bitmaps.

A document's failed filters are computed once. Each batch of a partition becomes a bitmap index:
one packed bitset per filter and per label, with the documents of a part in adjoining bytes. For
every set of filters that may have run before, AND-NOT and popcounts give what a further filter
removes there; the counts are summed over batches, partitions and parts, and the orders (a
literal table) pick theirs. Whether a text stands in a smaller doc_id is settled by the pair of
text hash and smallest doc_id, so a text that many documents share is no hot key.

Defined cases: a null text is empty, a null source is the part ''; a document fails no copy test
without a doc_id, and rows of one doc_id with one text both stand first; a label counts if any
label row of that doc_id has the value 1; other columns are ignored, whatever their names; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqmill.llm.common import words_of

FILTERS = "ABCDE"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Documents of one bitmap.
ROWS = 65_536
COUNTS = ("n", "fails", "gone", "removed", "good_lost", "toxic_lost")
_ONES = np.array([bin(i).count("1") for i in range(256)], np.int64)


def failures(text: Column) -> dict[str, Column]:
    """The conditions that a text alone decides."""
    words = words_of(text)
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * capitals > 5 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def ledger(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failed, good, toxic) per document: failed has bit i for filter i of ``FILTERS``."""
    text = F.coalesce("text", F.lit(""))
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failures(text).values())), F.lit(0))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("_h"), bits.alias("failed"))
    known, none = rows.where(F.col("doc_id").isNotNull()), rows.where(F.col("doc_id").isNull())
    first = docs.where(F.col("doc_id").isNotNull()).groupBy(F.unhex(F.sha2(text, 256)).alias("_h")).agg(F.min("doc_id").alias("doc_id")).withColumn("_first", F.lit(True))
    marked = known.join(first, ["doc_id", "_h"], "left")
    marked = marked.select("doc_id", "part", (F.col("failed") + F.when(F.col("_first").isNull(), 16).otherwise(0)).alias("failed"))
    one = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).cast("boolean")
    told = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    out = marked.join(told, "doc_id", "left").select("part", "failed", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    return out.unionByName(none.select("part", "failed", F.lit(False).alias("good"), F.lit(False).alias("toxic")))


def bitmap_counts(parts: np.ndarray, failed: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray]]]:
    """(distinct parts, [(set before, filter, counts by part)]); counts as in ``COUNTS``.

    Each part's documents begin at a byte of their own, so bytes can be summed by part.
    """
    order = np.argsort(parts, kind="stable")
    names, n = np.unique(parts, return_counts=True)
    starts = np.concatenate(([0], np.cumsum(-(-n // 8))))
    place = np.arange(len(parts)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(8 * starts[:-1], n)

    def packed(flag: np.ndarray) -> np.ndarray:
        bits = np.zeros(8 * starts[-1], bool)
        bits[place] = flag[order]
        return np.packbits(bits)

    count = lambda bitmap: np.add.reduceat(_ONES[bitmap], starts[:-1])
    fails = [packed((failed >> i & 1).astype(bool)) for i in range(len(FILTERS))]
    is_good, is_toxic = packed(good), packed(toxic)
    total = [count(f) for f in fails]
    out = []
    for before in range(1 << len(FILTERS)):
        gone = np.zeros(starts[-1], np.uint8)
        for i, f in enumerate(fails):
            if before >> i & 1:
                gone |= f
        for i, f in enumerate(fails):
            if not before >> i & 1:
                here = f & ~gone
                out.append((before, i, np.column_stack((n, total[i], count(gone | f), count(here), count(here & is_good), count(here & is_toxic)))))
    return names, out


def prefix_counts(rows: DataFrame) -> DataFrame:
    """(part, before, filter, counts): per part, set of filters that ran before and further filter, from a ledger."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                coded = b.column("part").dictionary_encode()
                flags = [b.column(c).to_numpy(zero_copy_only=False) for c in ("failed", "good", "toxic")]
                names, counts = bitmap_counts(coded.indices.to_numpy(), *flags)
                part = coded.dictionary.take(pa.array(np.tile(names, len(counts))))
                each = np.concatenate([c for _, _, c in counts])
                key = [np.repeat([x[k] for x in counts], len(names)).astype(np.int32) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([part, *map(pa.array, key), *[pa.array(each[:, k]) for k in range(len(COUNTS))]], names=["part", "before", "filter", *COUNTS])

    schema = "part string, before int, filter int, " + ", ".join(f"{c} long" for c in COUNTS)
    return rows.mapInArrow(run, schema).groupBy("part", "before", "filter").agg(*[F.sum(c).alias(c) for c in COUNTS])


def orders(spark: SparkSession) -> DataFrame:
    """(filter_order, step, before, filter): every order of the filters, a literal of 600 rows."""
    rows = [("".join(FILTERS[i] for i in p), k + 1, sum(1 << i for i in p[:k]), p[k]) for p in permutations(range(len(FILTERS))) for k in range(len(FILTERS))]
    return spark.createDataFrame(rows, "filter_order string, step int, before int, filter int")


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, order of filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    counts = prefix_counts(ledger(docs, labels))
    size = F.bit_count("before")
    last = len(FILTERS) - 1
    times = F.array(*[F.lit(factorial(k) * factorial(last - k)) for k in range(last + 1)])
    w = Window.partitionBy("part", "filter")  # 16 rows, one for each set that may have run before
    alone, share = F.max(F.when(size == last, F.col("removed"))).over(w), F.sum(F.col("removed") * F.get(times, size)).over(w)
    counts = counts.withColumns({"unique_fails": alone, "shapley": share})
    steps = counts.join(F.broadcast(orders(docs.sparkSession)), ["before", "filter"])  # 600 rows
    return steps.select(
        "part", "filter_order", "step", (F.col("n") - F.col("gone")).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley"
    )
