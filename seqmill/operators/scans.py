"""Folds over long sequences: sorted scans that carry their state, and sequences cut into components at gaps.

A scan sends each key to one task, sorts it there and reads it as a stream of Arrow batches; only
the fold's state is held, so memory doesn't grow with a key's length. Where what happens on one
side of a gap can't touch the other side, ``cut_at_gaps`` makes components that are keys of their
own, so that a hot key spreads over tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Output rows that a scan gathers before it hands them on.
ROWS_OUT = 20_000
#: Rows of whole keys that are settled together.
ROWS_IN = 50_000
#: Rounds over all components at once; what is left then (long chains) is settled one after the other.
ROUNDS = 32
#: Frames of one bucket, within which neighbours are sought at first.
BUCKET = 100_000


class Fold:
    """State of one key. Rows come in order, as tuples without the key; both methods give output rows without it."""

    def add(self, row: tuple) -> Iterable[tuple]:
        raise NotImplementedError

    def end(self) -> Iterable[tuple]:
        return ()


def scan(rows: DataFrame, keys: list[str], order: list[str], fold: Callable[[], Fold], schema: StructType) -> DataFrame:
    """Each key's rows in ``order`` through a fold of its own; ``schema`` is of the output rows without the keys.

    ``rows`` holds the keys, then what the fold reads. Rows that tie in ``order`` come in any order.
    """
    out_schema = StructType([rows.schema[k] for k in keys] + schema.fields)
    n, arrow = len(keys), to_arrow_schema(out_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [()] * len(arrow)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        key, state, out = None, None, []
        for batch in batches:
            tuples = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            for k, group in groupby(tuples, key=lambda r: r[:n]):
                if state is None or k != key:
                    if state is not None:
                        out.extend(key + r for r in state.end())
                    key, state = k, fold()
                for r in group:
                    out.extend(k + o for o in state.add(r[n:]))
                    if len(out) >= ROWS_OUT:
                        yield batch_of(out)
                        out = []
        if state is not None:
            out.extend(key + r for r in state.end())
        yield batch_of(out)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, out_schema)


def begins(table: pa.Table, keys: list[str]) -> np.ndarray:
    """The rows of a sorted table where a key begins; nulls are one key, no keys are one."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for c in map(table.column, keys):
        a, b = c.slice(1), c.slice(0, max(len(c) - 1, 0))
        new[1:] |= pc.and_not(pc.fill_null(pc.not_equal(a, b), True), pc.and_(a.is_null(), b.is_null())).to_numpy()
    return np.flatnonzero(new)


def blocks(rows: DataFrame, keys: list[str], order: list[str], run: Callable[[pa.Table, np.ndarray], pa.Table], schema: StructType) -> DataFrame:
    """Whole keys, many at a time: ``run`` takes their rows in ``order`` and where each key begins, and gives a table of ``schema``.

    For work on bounded keys that arrays settle together. A key's rows are held in memory. ``rows`` are laid
    out by ``repartition(*keys)``; windows by the same keys may lie between.
    """
    arrow = to_arrow_schema(schema)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, wanted = [], 0, ROWS_IN
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < wanted:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            at = begins(table, keys)
            if last := int(at[-1]):
                yield from run(table.slice(0, last), at[:-1]).cast(arrow).to_batches()
            held, n = table.slice(last).to_batches(), n - last
            wanted = max(ROWS_IN, 2 * n)  # a long key is not looked at again with every batch
        if n:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from run(table, begins(table, keys)).cast(arrow).to_batches()

    return rows.sortWithinPartitions(*keys, *order).mapInArrow(whole, schema)


def one_axis(frames: np.ndarray, starts: np.ndarray, far: int) -> np.ndarray:
    """Sorted frames of many keys as places on one axis: distances below ``far`` stay, longer ones and those between keys are ``far`` or more."""
    steps = np.minimum(np.diff(frames, prepend=frames[:1]), far)
    steps[starts] = far
    return np.cumsum(steps)


def cut_at_gaps(rows: DataFrame, keys: list[str], order: str, gap: int | str, width: int | None = BUCKET) -> DataFrame:
    """Adds ``part``: the first ``order`` of the row's component; a new one begins where the step is ``gap`` or more.

    ``gap`` is a number or one of the keys. Neighbours are sought within buckets of ``width``; only
    one row for each bucket is looked at by key, so a long key is not sorted in one task. Where
    keys are bounded sessions, None as ``width`` takes a single window. Rows without an ``order`` go.
    """
    step = F.lit(gap) if isinstance(gap, int) else F.col(gap)
    names, rows = rows.columns, rows.where(F.col(order).isNotNull())
    if width is None:
        w = Window.partitionBy(*keys).orderBy(order)
        opens = F.coalesce(F.col(order) - F.lag(order).over(w) >= step, F.lit(True))
        return rows.withColumn("_opens", F.when(opens, F.col(order))).withColumn("part", F.last("_opens", True).over(w)).select(*names, "part")
    own = [*keys, "_bucket"]
    inside, by_bucket = Window.partitionBy(*own).orderBy(order), Window.partitionBy(*keys).orderBy("_bucket")
    whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("_bucket", F.floor(F.col(order) / width)).withColumn("_before", F.lag(order).over(inside))
    rows = rows.withColumn("_begun", F.last(F.when(F.col(order) - F.col("_before") >= step, F.col(order)), True).over(inside))
    rows = rows.withColumns({"_high": F.max(order).over(whole), "_last": F.max("_begun").over(whole)})
    edges = rows.where("_before IS NULL").select(*own, F.col(order).alias("_low"), "_high", "_last")
    edges = edges.withColumn("_opens", F.coalesce(F.col("_low") - F.lag("_high").over(by_bucket) >= step, F.lit(True)))
    carried = F.last(F.coalesce("_last", F.when(F.col("_opens"), F.col("_low"))), True).over(by_bucket.rowsBetween(Window.unboundedPreceding, -1))
    edges = edges.select(*[F.col(c).alias(f"_own{i}") for i, c in enumerate(own)], F.when(F.col("_opens"), F.col("_low")).otherwise(carried).alias("_carried"))
    on = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_own{i}")) for i, c in enumerate(own)])
    return rows.join(edges, on).select(*names, F.coalesce("_begun", "_carried").alias("part"))
