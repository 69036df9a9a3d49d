"""Two-state smoothing of a stream of samples, with the queue and the last state kept between batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

#: The state store that keeps such state; set it before the query starts.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Smoother(StatefulProcessor):
    """Holds the samples whose window is not full yet, and the state of the last one given out."""

    def __init__(self, key: str, order: str, raw: str, length: int, idle_ms: int | None) -> None:
        self.key, self.order, self.raw, self.length, self.idle_ms = key, order, raw, length, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "orders array<bigint>, raws array<int>, state int", self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        orders, raws, state = self.held.get() if self.held.exists() else ([], [], 0)
        orders, raws = list(orders), list(raws)
        new = pd.concat(list(rows))[[self.order, self.raw]].sort_values(self.order, kind="stable")
        new = new[new[self.order] > (orders[-1] if orders else -(2**63))]
        orders += [int(x) for x in new[self.order]]
        raws += [int(x) for x in new[self.raw]]
        out, on, n = [], sum(raws[: self.length]), len(orders)
        for i in range(max(0, n - self.length + 1)):
            before, raw = state, raws[i]
            if raw == 1 and 2 * on >= self.length:
                state = 1
            elif raw == 0 and 2 * on <= self.length:
                state = 0
            out.append((orders[i], raw, state, state - before))
            on += (raws[i + self.length] if i + self.length < n else 0) - raw
        self.held.update((orders[len(out) :], raws[len(out) :], state))
        if out:
            got = pd.DataFrame(out, columns=["order", "raw", "state", "change"])
            got.insert(0, "key", key[0])
            yield got

    def close(self) -> None:
        pass


def smooth_stream(samples: DataFrame, key: str, order: str, raw: str, length: int, idle_ms: int | None = None) -> DataFrame:
    """(key, order, raw, state, change) of a stream: what ``smooth_states`` gives for the same rows.

    A sample is given out as soon as ``length`` samples from it on have come. Samples of a key come
    in order from batch to batch; within a batch they are sorted. One no newer than the last taken
    is a repeat and goes, as do samples without a key, an order or a value. The state of a key that was
    idle for ``idle_ms`` is dropped; the key then begins anew. State is one window for each key.
    """
    if not samples.isStreaming:
        raise ValueError("smooth_stream takes a stream; smooth_states does the same for a table")
    spark = samples.sparkSession
    if spark.conf.get(STORE[0]) != STORE[1]:
        raise ValueError(f"set {STORE[0]} to {STORE[1]}")
    kinds = [samples.schema[key].dataType, LongType(), IntegerType(), IntegerType(), IntegerType()]
    schema = StructType([StructField(n, t) for n, t in zip(("key", "order", "raw", "state", "change"), kinds, strict=True)])
    out = samples.select(key, order, raw).dropna().groupBy(key).transformWithStateInPandas(
        statefulProcessor=Smoother(key, order, raw, length, idle_ms), outputStructType=schema, outputMode="Append", timeMode="ProcessingTime" if idle_ms else "None"
    )
    return out.withColumnsRenamed({"key": key, "order": order, "raw": raw})
