"""Sequence mining over ordered event logs: transitions, segments, n-grams, openings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def transitions(events: DataFrame, key: str, order: str, token: str, states: list[str] | None = None) -> DataFrame:
    """Bigram counts and row-normalised probabilities: cur, nxt, cnt, prob.

    A token outside ``states`` breaks a pair and is never bridged.
    """
    w = Window.partitionBy(key).orderBy(order)
    pairs = events.select(F.col(token).alias("cur"), F.lead(token).over(w).alias("nxt"))
    if states is not None:
        pairs = pairs.where(F.col("cur").isin(states) & F.col("nxt").isin(states))
    counts = pairs.where("cur IS NOT NULL AND nxt IS NOT NULL").groupBy("cur", "nxt").agg(F.count("*").alias("cnt"))
    return counts.withColumn("prob", F.col("cnt") / F.sum("cnt").over(Window.partitionBy("cur")))


def soft_transitions(events: DataFrame, key: str, order: str, probs: str) -> DataFrame:
    """Expected transition mass from probability vectors: i, j, mass, prob."""
    w = Window.partitionBy(key).orderBy(order)
    pairs = events.select(F.col(probs).alias("p"), F.lead(probs).over(w).alias("q")).where("q IS NOT NULL")
    rows = pairs.select(F.posexplode("p").alias("i", "pi"), "q").select("i", "pi", F.posexplode("q").alias("j", "qj"))
    mass = rows.groupBy("i", "j").agg(F.sum(F.col("pi") * F.col("qj")).alias("mass"))
    return mass.withColumn("prob", F.try_divide("mass", F.sum("mass").over(Window.partitionBy("i"))))


def confident_segments(events: DataFrame, key: str, order: str, accept: Column) -> DataFrame:
    """Contiguous accepted runs: a rejected row or a gap in ``order`` ends a segment."""
    w = Window.partitionBy(key).orderBy(order)
    rows = events.withColumn("_ok", accept)
    broken = F.lag(order).over(w).isNull() | (F.col(order) != F.lag(order).over(w) + 1) | ~F.lag("_ok").over(w)
    rows = rows.withColumn("_seg", F.sum(broken.cast("int")).over(w)).where("_ok")
    return rows.groupBy(key, "_seg").agg(F.min(order).alias("first_rank"), F.max(order).alias("last_rank"), F.count("*").alias("n")).drop("_seg")


def token_lists(events: DataFrame, key: str, order: str, token: str) -> DataFrame:
    """One ordered array of tokens per key."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(token).alias("t"))))
    return events.where(F.col(token).isNotNull()).groupBy(key).agg(F.transform(pairs, lambda x: x["t"]).alias("tokens"))


def ngram_support(lists: DataFrame, n: int, top: int | None = None) -> DataFrame:
    """Share of sequences (short ones included) that hold each contiguous n-gram at least once."""
    total = lists.agg(F.count("*").alias("total"))
    gram = lambda i: F.array_join(F.slice("tokens", i, n), " > ")
    grams = F.when(F.size("tokens") >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("tokens") - n + 1), gram)))
    counts = lists.select(F.explode(grams).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n_sequences"))
    out = counts.crossJoin(F.broadcast(total)).select("pattern", "n_sequences", (F.col("n_sequences") / F.col("total")).alias("support"))
    return out if top is None else out.orderBy(F.desc("n_sequences"), "pattern").limit(top)


def openings(events: DataFrame, key: str, order: str, token: str, won: str, n: int = 3) -> DataFrame:
    """First n tokens of each key with their count, share and win rate (last known outcome)."""
    first = F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(token).alias("t")))), 1, n), lambda x: x["t"]), " > ")
    per = events.groupBy(key).agg(first.alias("opening"), F.count("*").alias("size"), F.max_by(won, F.when(F.col(won).isNotNull(), F.col(order))).alias("won"))
    per = per.where(F.col("size") >= n)
    out = per.groupBy("opening").agg(F.count("*").alias("n"), F.avg(F.coalesce(F.col("won").cast("int"), F.lit(0))).alias("win_rate"))
    total = out.agg(F.sum("n").alias("_all"))  # one row
    return out.crossJoin(F.broadcast(total)).withColumn("support", F.col("n") / F.col("_all")).drop("_all")


def displacements(events: DataFrame, key: str, order: str, x: str, y: str) -> DataFrame:
    """Difference and distance to the key's row before."""
    w = Window.partitionBy(key).orderBy(order)
    dx, dy = F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)
    return events.select(key, order, dx.alias("dx"), dy.alias("dy"), F.hypot(dx, dy).alias("distance"))


def event_windows(events: DataFrame, key: str, frame: str, start: str, end: str) -> DataFrame:
    """Midpoint windows (half-to-even) between neighbouring events, clamped to the key's interval."""
    w = Window.partitionBy(key).orderBy(frame)
    before, after = F.lag(frame).over(w), F.lead(frame).over(w)
    middle = lambda a, b: F.bround((a + b) / 2).cast("long")
    lo = F.greatest(F.coalesce(middle(before, F.col(frame)), F.col(start)), F.col(start))
    hi = F.least(F.coalesce(middle(F.col(frame), after), F.col(end)), F.col(end))
    return events.select(key, frame, lo.alias("window_start"), hi.alias("window_end"), before.alias("prev_event"), after.alias("next_event"))


def clamped_windows(events: DataFrame, key: str, frame: str, start: str, end: str, context: int) -> DataFrame:
    """Ranks, midpoint windows and contexts of ``context`` frames on both sides, which end where the key's interval does.

    Places in the interval count from its start, where windows never begin before zero.
    """
    at, low, high = F.col(frame), F.col(start), F.col(end)
    w = Window.partitionBy(key).orderBy(frame)
    before, after = F.lag(frame).over(w), F.lead(frame).over(w)
    rows = events.select(
        key, frame, start, F.row_number().over(w).cast("long").alias("event_rank"), F.coalesce(F.bround((before + at) / 2).cast("long"), low).alias("window_start"), F.coalesce(F.bround((at + after) / 2).cast("long"), high).alias("window_end"),
        F.greatest(low, at - context).alias("context_start"), F.least(high, at + context).alias("context_end"), before.alias("prev_event"), after.alias("next_event"),
    )
    local = lambda c: F.greatest(F.col(c) - F.col(start), F.lit(0))
    return rows.withColumns({"event_local": F.col(frame) - F.col(start), "window_start_local": local("window_start"), "window_end_local": local("window_end")}).drop(start)


def average_ranks(rows: DataFrame, value: str, by: str) -> DataFrame:
    """Ascending rank within ``by``; ties share their mean rank."""
    w = Window.partitionBy(by).orderBy(value)
    ties = F.count("*").over(Window.partitionBy(by, value))
    return rows.withColumn("avg_rank", F.rank().over(w) + (ties - 1) / 2.0)


def top_per_group(rows: DataFrame, by: str, *order: Column, k: int = 3) -> DataFrame:
    """The first k rows of each group in a total order, with their place."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("place") <= k)


def evenly_spaced(rows: DataFrame, by: str, order: str, k: int) -> DataFrame:
    """k rows of each group at positions floor(j (n - 1) / (k - 1))."""
    w = Window.partitionBy(by)
    rows = rows.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    places = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.floor(j * (F.col("_n") - 1) / F.lit(k - 1)))
    return rows.where(F.array_contains(places, F.col("_i").cast("long"))).drop("_i", "_n")
