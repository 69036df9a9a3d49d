"""Near-duplicate documents by bottom-k sketches of one hash function.

1. Every document keeps the k smallest hash values of its shingles, of two words in the query
   and of five in the pipeline. A shorter text is one shingle. Equal shingle sets form a class; only class representatives (smallest doc_id) go on.
2. Inverted lists: each three neighbouring retained values of a sketch are one list key. At a
   similarity of 0.8 or more, two sketches of 64 share no such run with a probability under
   1e-10. Sets of up to 40 values use runs of two, which two such sets always share.
3. Keys that only one sketch has go. Every representative first meets the list leader (most
   shared keys) it shares most keys with. Then only pairs of one list that are still in different
   components are compared, and only if the parities of 1024 bins of their full sets, which bound
   the difference of two sets exactly, allow a link. So a large group of near copies costs a star,
   not all of its pairs.
4. The union sketch of a pair estimates the similarity and drops hopeless pairs (a true link is
   lost with a probability under 1e-7); the full shingle sets confirm the rest exactly.

Defined cases: a text without words (or null) has an empty set and links with nothing; rows
that share a doc_id are one document; a null doc_id is its own group; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqmill.llm.common import chunks, mix, rolling, settle, span_hashes, spans, text_bytes
from seqmill.llm.graph import components

K = 64
#: Words of a shingle in the pipeline.
WIDTH = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Union-sketch estimates under this drop a pair: far below the threshold for K values.
FLOOR = 0.5
_LOWER = bytes([b + 32 if 65 <= b < 91 else b for b in range(256)])
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: Bits of a set's parities are kept in so many words of 64.
PARITY = 16
ODD = [f"o{i}" for i in range(PARITY)]
SKETCH = "doc_id long, n long, s1 long, s2 long, sketch array<long>, " + ", ".join(f"{o} long" for o in ODD)


def shingles(text: str | None, width: int = 2) -> set[tuple[bytes, ...]]:
    """The exact shingle set of a text."""
    w = (text or "").encode().translate(_LOWER).split()
    return set(zip(*[w[i:] for i in range(width)], strict=False)) if len(w) >= width else {tuple(w)} - {()}


def sketches(docs: DataFrame, width: int = 2, k: int = K) -> DataFrame:
    """Per document: doc_id, n (distinct shingles), s1 and s2 (hash of the whole set), sketch, o0...

    The o columns hold the parity of the number of values in each of 1024 bins.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower = np.frombuffer(_LOWER, np.uint8)
        for batch in batches:
            for part in chunks(batch, "text", 2_000_000):
                size = part.num_rows
                data, offsets = text_bytes(part.column("text"))
                data = lower[data]
                starts, ends, rows = spans(~_SPACE[data], offsets)
                words = span_hashes(data, starts, ends)
                count = np.bincount(rows, minlength=size)
                grams = rolling(words, width)
                inside = rows[: len(grams)] == rows[len(rows) - len(grams) :]
                lone = np.flatnonzero((count > 0) & (count < width))
                first = np.cumsum(count) - count
                extra = [mix(rolling(words[first[d] : first[d] + count[d]], int(count[d])) + np.uint64(count[d])) for d in lone.tolist()]
                values = np.concatenate([grams[inside], *extra]) >> np.uint64(1)
                owner = np.concatenate([rows[: len(grams)][inside], lone])
                by = np.lexsort((values, owner))
                values, owner = values[by].astype(np.int64), owner[by]
                fresh = np.ones(len(values), bool)
                fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
                values, owner = values[fresh], owner[fresh]
                n = np.bincount(owner, minlength=size)
                begin = np.concatenate(([0], np.cumsum(n)))
                sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(values.astype(np.uint64) ^ np.uint64(c)), dtype=np.uint64))) for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
                s1, s2 = (pa.array((x[begin[1:]] - x[begin[:-1]]).astype(np.int64)) for x in sums)
                taken = (np.arange(len(values)) - begin[owner]) < k
                at = np.concatenate(([0], np.cumsum(np.minimum(n, k)))).astype(np.int32)
                sketch = pa.ListArray.from_arrays(pa.array(at), pa.array(values[taken]))
                word = owner * PARITY + (values >> (63 - 4))  # ascends, as values do
                odd = np.zeros(size * PARITY, np.int64)
                if len(word):
                    runs = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
                    odd[word[runs]] = np.bitwise_xor.reduceat(np.int64(1) << (values & 63), runs)
                odd = [pa.array(np.ascontiguousarray(o)) for o in odd.reshape(size, PARITY).T]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(n.astype(np.int64)), s1, s2, sketch, *odd], names=["doc_id", "n", "s1", "s2", "sketch", *ODD])

    return docs.select("doc_id", "text").mapInArrow(run, SKETCH)


def list_keys(reps: DataFrame) -> DataFrame:
    """(key, rep): a row for each three neighbouring retained values (two in small sets).

    Two whole sets that are similar enough always share a run of two: their union of u values has
    at least 0.8 u in common, parted in at most 0.2 u places. Linked sets differ in size by a
    quarter at most, so sets of 30 to 40 values, which may meet either kind, have both.
    """
    run = lambda w: F.when(F.size("sketch") >= w, F.transform(F.sequence(F.lit(0), F.size("sketch") - w), lambda i: F.xxhash64(F.lit(w), *[F.get("sketch", i + j) for j in range(w)])))
    none = F.array().cast("array<bigint>")
    pairs, triples = F.when(F.col("n") <= 40, run(2)), F.when(F.col("n") >= 30, run(3))
    return reps.select(F.explode(F.concat(F.coalesce(pairs, none), F.coalesce(triples, none))).alias("key"), "rep")


def shared_lists(reps: DataFrame) -> DataFrame:
    """(key, rep, order): lists of two representatives or more; ``order`` is smallest for the one with most shared keys.

    Most keys are nowhere else; they go before anything else is carried. The text that a family of
    near copies was made from shares all its keys, so it leads their lists.
    """
    keys = list_keys(reps)
    met = keys.groupBy("key").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x < y").select("key")
    lists = settle(keys.join(met, "key", "left_semi"))
    degree = lists.groupBy("rep").agg(F.count("*").alias("degree"))
    return settle(lists.join(degree, "rep").select("key", "rep", F.struct((-F.col("degree")).alias("d"), "rep").alias("order")))


def estimated(pairs: DataFrame, reps: DataFrame, k: int = K, floor: float = FLOOR) -> DataFrame:
    """Pairs (a, b) whose sizes allow a link and whose union sketch doesn't rule it out."""
    side = lambda x: reps.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sk_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.where((100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")))
    both = both.withColumn("u", F.slice(F.array_sort(F.array_union("sk_a", "sk_b")), 1, k))
    shared = F.size(F.array_intersect("u", F.array_intersect("sk_a", "sk_b")))
    return both.where(shared >= floor * F.size("u")).select("a", "b")


def confirmed(pairs: DataFrame, docs: DataFrame, width: int = 2, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) whose full shingle sets are similar enough.

    Only texts of documents in some pair are gathered; each pair row then carries its two texts.
    """
    pairs = settle(pairs)
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    texts = settle(docs.select("doc_id", "text").join(ids, "doc_id", "left_semi"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = object(), set()
        for batch in batches:
            good = []
            for a, t, u in zip(*(batch.column(c).to_pylist() for c in ("a", "ta", "tb")), strict=True):
                if (a, t) != last:
                    last, own = (a, t), shingles(t, width)
                other = shingles(u, width)
                both = len(own & other)
                good.append(bool(both) and 100 * both >= percent * (len(own) + len(other) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    side = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"t{x}"))
    return settle(pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long").distinct())


def groups(docs: DataFrame, width: int = 2, k: int = K) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable)."""
    base = settle(sketches(docs, width, k))
    classes = settle(base.where("n > 0 AND doc_id IS NOT NULL").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep")))
    reps = base.join(classes.select("s1", "s2", "n", F.col("rep").alias("doc_id")), ["s1", "s2", "n", "doc_id"], "left_semi")
    reps = settle(reps.select(F.col("doc_id").alias("rep"), "n", "sketch", *ODD))
    lists = shared_lists(reps)
    leaders = lists.groupBy("key").agg(F.min("order").alias("a")).select("key", F.col("a.rep").alias("a"))
    met = lists.join(leaders, "key").where("rep != a").groupBy("a", F.col("rep").alias("b")).agg(F.count("*").alias("c"))
    best = met.groupBy("b").agg(F.max(F.struct("c", -F.col("a"))).alias("m")).select((-F.col("m.col2")).alias("a"), "b")
    links = confirmed(estimated(best, reps, k), docs, width)
    labels = components(links)

    # Pairs of one list that the stars leave in different components.
    placed = lists.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").select("key", "rep", F.coalesce("label", "rep").alias("comp"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("key")
    placed = settle(placed.join(mixed, "key", "left_semi"))
    # Parities of bins part two sets in no more bins than they have different values, and a
    # link allows a ninth of both sizes: an exact bound, so close families yield few pairs.
    placed = placed.join(reps.select("rep", "n", *ODD), "rep")
    x, y = (placed.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("rep", "n", "comp", *ODD)]) for s in "ab")
    apart = sum((F.bit_count(F.col(f"{o}_a").bitwiseXOR(F.col(f"{o}_b"))) for o in ODD[1:]), F.bit_count(F.col("o0_a").bitwiseXOR(F.col("o0_b"))))
    alike = (100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")) & ((100 + PERCENT) * apart <= (100 - PERCENT) * (F.col("n_a") + F.col("n_b")))
    cross = x.join(y, "key").where((F.col("rep_a") < F.col("rep_b")) & (F.col("comp_a") != F.col("comp_b")) & alike)
    cross = cross.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).distinct()
    more = confirmed(estimated(cross, reps, k), docs, width)
    labels = components(links.unionByName(more))

    own = base.select("doc_id", "n", "s1", "s2").join(classes, ["s1", "s2", "n"], "left")
    own = own.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left")
    return own.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "rep", "doc_id").alias("component_id"))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns per document."""
    return groups(docs).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def clean(docs: DataFrame) -> DataFrame:
    """Pipeline form: one document of each group of five-word shingles (the smallest doc_id), whole."""
    gone = groups(docs, WIDTH).where("doc_id != component_id").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
