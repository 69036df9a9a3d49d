"""Substring dedup by seed and extend over winnowed word anchors.

Seeds: every window of ``length`` words chooses one k-gram anchor; documents meet on anchors.
Each seed is joined to one partner, the smallest document that has it, so no group gives all pairs:

1. An anchor that only one document has is dropped (smallest and largest doc_id are equal).
2. The whole stretch that chose the anchor is hashed. Where a smaller document has the same
   stretch, it is the partner for all its windows: the inside of long matches.
3. Where an anchor's stretches differ, the ends of matches lie. One stretch of each kind is cut
   into its windows, and each window's partner is the smallest document of the other kinds with it.

A seed and its partner's place give a diagonal. Seeds of one partner that touch on one diagonal are
extended both ways into one maximal match (``matches``); a match ends where the words differ or
where the seeds of another partner take over. The words of all matches go, as maximal spans. Anchors and
stretches or windows are compared together, as 128 bits; words are not compared one by one.

Defined cases: null, empty or short text has no window and stays whole; rows that share a
doc_id are the same document and must have the same text; a null doc_id meets no other and
stays whole; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqmill.llm.anchors import Ranges, winnow
from seqmill.llm.common import chunks, forget, settle, span_hashes, spans, text_bytes

LENGTH = 13
ANCHOR = 5
CHUNK = 1_500_000
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = text_bytes(column)
    starts, ends, rows = spans(~_SPACE[data], offsets)
    n = np.bincount(rows, minlength=len(column))
    return data, starts, ends, rows, np.concatenate(([0], np.cumsum(n)))


def stretches(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR) -> DataFrame:
    """(a, c, doc_id, at): anchor, hash of the stretch, and first window * 256 + further windows."""
    if not 0 < k <= length < k + 256:
        raise ValueError("a window has at most 255 words more than its anchor")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", CHUNK):
                data, starts, ends, rows, first = _words(part.column("text"))
                ids = part.column("doc_id").cast(pa.int64())
                ranges = Ranges(span_hashes(data, starts, ends))
                anchor, lo, hi, a = winnow(ranges, rows, length, k)
                c = ranges.of(lo, hi + length) ^ (anchor - lo).astype(np.uint64)
                own = rows[lo]
                at = ((lo - first[own]) << 8) | (hi - lo)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(c.view(np.int64)), ids.take(pa.array(own)), pa.array(at)], names=["a", "c", "doc_id", "at"])

    return docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(run, "a long, c long, doc_id long, at long")


def _windows(docs: DataFrame, runs: DataFrame, length: int) -> DataFrame:
    """(a, w, doc_id, start): the windows of the given stretches, hashed by the second family."""
    asked = runs.groupBy("doc_id").agg(F.collect_list(F.struct("a", "at")).alias("runs"))
    rows = docs.select("doc_id", "text").join(asked, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", CHUNK):
                data, starts, ends, rows, first = _words(part.column("text"))
                ranges = Ranges(span_hashes(data, starts, ends, 1), 1)
                runs = part.column("runs")
                owner = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(runs.offsets)))
                flat = runs.flatten()
                a, at = (np.asarray(flat.field(f)).astype(np.int64) for f in ("a", "at"))
                count = (at & 255) + 1
                each = np.repeat(np.arange(len(at)), count)
                start = (at >> 8)[each] + np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
                w = ranges.of(first[owner[each]] + start, first[owner[each]] + start + length)
                ids = part.column("doc_id").take(pa.array(owner[each]))
                yield pa.RecordBatch.from_arrays([pa.array(a[each]), pa.array(w.view(np.int64)), ids, pa.array(start)], names=["a", "w", "doc_id", "start"])

    return rows.mapInArrow(run, "a long, w long, doc_id long, start long")


def repeats(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR) -> DataFrame:
    """(doc_id, start, end, other, other_start): seeds, each with the smallest doc_id that has it and its first place there."""
    found = settle(stretches(docs, length, k))  # the texts are cut and hashed once
    # Settled, so that a hot anchor's join is plain and adaptive execution may split it.
    met = settle(found.groupBy("a").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x < y").select("a"))
    shared = settle(found.join(met, "a", "left_semi"))
    forget(found, met)
    kinds = shared.groupBy("a", "c").agg(F.min(F.struct("doc_id", "at")).alias("first")).select("a", "c", F.col("first.doc_id").alias("first"), F.shiftright("first.at", 8).alias("first_start"))
    several = kinds.groupBy("a").agg(F.count("*").alias("kinds"))
    kinds = settle(kinds.join(several, "a"))
    placed = settle(shared.join(kinds, ["a", "c"]).where("doc_id > first OR kinds > 1"))
    start = F.shiftright("at", 8)
    inside = placed.where("doc_id > first").select("doc_id", start.alias("start"), (start + F.col("at").bitwiseAND(255) + length).alias("end"), F.col("first").alias("other"), F.col("first_start").alias("other_start"))
    ends = settle(_windows(docs, placed.where("doc_id = first AND kinds > 1").select("a", "at", "doc_id"), length))
    least = ends.groupBy("a", "w").agg(F.min(F.struct("doc_id", "start")).alias("x"), F.max("doc_id").alias("y")).where("x.doc_id < y")
    least = least.select("a", "w", F.col("x.doc_id").alias("other"), F.col("x.start").alias("other_start"))
    at_ends = ends.join(least, ["a", "w"]).where("doc_id > other").select("doc_id", "start", (F.col("start") + length).alias("end"), "other", "other_start")
    return inside.unionByName(at_ends)


def extend(row: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, other_start: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same five columns with one entry for each maximal match: seeds that touch on one diagonal of one partner."""
    if len(row) == 0:
        return row, start, end, other, other_start
    diagonal = start - other_start
    order = np.lexsort((start, diagonal, other, row))
    row, start, end, other, diagonal = row[order], start[order], end[order], other[order], diagonal[order]
    apart = np.ones(len(row), bool)
    apart[1:] = (row[1:] != row[:-1]) | (other[1:] != other[:-1]) | (diagonal[1:] != diagonal[:-1])
    lift = np.cumsum(apart) * (end.max() + 1)  # the furthest end so far starts anew on each diagonal
    reach = np.maximum.accumulate(end + lift) - lift
    apart[1:] |= start[1:] > reach[:-1]
    first = np.flatnonzero(apart)
    last = np.concatenate((first[1:], [len(row)])) - 1
    return row[first], start[first], reach[last], other[first], start[first] - diagonal[first]


def dedup(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, spans (maximal removed word spans), matches (maximal repeats and where they stand in a smaller doc_id), text (kept words)."""
    gone = settle(repeats(docs, length, k)).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "other", "other_start")).alias("gone"))
    rows = docs.select("doc_id", "text").join(gone, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        places = ["start", "end", "other", "other_start"]
        for batch in batches:
            for part in chunks(batch, "text", CHUNK):
                n_words, n_removed, merged, kept = [], [], [], []
                runs = part.column("gone")
                owner, flat = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(runs.offsets))), runs.flatten()
                owner, *match = extend(owner, *(np.asarray(flat.field(f)).astype(np.int64) for f in places))
                begin, end = match[:2]
                lists = np.searchsorted(owner, np.arange(part.num_rows + 1))
                matches = pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in match], places))
                for i, text in enumerate(part.column("text").to_pylist()):
                    w = (text or "").encode().split()
                    own: list[dict] = []
                    x, y = lists[i], lists[i + 1]
                    if y > x:
                        edge = np.zeros(len(w) + 1, np.int64)
                        np.add.at(edge, begin[x:y], 1)
                        np.add.at(edge, end[x:y], -1)
                        out = np.concatenate(([False], np.cumsum(edge)[:-1] > 0, [False]))
                        cuts = np.flatnonzero(out[1:] != out[:-1]).tolist()
                        own = [{"start": p, "end": q} for p, q in zip(cuts[::2], cuts[1::2], strict=True)]
                    n_words.append(len(w))
                    n_removed.append(sum(s["end"] - s["start"] for s in own))
                    for s in reversed(own):
                        del w[s["start"] : s["end"]]
                    merged.append(own)
                    kept.append(b" ".join(w).decode())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(merged, span), matches, pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "spans", "matches", "text"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, matches array<struct<start:long,end:long,other:long,other_start:long>>, text string")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns per document."""
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
