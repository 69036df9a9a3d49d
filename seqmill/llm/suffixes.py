"""Exact byte-substring dedup by merging shard Burrows-Wheeler transforms.

1. Every window of ``length`` bytes chooses a winnowed anchor, so equal windows meet under one
   anchor at one offset. Anchors that occur once are dropped.
2. The stretch of windows that chose an anchor is hashed (128 bits with the anchor). Equal
   stretches are one kind, counted before anything is gathered; a kind found twice repeats
   throughout.
3. Where an anchor has several kinds, one stretch of each goes, as bytes and with its count, to
   the anchor's bucket. A bucket's stretches are split into shards, the shards' transforms are
   merged by interleave refinement, and the blocks of common prefixes that this leaves are the
   windows that start at two places.
4. A hot anchor, with more than ``most`` kinds, is no bucket yet: its windows choose longer
   anchors, half of them to the right and half to the left, and steps 1 to 3 are done again with
   these. Each time half as many windows share an anchor, so the last anchors are whole windows.

Buckets are many and bounded: their number follows the bytes to be sorted, and no anchor brings
more than ``most`` kinds of at most 2 * ``length`` bytes.

Defined cases: null or empty text has no bytes; texts under ``length`` bytes stay whole; each row
is a document of its own, with a null doc_id or a repeated one too (rows with the same doc_id and
text have the same spans); an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqmill.llm.anchors import Ranges, winnow
from seqmill.llm.bwt import repeated
from seqmill.llm.common import _RANDOM, chunks, forget, settle, text_bytes

LENGTH = 200
ANCHOR = 96
CHUNK = 1_000_000
BUCKET_BYTES = 2_000_000
MOST_KINDS = 1000
#: A row of the table is (doc_id, tk): tk tells texts apart that share a doc_id, by 64 bits of hash, or by 128 where it is null.
PLACED = "doc_id long, tk binary, start long, end long"


def _rows(docs: DataFrame) -> DataFrame:
    key = F.when(F.col("doc_id").isNull(), F.unhex(F.substring(F.sha2("text", 256), 1, 32))).otherwise(F.unhex(F.lpad(F.hex(F.xxhash64("text")), 16, "0")))
    return docs.select("doc_id", key.alias("tk"), "text")


def _same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["tk"] == b["tk"])


def _packed(lo: np.ndarray, span: np.ndarray, offset: np.ndarray, size: np.ndarray) -> np.ndarray:
    """First window, further windows, the anchor's place from there, and its size, in 64 bits."""
    return (lo << 24) | (span << 16) | (offset << 8) | size


def stretches(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR) -> DataFrame:
    """(a, c, n, doc_id, tk, at): anchor, hash of the stretch, 1, the row, and ``_packed`` place."""
    if not 0 < k <= length < 256:
        raise ValueError("windows have at most 255 bytes, and anchors are no longer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", CHUNK):
                data, offsets = text_bytes(part.column("text"))
                rows = np.repeat(np.arange(part.num_rows, dtype=np.int32), np.diff(offsets))
                ranges = Ranges(_RANDOM[0][data])
                anchor, lo, hi, a = winnow(ranges, rows, length, k)
                c = ranges.of(lo, hi + length) ^ (anchor - lo).astype(np.uint64)
                own = pa.array(rows[lo])
                at = _packed(lo - offsets[rows[lo]], hi - lo, anchor - lo, np.int64(k))
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(c.view(np.int64)), part.column("doc_id").cast(pa.int64()).take(own), part.column("tk").take(own), pa.array(at)], names=["a", "c", "doc_id", "tk", "at"])

    rows = _rows(docs).where(F.octet_length("text") >= length)
    return rows.mapInArrow(run, "a long, c long, doc_id long, tk binary, at long").select("a", "c", F.lit(1).cast("long").alias("n"), "doc_id", "tk", "at")


def _with_texts(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows with the stretches asked of them, as parallel lists."""
    by = asked.groupBy("doc_id", "tk").agg(F.collect_list(F.struct("a", "n", "at")).alias("runs"))
    rows = _rows(docs)
    return rows.join(by, _same_row(rows, by)).select(rows["doc_id"], rows["tk"], "text", "runs")


def _fields(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    runs = part.column("runs")
    owner = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(runs.offsets)))
    flat = runs.flatten()
    a, n, at = (np.asarray(flat.field(f)).astype(np.int64) for f in ("a", "n", "at"))
    return owner, a, n, at


def longer(docs: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """The stretches of hot anchors, each parted in two that share longer anchors; as ``stretches``.

    The windows of a stretch start between the anchor's end less ``length`` and its begin. Those
    of the first half have all bytes from the last of them on in common, those of the second half
    all bytes up to the end of the first of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", CHUNK):
                data, offsets = text_bytes(part.column("text"))
                owner, a, n, at = _fields(part)
                ranges = Ranges(_RANDOM[1][data], 1)
                lo = (at >> 24) + offsets[owner]
                hi, p = lo + ((at >> 16) & 255), lo + ((at >> 8) & 255)
                q = p + (at & 255)
                mid = (q - length + p) >> 1  # the last window of the first half, wherever the stretch begins
                out = []
                for side, (x, y, u, v) in enumerate(((lo, np.minimum(hi, mid), mid, q), (np.maximum(lo, mid + 1), hi, p, mid + 1 + length))):
                    s = np.flatnonzero(x <= y)
                    x, y, u, v = x[s], y[s], u[s], v[s]
                    key = (ranges.of(u, v) ^ np.uint64(side)) * np.uint64(0x9E3779B97F4A7C15) ^ a[s].view(np.uint64)
                    c = ranges.of(x, y + length) ^ (u - x).astype(np.uint64)
                    out.append((key.view(np.int64), c.view(np.int64), n[s], owner[s], _packed(x - offsets[owner[s]], y - x, u - x, v - u)))
                key, c, n, own, at = (np.concatenate(z) for z in zip(*out, strict=True))
                own = pa.array(own)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(c), pa.array(n), part.column("doc_id").take(own), part.column("tk").take(own), pa.array(at)], names=["a", "c", "n", "doc_id", "tk", "at"])

    return _with_texts(docs, asked).mapInArrow(run, "a long, c long, n long, doc_id long, tk binary, at long")


def _kinds(found: DataFrame, length: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Spans of stretches found twice, and a stretch of each kind of the anchors that have several."""
    # Settled, so that a hot anchor's join is plain and adaptive execution may split it.
    met = settle(found.groupBy("a").agg(F.sum("n").alias("t")).where("t > 1").select("a"))
    shared = settle(found.join(met, "a", "left_semi"))
    forget(found, met)
    kinds = shared.groupBy("a", "c").agg(F.sum("n").alias("t"), F.min(F.struct("doc_id", "tk", "at")).alias("one"))
    several = kinds.groupBy("a").agg(F.count("*").alias("kinds"))
    kinds = settle(kinds.join(several, "a").where("t > 1 OR kinds > 1"))
    start = F.shiftright("at", 24)
    end = start + F.shiftright("at", 16).bitwiseAND(255) + length
    twice = shared.where("n = 1").join(kinds.where("t > 1").select("a", "c"), ["a", "c"], "left_semi")
    inside = settle(twice.select("doc_id", "tk", start.alias("start"), end.alias("end")))
    asked = kinds.where("kinds > 1").select("a", F.col("t").alias("n"), "one.*", (F.col("kinds") > most).alias("hot"))
    return inside, asked


def _by_transform(docs: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """Repeated windows within buckets of anchors, from merged transforms."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", CHUNK):
                data, offsets = text_bytes(part.column("text"))
                owner, a, n, at = _fields(part)
                start = (at >> 24) + offsets[owner]
                size = ((at >> 16) & 255) + length
                places = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
                edges = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
                body = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data[places]))])
                own = pa.array(owner)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(n), part.column("doc_id").take(own), part.column("tk").take(own), pa.array(at >> 24), body], names=["a", "n", "doc_id", "tk", "start", "body"])

    def bucket(group: pa.Table) -> pa.Table:
        group = group.sort_by([(c, "ascending") for c in ("a", "doc_id", "tk", "start")])
        which, first, last = repeated(group["body"].to_pylist(), length, np.asarray(group["n"]))
        lone = np.asarray(group["n"])[which] == 1  # the others are spans already
        which, first, last = which[lone], first[lone], last[lone]
        start = np.asarray(group["start"])[which] + first
        return pa.table({"doc_id": group["doc_id"].take(which), "tk": group["tk"].take(which), "start": start, "end": start + last - first + length})

    pieces = settle(_with_texts(docs, asked).mapInArrow(cut, "a long, n long, doc_id long, tk binary, start long, body binary"))
    size = pieces.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    n = max(1, size // BUCKET_BYTES)
    return settle(pieces.groupBy(F.pmod("a", F.lit(n)).alias("bucket")).applyInArrow(bucket, PLACED))


def repeats(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR, most: int = MOST_KINDS) -> DataFrame:
    """(doc_id, tk, start, end): byte spans covered by windows that start at two places or more."""
    found, spans, plain, slack = settle(stretches(docs, length, k)), [], [], length - k
    while True:
        inside, asked = _kinds(found, length, most)
        asked = settle(asked)
        spans.append(inside)
        plain.append(asked.where("NOT hot"))
        hot = asked.where("hot")
        if slack <= 0 or hot.isEmpty():
            break
        found, slack = settle(longer(docs, hot, length)), slack // 2
    asked = plain[0]
    for more in plain[1:]:
        asked = asked.unionByName(more)
    out = _by_transform(docs, asked, length)
    for more in spans:
        out = out.unionByName(more)
    return out


def dedup(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR, most: int = MOST_KINDS) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, spans (maximal removed byte runs), kept (binary)."""
    gone = settle(repeats(docs, length, k, most)).groupBy("doc_id", "tk").agg(F.collect_list(F.struct("start", "end")).alias("gone"))
    rows = _rows(docs)
    rows = rows.join(gone, _same_row(rows, gone), "left").select(rows["doc_id"], "text", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for part in chunks(batch, "text", CHUNK):
                n_bytes, n_removed, merged, kept = [], [], [], []
                runs = part.column("gone")
                lists, flat = np.asarray(runs.offsets), runs.flatten()
                begin, end = (np.asarray(flat.field(f)).astype(np.int64) for f in ("start", "end"))
                lists = lists - lists[0]
                for i, text in enumerate(part.column("text").to_pylist()):
                    data = np.frombuffer((text or "").encode(), np.uint8)
                    x, y = lists[i], lists[i + 1]
                    own: list[dict] = []
                    if y > x:
                        edge = np.zeros(len(data) + 1, np.int64)
                        np.add.at(edge, begin[x:y], 1)
                        np.add.at(edge, end[x:y], -1)
                        out = np.concatenate(([False], np.cumsum(edge)[:-1] > 0, [False]))
                        cuts = np.flatnonzero(out[1:] != out[:-1]).tolist()
                        own = [{"start": p, "end": q} for p, q in zip(cuts[::2], cuts[1::2], strict=True)]
                        n_bytes.append(len(data))
                        data = data[~out[1:-1]]
                    else:
                        n_bytes.append(len(data))
                    n_removed.append(n_bytes[-1] - len(data))
                    merged.append(own)
                    kept.append(data.tobytes())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(merged, span), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns per document."""
    return dedup(docs).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
