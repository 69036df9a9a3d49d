"""Benchmark decontamination: an FM-index per shard of training documents.

A shard is a bounded run of whole documents of one input split. Its words become symbols
(words that no test phrase holds share one symbol, and runs of it collapse), the suffixes are
sorted, and the Burrows-Wheeler transform goes into a wavelet matrix with rank counts. All
test phrases are searched backwards at once; occurrences are located by walking to sampled
suffix positions, and their word spans are merged. Documents are never shuffled.

Only the phrases travel to the executors. Their size is checked: a benchmark beyond
``block_bytes`` is gathered and searched block by block, and the spans united.

Defined cases: null or wordless text has no hits; wordless items and items without an id are
never found; empty tables give no hits; repeated rows are judged each on its own; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqmill.llm.common import chunks, named, settle, span_hashes, spans, text_bytes

WIDTH = 13
#: A document is contaminated if at least one word in RATIO is hit.
RATIO = 20
SHARD_BYTES = 2_000_000
SAMPLE = 8
KEYS = ["doc_id", "t1", "t2"]
FOUND = ", n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def hashed_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of a string column (A-Z folded) and the row of each."""
    data, offsets = text_bytes(column)
    data = _LOWER[data]
    starts, ends, rows = spans(_WORD[data], offsets)
    return span_hashes(data, starts, ends), rows


class Phrases:
    """Distinct windows of the items: symbols by window, and the items of each window."""

    def __init__(self, ids: list[str], texts: list[str], width: int = WIDTH) -> None:
        words, rows = hashed_words(pa.array(texts, pa.string()))
        self.vocabulary = np.unique(words)
        symbols = np.searchsorted(self.vocabulary, words) + 2
        found: dict[bytes, set[str]] = {}
        bounds = np.searchsorted(rows, np.arange(len(texts) + 1))
        for item, a, b in zip(ids, bounds[:-1], bounds[1:], strict=True):
            n = min(width, b - a)
            for i in range(a, b - n + 1 if n else a):
                found.setdefault(symbols[i : i + n].astype(np.int32).tobytes(), set()).add(item)
        self.windows = [np.frombuffer(k, np.int32) for k in found]
        self.items = [sorted(v) for v in found.values()]
        self.length = np.array([len(w) for w in self.windows], np.int64)
        self.matrix = np.zeros((len(found), width), np.int32)
        for i, w in enumerate(self.windows):
            self.matrix[i, width - len(w) :] = w


def suffix_array(s: np.ndarray, sigma: int) -> np.ndarray:
    """All suffixes in order. The first sort packs several symbols; later rounds double the
    sorted depth and touch only suffixes that still tie."""
    n = len(s)
    bits = max(1, int(sigma).bit_length())
    depth = max(1, 62 // bits)
    key, padded = np.zeros(n, np.int64), np.concatenate((s.astype(np.int64) + 1, np.zeros(depth, np.int64)))
    for j in range(depth):
        key = (key << bits) | padded[j : j + n]
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.concatenate(([True], k[1:] != k[:-1]))
    group = np.flatnonzero(new)[np.cumsum(new) - 1]
    rank = np.empty(n, np.int64)
    rank[order] = group
    tied = ~(new & np.concatenate((new[1:], [True])))
    at = np.flatnonzero(tied)
    while len(at):
        own = order[at]
        follow = own + depth
        second = np.where(follow < n, rank[np.minimum(follow, n - 1)] + 1, 0)
        key = rank[own] * (n + 1) + second
        by = np.argsort(key, kind="stable")
        own, key = own[by], key[by]
        order[at] = own
        new = np.concatenate(([True], key[1:] != key[:-1]))
        rank[own] = at[np.flatnonzero(new)][np.cumsum(new) - 1]
        at = at[~(new & np.concatenate((new[1:], [True])))]
        depth *= 2
    return order


class FMIndex:
    """Wavelet-matrix FM-index of a symbol sequence; queries are vectors."""

    def __init__(self, s: np.ndarray, sigma: int, sample: int = SAMPLE) -> None:
        s = np.concatenate((s, [0]))
        sa = suffix_array(s, sigma)
        self.n, self.bwt = len(s), s[sa - 1]
        self.less = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=sigma))))
        self.levels, rest = [], self.bwt
        for b in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            bit = (rest >> b) & 1
            ones = np.concatenate(([0], np.cumsum(bit, dtype=np.int32)))
            self.levels.append((b, ones, self.n - int(ones[-1])))
            rest = np.concatenate((rest[bit == 0], rest[bit == 1]))
        marked = sa % sample == 0
        self.marks, self.places = np.concatenate(([0], np.cumsum(marked, dtype=np.int32))), sa[marked]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of the symbols in the transform before the positions."""
        start = np.zeros_like(at)
        for b, ones, zeros in self.levels:
            bit = (symbol >> b) & 1
            o_at, o_start = ones[at], ones[start]
            at, start = np.where(bit, zeros + o_at, at - o_at), np.where(bit, zeros + o_start, start - o_start)
        return at - start

    def search(self, matrix: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of right-aligned phrases."""
        lo, hi = np.zeros(len(matrix), np.int64), np.full(len(matrix), self.n, np.int64)
        for j in range(matrix.shape[1]):
            live = np.flatnonzero((length > j) & (lo < hi))
            if not len(live):
                break
            c = matrix[live, matrix.shape[1] - 1 - j].astype(np.int64)
            lo[live], hi[live] = self.less[c] + self.rank(c, lo[live]), self.less[c] + self.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by steps back to a sampled one."""
        out, steps, live = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows))
        rows = rows.copy()
        while len(live):
            r = rows[live]
            marked = self.marks[r + 1] > self.marks[r]
            done = live[marked]
            out[done] = self.places[self.marks[rows[done]]] + steps[done]
            live = live[~marked]
            c = self.bwt[rows[live]].astype(np.int64)
            rows[live] = self.less[c] + self.rank(c, rows[live])
            steps[live] += 1
        return out


def occurrences(words: np.ndarray, rows: np.ndarray, n_rows: int, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(word position, window) of every occurrence of a window in the documents of a shard."""
    none = np.zeros(0, np.int64)
    if not len(words) or not len(phrases.vocabulary):
        return none, none
    at = np.minimum(np.searchsorted(phrases.vocabulary, words), len(phrases.vocabulary) - 1)
    symbols = np.where(phrases.vocabulary[at] == words, at + 2, 1)
    # 1 stands for a run of foreign words or the edge of a document: no phrase can cross it.
    cut = np.flatnonzero(np.diff(rows)) + 1
    symbols, place = np.insert(symbols, cut, 1), np.insert(np.arange(len(words)), cut, -1)
    stays = ~((symbols == 1) & np.concatenate(([False], symbols[:-1] == 1)))
    symbols, place = symbols[stays], place[stays]
    index = FMIndex(symbols, len(phrases.vocabulary) + 2)
    lo, hi = index.search(phrases.matrix, phrases.length)
    found = np.flatnonzero(hi > lo)
    count = hi[found] - lo[found]
    which = np.repeat(found, count)
    suffixes = np.repeat(lo[found] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
    return place[index.locate(suffixes)], which


def judge(column: pa.Array, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, list[list[str]], list[list[dict]]]:
    """Per document: words, hit words, items found (sorted as strings), merged spans."""
    n = len(column)
    words, rows = hashed_words(column)
    at, which = occurrences(words, rows, n, phrases)
    n_words = np.bincount(rows, minlength=n)
    items: list[list[str]] = [[] for _ in range(n)]
    merged: list[list[dict]] = [[] for _ in range(n)]
    if not len(at):
        return n_words, np.zeros(n, np.int64), items, merged
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + phrases.length[which], -1)
    hit = np.cumsum(edge)[:-1] > 0
    first = np.concatenate(([0], np.cumsum(n_words)))
    for d, w in sorted({(int(d), int(w)) for d, w in zip(rows[at], which, strict=True)}):
        items[d] += phrases.items[w]
    begins = np.flatnonzero(hit & ~(np.concatenate(([False], hit[:-1])) & np.concatenate(([False], rows[1:] == rows[:-1]))))
    ends = np.flatnonzero(hit & ~(np.concatenate((hit[1:], [False])) & np.concatenate((rows[1:] == rows[:-1], [False])))) + 1
    for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
        d = int(rows[a])
        merged[d].append({"start": a - int(first[d]), "end": b - int(first[d])})
    return n_words, np.bincount(rows[hit], minlength=n), [sorted(set(x)) for x in items], merged


def phrase_blocks(benchmark: DataFrame, block_bytes: int) -> tuple[int, Callable[[int], Phrases]]:
    """Number of blocks of about ``block_bytes`` of test text, and what gathers one of them."""
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string").alias("id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))

    def block(i: int) -> Phrases:
        rows = (items.where(F.pmod(F.xxhash64("id"), F.lit(n)) == i) if n > 1 else items).collect()  # one block of the benchmark, never documents
        return Phrases([r.id for r in rows], [r.text for r in rows])

    return n, block


def _keys(doc_id: Column, text: Column) -> list[Column]:
    """128 bits of the text tell rows apart that share a doc_id; rows alike have the same results."""
    return [doc_id.alias("doc_id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), text).alias("t2")]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*_keys(F.col("doc_id"), F.col("text")), "text")


def _judged(rows: DataFrame, phrases: Phrases, shard_bytes: int, keys: list[str]) -> DataFrame:
    """``keys``, n_words, n_hit, items, spans of each row, searched for one block of phrases."""
    held = rows.sparkSession.sparkContext.broadcast(phrases)  # one block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for part in chunks(batch, "text", shard_bytes):
                n_words, n_hit, items, merged = judge(part.column("text"), held.value)
                own = [part.column(k).cast(pa.int64()) for k in keys]
                yield pa.RecordBatch.from_arrays([*own, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(merged, span)], names=[*keys, "n_words", "n_hit", "items", "spans"])

    return rows.select(*keys, "text").mapInArrow(run, ", ".join(f"{k} long" for k in keys) + FOUND)


def _united(rows: DataFrame, n: int, block: Callable[[int], Phrases], shard_bytes: int) -> DataFrame:
    """Keys, n_words, items and merged spans of the rows with hits, over all blocks."""
    hits = [settle(_judged(rows, block(i), shard_bytes, KEYS).where("n_hit > 0").distinct()) for i in range(n)]
    united = reduce(DataFrame.unionAll, hits).groupBy(*KEYS, "n_words")
    united = united.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"))
    merge = (
        "aggregate(s, cast(array() as array<struct<start:int,end:int>>), (acc, x) -> CASE WHEN size(acc) > 0 AND element_at(acc, -1).end >= x.start "
        "THEN concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, x.end)))) ELSE concat(acc, array(x)) END)"
    )
    united = united.withColumn("spans", F.expr(merge)).withColumn("n_hit", F.expr("aggregate(spans, 0L, (n, x) -> n + x.end - x.start)"))
    return united.select(*[F.col(c).alias(f"_{c}") for c in (*KEYS, "n_words", "n_hit", "items", "spans")])


def _same(a: DataFrame, b: DataFrame) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[f"_{k}"]) for k in KEYS])


def find(docs: DataFrame, benchmark: DataFrame, shard_bytes: int = SHARD_BYTES, block_bytes: int = 32_000_000) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, items (sorted), spans (merged word spans).

    A benchmark of several blocks is gathered, broadcast and searched block by block; only rows
    with hits are kept of a block, and united by row at the end.
    """
    n, block = phrase_blocks(benchmark, block_bytes)
    if n == 1:
        return _judged(docs, block(0), shard_bytes, ["doc_id"])
    rows = _keyed(docs)
    united, counted = _united(rows, n, block, shard_bytes), _judged(rows, Phrases([], []), shard_bytes, KEYS)
    out = counted.join(united, _same(counted, united), "left")
    return out.select("doc_id", "n_words", *[F.coalesce(f"_{c}", c).alias(c) for c in ("n_hit", "items", "spans")])


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns per document."""
    out = find(docs, benchmark)
    joined = F.array_join("items", ",")
    bad = (F.col("n_hit") > 0) & (RATIO * F.col("n_hit") >= F.col("n_words"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(joined.cast("binary"), 256).alias("items_sha256"), bad.alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, shard_bytes: int = SHARD_BYTES, block_bytes: int = 32_000_000) -> DataFrame:
    """Pipeline form: the rows that aren't contaminated, whole and with their own columns."""
    n, block = phrase_blocks(benchmark, block_bytes)
    if n > 1:
        names = docs.columns
        rows = docs.select(F.struct(*map(named, names)).alias("doc"), *_keys(named("doc_id"), named("text")))
        united = _united(_keyed(docs), n, block, shard_bytes).where(f"{RATIO} * _n_hit >= _n_words")
        return rows.join(united, _same(rows, united), "left_anti").select(*[F.col("doc").getField(c).alias(c) for c in names])
    held = docs.sparkSession.sparkContext.broadcast(block(0))
    text = f"c{docs.columns.index('text')}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text, shard_bytes):
                n_words, n_hit, _, _ = judge(part.column(text), held.value)
                yield part.filter(pa.array(~((n_hit > 0) & (RATIO * n_hit >= n_words))))

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # Arrow takes no names with dots
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
