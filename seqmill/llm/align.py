"""Alignment of two tokenizers by byte ranges: groups of tokens that cover the same bytes, and corpus-wide links.

A text is cut at single spaces between two characters that are no white space. Both tokenizers
end a token there whatever stands around (the byte-level pattern never joins a space to what
comes before it, and no piece holds a space mark after another character, which is checked), so
a segment's tokens depend on the segment alone and each distinct segment is encoded once in a
task. Within the segments a static interval index over the B tokens is stabbed by bisection with
each A token's byte range; the gaps that no token of either side spans end the groups.

Link counts are pre-aggregated per document. Pairs that hold at least one ``SHARE``-th of all
links (so at most ``SHARE`` pairs) are looked up by a broadcast; all others by a join, in which no
key can be hot any more.

Defined cases: a null or empty text, or one whose joined token bytes are not the space and the
text (B reads U+2581 as a space), has no tokens: zeros and an empty groups_sha256; repeated rows
each count and are each returned; a null doc_id is kept; other columns are ignored, whatever
their names; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqmill.llm.common import chunks, settle

#: Pairs with one part in so many of all links are broadcast: at most this many rows.
SHARE = 131_072
#: Segments are remembered until there are so many, or until they hold so many characters.
MEMORY = (300_000, 6_000_000)
#: New segments are encoded together, up to so many characters at once.
BLOCK = 100_000
#: Bytes of text that are looked at together.
CHUNK = 1_000_000
_CUT = re.compile(r"(?<=\S) (?=\S)")
SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<struct<a:int,b:int,n:int>>"


class IntervalIndex:
    """A static index of ascending disjoint intervals; a stabbing query takes two bisections."""

    def __init__(self, starts: np.ndarray, ends: np.ndarray) -> None:
        self.starts, self.ends = starts, ends

    def stab(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and one past the last interval that overlaps each query."""
        return np.searchsorted(self.ends, starts, "right"), np.searchsorted(self.starts, ends, "left")


def within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... anew for every count."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


class Aligner:
    """Both tokenizers, and what is known of the segments met so far: counts, links and groups."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [x for x in range(256) if x not in printable]
        byte_of = {chr(x): x for x in printable} | {chr(256 + i): x for i, x in enumerate(hidden)}
        self.a_bytes = [b""] * (1 + max(self.a.get_vocab().values()))
        for t, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.ids = max(len(self.a_bytes), len(pieces))
        self.spelled = [f"{i}{sign}" for sign in ",|;\n" for i in range(self.ids)]
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = spec["normalizer"] is None and (spec["pre_tokenizer"] or {}).get("type") == "ByteLevel" and spec["pre_tokenizer"].get("use_regex")
        self.cuttable = bool(plain) and not any("▁" in p.lstrip("▁") for p in pieces)
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.held, self.unlike, self.written = 0, set(), []
        self.counts, self.links, self.starts = np.zeros((0, 4), np.int64), np.zeros((0, 2), np.int32), np.zeros(1, np.int64)

    def segments(self, text: str) -> list[str]:
        if not text or not self.cuttable:
            return [text] if text else []
        words = text.split(" ")
        return words if words == text.split() else _CUT.split(text)

    def learn(self, new: list[str]) -> None:
        """Encode and align new segments: those without white space at their ends in long texts, the others one by one."""
        blocks: list[list[str]] = []
        room = 0
        for s in new:
            alone = not self.cuttable or s[0].isspace() or s[-1].isspace() or "▁" in s
            if alone or room < len(s):
                room = 0 if alone else BLOCK
                blocks.append([])
            blocks[-1].append(s)
            room -= len(s)
        counts, links = [self.counts], [self.links]
        while blocks:
            block = blocks.pop()
            got = self.aligned(block)
            if got is None and len(block) > 1:
                blocks += [[s] for s in block]
                continue
            self.at.update(zip(block, range(len(self.written), len(self.written) + len(block)), strict=True))
            self.held += sum(map(len, block))
            if got is None:
                self.unlike.update(block)
                got = np.zeros((1, 4), np.int64), np.zeros((0, 2), np.int32), [""]
            counts.append(got[0])
            links.append(got[1])
            self.written += got[2]
        self.counts, self.links = np.concatenate(counts), np.concatenate(links)
        self.starts = np.concatenate(([0], np.cumsum(self.counts[:, 3])))

    def aligned(self, block: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]] | None:
        """(counts, links, groups as text) of segments that follow each other; None unless the token bytes are the text's."""
        text = " ".join(block)
        a, b = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, self.b.encode(text)
        want = b" " + text.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != want or b"".join(map(self.b_bytes.__getitem__, b)) != want:
            return None
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        a_starts, b_starts = a_ends - self.a_sizes[a], b_ends - self.b_sizes[b]
        ends = np.cumsum([len(s.encode()) + 1 for s in block])
        if not (np.isin(ends, a_ends).all() and np.isin(ends, b_ends).all()):
            return None
        first, last = IntervalIndex(b_starts, b_ends).stab(a_starts, a_ends)
        opens = np.concatenate(([True], first[1:] >= last[:-1]))  # no B token spans the gap before
        a_group = np.cumsum(opens) - 1
        b_opens = np.zeros(len(b), bool)
        b_opens[first[opens]] = True
        b_group = np.cumsum(b_opens) - 1
        n = last - first
        links = np.column_stack((np.repeat(a, n), b[np.repeat(first, n) + within(n)])).astype(np.int32)
        at = lambda starts: np.searchsorted(ends, starts, "right")
        a_at, b_at = at(a_starts), at(b_starts)
        count = lambda where, weights=None: np.bincount(where, weights, minlength=len(block)).astype(np.int64)
        counts = np.column_stack((count(a_at), count(b_at), count(a_at[opens]), count(a_at, n)))
        # Each id with the sign after it: , within a side, | after A's side, ; after a group, a line's end after a segment.
        a_sizes, b_sizes = np.bincount(a_group), np.bincount(b_group)
        coded = np.zeros(len(a) + len(b), np.int64)
        a_sign = np.append(opens[1:], True).astype(np.int64)
        b_sign = 2 * np.append(b_opens[1:], True) + np.append(b_at[1:] != b_at[:-1], True)
        coded[np.arange(len(a)) + (np.cumsum(b_sizes) - b_sizes)[a_group]] = a + a_sign * self.ids
        coded[np.arange(len(b)) + np.cumsum(a_sizes)[b_group]] = b + b_sign * self.ids
        return counts, links, "".join(map(self.spelled.__getitem__, coded.tolist())).splitlines()

    def places(self, texts: list[str | None]) -> tuple[list[list[str]], list[bool]]:
        """Segments of each text, all of them known now, and whether the text has tokens."""
        if len(self.at) > MEMORY[0] or self.held > MEMORY[1]:
            self.forget()
        rows = [self.segments(t or "") for t in texts]
        new = set(chain.from_iterable(rows)).difference(self.at)
        if new:
            self.learn(sorted(new))
        return rows, [bool(r) and self.unlike.isdisjoint(r) for r in rows]

    def digest(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """(four counts by text, groups_sha256 by text, links (a, b, times), where each text's links begin)."""
        rows, whole = self.places(texts)
        rows = [r if ok else [] for r, ok in zip(rows, whole, strict=True)]
        flat = np.fromiter(map(self.at.__getitem__, chain.from_iterable(rows)), np.int64)
        n = len(texts)
        row = np.repeat(np.arange(n), list(map(len, rows)))
        counts = np.column_stack([np.bincount(row, self.counts[flat, k], minlength=n).astype(np.int64) for k in range(4)])
        spelled, ends = list(map(self.written.__getitem__, flat.tolist())), np.cumsum(list(map(len, rows))).tolist()
        shas = [hashlib.sha256(";".join(spelled[i:j]).encode()).hexdigest() if j > i else "" for i, j in zip([0, *ends], ends)]
        key, times = np.unique(row * max(1, len(self.written)) + flat, return_counts=True)
        row, seg = np.divmod(key, max(1, len(self.written)))
        size = self.counts[seg, 3]
        pick = np.repeat(self.starts[seg], size) + within(size)
        row, times, pair = np.repeat(row, size), np.repeat(times, size), (self.links[pick, 0].astype(np.int64) << 32) | self.links[pick, 1]
        order = np.lexsort((pair, row))
        row, times, pair = row[order], times[order], pair[order]
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(row)), bool), (row[1:] != row[:-1]) | (pair[1:] != pair[:-1]))))
        times = np.add.reduceat(times, first) if len(first) else times
        row, pair = row[first], pair[first]
        return counts, shas, np.column_stack((pair >> 32, pair & 0xFFFFFFFF, times)), np.searchsorted(row, np.arange(n + 1))


def paths(a: str | None, b: str | None) -> tuple[str, str]:
    if a is None or b is None:
        import public_tokenizers

        a, b = a or public_tokenizers.path("byte_bpe_50k.json"), b or public_tokenizers.path("piece_bpe_32k.model")
    return a, b


def encoded(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and the distinct linked pairs (a, b, n) of every document.

    ``a`` and ``b`` are paths of tokenizer files that every executor has; by default the installed ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*paths(a, b))
        for batch in batches:
            for part in chunks(batch, "text", CHUNK):
                counts, shas, links, starts = aligner.digest(part.column("text").to_pylist())
                pairs = pa.StructArray.from_arrays([pa.array(links[:, k].astype(np.int32)) for k in range(3)], ["a", "b", "n"])
                columns = [*[pa.array(counts[:, k]) for k in range(4)], pa.array(shas, pa.string())]
                lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pairs)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *columns, lists], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def groups(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """(doc_id, group, a_ids, b_ids): the aligned groups of every document in order, from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*paths(a, b))
        for batch in batches:
            for part in chunks(batch, "text", CHUNK):
                texts, ids = part.column("text").to_pylist(), part.column("doc_id").to_pylist()
                rows, whole = aligner.places(texts)
                ids_of = lambda side: [int(x) for x in side.split(",")]
                spelled = ((d, ";".join(aligner.written[aligner.at[s]] for s in r)) for d, r, ok in zip(ids, rows, whole, strict=True) if ok)
                got = [(d, i, *map(ids_of, g.split("|"))) for d, text in spelled for i, g in enumerate(text.split(";"))]
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], kind) for k, kind in enumerate(kinds)], names=["doc_id", "group", "a_ids", "b_ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, group long, a_ids array<int>, b_ids array<int>")


def pair_counts(coded: DataFrame) -> DataFrame:
    """(a, b, count, is_best) over all documents: is_best where no other A token is linked to that B token more often."""
    counts = settle(coded.select(F.inline("pairs")).groupBy("a", "b").agg(F.sum("n").alias("count")))
    best = counts.groupBy("b").agg(F.max("count").alias("_best"))
    return counts.join(F.broadcast(best), "b").select("a", "b", "count", (F.col("count") == F.col("_best")).alias("is_best"))  # a row per id of B


def digest(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    coded = settle(encoded(docs, a, b).withColumn("row", F.monotonically_increasing_id()))
    counts = pair_counts(coded)
    total = coded.agg(F.sum("n_links")).first()[0] or 0
    often = F.col("count") * SHARE >= total
    sums = F.sum(F.col("n") * F.col("count")).alias("count_sum"), F.sum(F.when(F.col("is_best"), F.col("n")).otherwise(0)).alias("n_best")
    links = coded.select("row", F.inline("pairs")).join(F.broadcast(counts.where(often)), ["a", "b"], "left")
    known = links.where(F.col("count").isNotNull()).groupBy("row").agg(*sums)
    rare = links.where(F.col("count").isNull()).select("row", "a", "b", "n").join(counts.where(~often), ["a", "b"]).groupBy("row").agg(*sums)
    both = known.unionByName(rare).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return coded.drop("pairs").join(both, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
