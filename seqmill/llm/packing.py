"""Packing of tokenised documents into fixed windows by Karmarkar-Karp multiway differencing.

Documents are tokenised and packed where they are read: a shard is a bounded run of documents
of one input split, so nothing is shuffled and no task holds more than a shard. Full windows
are cut from long documents; the remainders of a shard are partitioned into near-equal
windows, and the window count rises as long as the fullest one exceeds the capacity.

Defined cases: a null or empty text is the end id alone; an empty table gives an empty table;
repeated rows are packed each on its own; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from seqmill.llm.common import chunks

CAPACITY = 2048
#: Documents of a shard hold about this many bytes of text.
SHARD_BYTES = 1_000_000
#: Remainders are cut into items of at most this many ids, so that a window holds several.
ITEM = 512
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, as the tokenizer file defines them.

    The file's vocabulary gives the merge ranks of a faster encoder with the same ids; a text
    that holds one of the file's special tokens, or a run of white space too long for the faster
    encoder's patterns, is left to the file's own tokenizer.
    """

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.tokenizer = Tokenizer.from_file(path)

    def encode(self, text: str) -> bytes:
        if not any(x in text for x in self.special):
            try:
                return array("I", self.fast.encode_ordinary(text)).tobytes()
            except BaseException as e:  # the panic of its regex engine is no Exception
                if type(e).__name__ != "PanicException":
                    raise
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def differencing(sizes: list[int], m: int) -> list[list[int]]:
    """Karmarkar-Karp: indices of ``sizes`` in ``m`` groups of near-equal sum.

    A partial partition keeps only its non-empty groups, largest first. The two of the widest
    spread merge: the largest group of one meets the smallest (maybe empty) of the other.
    """
    heap = [(-s, i, [s], [[i]]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        _, _, sa, ga = heapq.heappop(heap)
        _, _, sb, gb = heapq.heappop(heap)
        over = len(sa) + len(sb) - m
        if over <= 0:
            sums, groups = sa + sb, ga + gb
        else:
            # Smallest `over` groups of a (they stand last) meet the largest... of b in reverse order.
            keep_a, meet_a = len(sa) - over, range(len(sa) - over, len(sa))
            meet_b = range(len(sb) - 1, len(sb) - 1 - over, -1)
            sums = sa[:keep_a] + [sa[i] + sb[j] for i, j in zip(meet_a, meet_b, strict=True)] + sb[: len(sb) - over]
            groups = ga[:keep_a] + [ga[i] + gb[j] for i, j in zip(meet_a, meet_b, strict=True)] + gb[: len(gb) - over]
        order = sorted(range(len(sums)), key=sums.__getitem__, reverse=True)
        sums, groups = [sums[i] for i in order], [groups[i] for i in order]
        spread = sums[0] - (sums[-1] if len(sums) >= m else 0)
        tick += 1
        heapq.heappush(heap, (-spread, tick, sums, groups))
    return heap[0][3] if heap else []


def windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Groups within the capacity; more groups are tried whenever one exceeds it."""
    if not sizes:
        return []
    m = max(1, -(-sum(sizes) // capacity))
    while True:
        groups = differencing(sizes, m)
        over = max(sum(sizes[i] for i in g) for g in groups)
        if over <= capacity:
            return groups
        m += max(1, m // 150)


def pack_shard(lengths: list[int], capacity: int = CAPACITY, item: int = ITEM) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces (document, start, length, window, offset) of a shard, and its number of windows."""
    pieces, items, n = [], [], 0
    for d, length in enumerate(lengths):
        full = length // capacity
        pieces += [(d, k * capacity, capacity, n + k, 0) for k in range(full)]
        n += full
        at, left = full * capacity, length % capacity
        if left:
            parts = -(-left // item)
            for k in range(parts):
                size = left // parts + (k < left % parts)
                items.append((d, at, size))
                at += size
    for g in windows([x[2] for x in items], capacity):
        offset = 0
        for i in sorted(g):
            d, start, size = items[i]
            pieces.append((d, start, size, n, offset))
            offset += size
        n += 1
    return pieces, n


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, shard_bytes: int = SHARD_BYTES, end_id: int = 1) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer`` is the path of a tokenizer file that every executor has; by default that of
    the installed public vocabulary. sequence_id is the input split's number times 2^40 plus a
    counter, so a task that runs again gives the same ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.json")
        encoder, end = Encoder(path), np.array([end_id], "<u4").tobytes()
        base, waiting, held = TaskContext.get().partitionId() << 40, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal base, waiting, held
            docs_ids, coded = [i for x in waiting for i in x[0]], [c for x in waiting for c in x[1]]
            pieces, n = pack_shard([len(c) // 4 for c in coded], capacity)
            d = [p[0] for p in pieces]
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([docs_ids[x] for x in d], pa.int64()),
                    pa.array([p[1] for p in pieces], pa.int64()),
                    pa.array([p[2] for p in pieces], pa.int64()),
                    pa.array([zlib.crc32(coded[p[0]][4 * p[1] : 4 * (p[1] + p[2])]) for p in pieces], pa.int64()),
                    pa.array([len(coded[x]) // 4 for x in d], pa.int64()),
                    pa.array([base + p[3] for p in pieces], pa.int64()),
                    pa.array([p[4] for p in pieces], pa.int64()),
                ],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )
            base, waiting, held = base + n, [], 0
            return out

        for batch in batches:
            for part in chunks(batch, "text", shard_bytes):
                texts = [t or "" for t in part.column("text").to_pylist()]
                waiting.append((part.column("doc_id").to_pylist(), [encoder.encode(t) + end for t in texts]))
                held += sum(map(len, texts))
                if held >= shard_bytes:
                    yield flush()
        if waiting:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
