"""What the text operators share: reading, settled intermediate tables, and bounded Arrow chunks."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java regex classes of the contracts: runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
#: The six ASCII white-space characters, fixed by the contracts.
SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where that is unset in local mode (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^,]*(,[^,]*)?\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    Cuts the lineage (lost executors recompute nothing before this point), and lets Spark
    drop the shuffle files behind it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/settled-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    out = spark.read.parquet(path)
    out._settled = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete settled tables early; all that was made of them must be settled by then."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._settled)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def strip_chars(text: Column, chars: tuple[str, ...] | list[str]) -> Column:
    """``text`` without any of ``chars``; plain byte searches, no regex."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def named(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def words_of(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def chunks(batch: pa.RecordBatch, column: str = "text", most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about ``most`` bytes, so that NumPy scratch space stays bounded."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64)
    part = np.cumsum(sizes) // most
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n+1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pa.concat_arrays([pa.compute.fill_null(column.cast(pa.large_string()), "")])
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0 or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


_RANDOM = np.random.default_rng(20240229).integers(0, 2**63, size=(2, 256), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.array([0x9E3779B97F4A7C15, 0xD1342543DE82EF95], dtype=np.uint64)
_SEED = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, which: int = 0) -> np.ndarray:
    out = np.full(n, _BASE[which], dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def spans(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of word bytes, which never cross a row, and the row of each run."""
    n = len(is_word)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True  # the end of the last row may be marked; it is cut below
    before = np.concatenate(([False], is_word[:-1]))
    starts = np.flatnonzero(is_word & (~before | first[:n]))
    after = np.concatenate((is_word[1:], [False]))
    ends = np.flatnonzero(is_word & (~after | first[1 : n + 1])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hash of each run of bytes (runs ascend and don't overlap); ``which`` chooses one of two families.

    A run is read in blocks of 8 bytes, the last filled up with zeros. Every block is mixed with its
    place before the blocks are added up, so no pattern of bytes cancels out as it does in a polynomial.
    """
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    length = ends - starts
    n = (length + 7) >> 3
    first = np.cumsum(n) - n
    place = np.arange(int(n.sum())) - np.repeat(first, n)
    at = np.repeat(starts, n) + 8 * place
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    block = np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1))[at].copy().view("<u8").ravel()
    missing = 8 * np.maximum(8 - (np.repeat(ends, n) - at), 0).astype(np.uint64)
    block = (block << missing) >> missing
    value = mix(mix(block * _BASE[which] + _SEED[which]) + (place.astype(np.uint64) + np.uint64(1)) * _BASE[1 - which])
    return mix(np.add.reduceat(value, first) + length.astype(np.uint64) * _SEED[which])


def rolling(h: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hash of each ``k`` consecutive values; entry i covers i..i+k-1, so there are k-1 fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    pw = powers(k + 1, which)
    for j in range(k):
        out += h[j : j + n] * pw[j + 1]
    return mix(out)


def leftmost_min(h: np.ndarray, w: int) -> np.ndarray:
    """Index of the leftmost smallest of each ``w`` consecutive values."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, span = np.arange(len(h)), 1
    while span < w:
        step = min(span, w - span)
        a, b = best[:-step], best[step:]
        best = np.where(h[b] < h[a], b, a)
        span += step
    return best[:n]
