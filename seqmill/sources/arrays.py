"""NPY files as a data source that plans row ranges from the headers and reads each where it lies.

``spark.dataSource.register(NpyRows)``, then ``spark.read.format("npy_rows").load(folder)`` gives
(file, row_index, values). A partition is a range of rows of one file, of about ``bytesPerPartition``,
read by seeking to it: no task holds a file, and a filter on row_index or file prunes ranges
before they are read (with ``spark.sql.python.filterPushdown.enabled``). Paths are of a file
system that driver and executors mount alike.

Rows are along the first axis; further axes are flattened in C order. Files must be in C order, of
a real or integer type of at most 64 bits (a null never occurs; NaN stays). A file of shape (0, ...)
has no rows; one without axes, or with pickled objects, raises when it is planned.
"""

from __future__ import annotations

import glob
import json
import math
import os
import shutil
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)

SCHEMA = "file string, row_index long, values array<double>"
MANIFEST = "_manifest.json"
BYTES = 16_000_000
#: Bytes of values in one Arrow batch.
BATCH = 2_000_000


@dataclass(frozen=True)
class Header:
    shape: tuple[int, ...]
    dtype: np.dtype
    offset: int

    @property
    def width(self) -> int:
        return math.prod(self.shape[1:])


def header(path: str) -> Header:
    """Shape, type and where the values begin; reads no value."""
    with open(path, "rb") as f:
        version = np.lib.format.read_magic(f)
        read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}.get(version)
        if read is None:
            raise ValueError(f"{path}: unknown version {version}")
        shape, fortran, dtype = read(f)
        if not shape or dtype.kind not in "fiub" or dtype.itemsize > 8 or (fortran and len(shape) > 1):
            raise ValueError(f"{path}: needs rows of numbers in C order, not {dtype} {shape}")
        found = Header(shape, dtype, f.tell())
    if os.path.getsize(path) < found.offset + shape[0] * found.width * dtype.itemsize:
        raise ValueError(f"{path}: shorter than its header says")
    return found


def manifest(path: str) -> list[dict] | None:
    """The files that were committed to a folder (file, n_rows, width), or None where nothing was written by commit."""
    try:
        with open(f"{path}/{MANIFEST}", encoding="utf-8") as f:
            return json.load(f)["files"]
    except (FileNotFoundError, NotADirectoryError):
        return None


@dataclass
class Rows(InputPartition):
    path: str
    start: int
    stop: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, bytes_: int) -> None:
        listed = manifest(path)
        self.files = sorted(glob.glob(f"{path}/*.npy")) if os.path.isdir(path) else sorted(glob.glob(path))
        if listed is not None:
            self.files = [f"{path}/{f['file']}" for f in listed]
        if not self.files and listed is None:
            raise FileNotFoundError(path)
        self.bytes, self.low, self.high, self.names = bytes_, 0, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            match f:
                case EqualTo(("row_index",), v):
                    self.narrow(v, v + 1)
                case GreaterThan(("row_index",), v):
                    self.narrow(v + 1, None)
                case GreaterThanOrEqual(("row_index",), v):
                    self.narrow(v, None)
                case LessThan(("row_index",), v):
                    self.narrow(0, v)
                case LessThanOrEqual(("row_index",), v):
                    self.narrow(0, v + 1)
                case EqualTo(("file",), v):
                    self.names = {v} if self.names is None else self.names & {v}
                case In(("file",), vs):
                    self.names = set(vs) if self.names is None else self.names & set(vs)
            yield f  # ranges are pruned; Spark still checks every row

    def narrow(self, low: int, high: int | None) -> None:
        self.low = max(self.low, low)
        self.high = high if self.high is None else self.high if high is None else min(self.high, high)

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in self.files:
            if self.names is not None and os.path.basename(path) not in self.names:
                continue
            h = header(path)
            each = max(1, self.bytes // max(1, h.width * h.dtype.itemsize))
            low, high = self.low, h.shape[0] if self.high is None else min(self.high, h.shape[0])
            out += [Rows(path, i, min(i + each, high)) for i in range(low, high, each)]
        return out or [Rows("", 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if partition.start >= partition.stop:
            return
        h = header(partition.path)
        name, size = os.path.basename(partition.path), h.width * h.dtype.itemsize
        each = max(1, BATCH // max(1, 8 * h.width))
        with open(partition.path, "rb") as f:
            f.seek(h.offset + partition.start * size)
            for at in range(partition.start, partition.stop, each):
                n = min(each, partition.stop - at)
                flat = np.frombuffer(f.read(n * size), h.dtype).astype(np.float64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * h.width), pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(at, at + n)), lists], names=["file", "row_index", "values"])


@dataclass
class Written(WriterCommitMessage):
    file: str
    n_rows: int
    width: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, width: int | None, overwrite: bool) -> None:
        self.path, self.width, self.overwrite = path, width, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(self.path, exist_ok=True)
        name = f"part-{uuid.uuid4().hex}"
        body, made, n, width = f"{self.path}/.{name}.body", f"{self.path}/.{name}.npy", 0, self.width
        try:
            with open(body, "wb") as f:
                for batch in iterator:
                    lists = batch.column("values")
                    sizes = set(pc.list_value_length(lists).to_pylist())
                    width = next(iter(sizes), 0) if width is None and sizes else width
                    flat = lists.flatten()
                    if sizes - {width} or flat.null_count or not np.isfinite(values := np.asarray(flat, np.float64)).all():
                        raise ValueError(f"every row needs {width} finite values; found lengths {sorted(sizes, key=str)[:5]}")
                    f.write(values.tobytes())
                    n += batch.num_rows
            with open(made, "wb") as f, open(body, "rb") as values:
                np.lib.format.write_array_header_1_0(f, {"descr": "<f8", "fortran_order": False, "shape": (n, width or 0)})
                shutil.copyfileobj(values, f)
            if n:
                os.replace(made, f"{self.path}/{name}.npy")
        finally:
            for x in (body, made):
                if os.path.exists(x):
                    os.remove(x)
        return Written(f"{name}.npy", n, width or 0)

    def commit(self, messages: list[Written | None]) -> None:
        new = [m for m in messages if m is not None and m.n_rows]
        old = manifest(self.path) or []
        kept = [] if self.overwrite else old
        widths = {f["width"] for f in kept} | {m.width for m in new}
        if len(widths) > 1:
            self.abort(messages)
            raise ValueError(f"rows of different widths: {sorted(widths)}")
        for m in new:
            if header(f"{self.path}/{m.file}").shape != (m.n_rows, m.width):
                raise ValueError(f"{m.file} is not what its task wrote")
        files = kept + sorted(({"file": m.file, "n_rows": m.n_rows, "width": m.width} for m in new), key=lambda f: f["file"])
        os.makedirs(self.path, exist_ok=True)
        with open(f"{self.path}/.{MANIFEST}", "w", encoding="utf-8") as f:
            json.dump({"files": files}, f)
        os.replace(f"{self.path}/.{MANIFEST}", f"{self.path}/{MANIFEST}")
        for f in old if self.overwrite else []:
            if os.path.exists(x := f"{self.path}/{f['file']}"):
                os.remove(x)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m is not None and os.path.exists(x := f"{self.path}/{m.file}"):
                os.remove(x)


class NpyRows(DataSource):
    """Options: ``path`` (a folder, a file or a pattern), ``bytesPerPartition``, and for writes ``width``.

    Tasks write parts of a column ``values`` (arrays of one width, finite); the driver commits a
    manifest when all are there, and a folder with a manifest is what the manifest lists. So a
    task that is lost, or a job that fails, leaves nothing that is read. Overwriting replaces the
    manifest first and removes the old parts after.
    """

    @classmethod
    def name(cls) -> str:
        return "npy_rows"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("bytesPerPartition", BYTES)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        width = self.options.get("width")
        return _Writer(self.options["path"], int(width) if width else None, overwrite)


def scan_npy(spark: SparkSession, path: str, bytes_per_partition: int = BYTES) -> DataFrame:
    """(file, row_index, values) of the NPY files of a folder, or of a pattern."""
    spark.dataSource.register(NpyRows)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("npy_rows").option("bytesPerPartition", str(bytes_per_partition)).load(path)


def write_npy(rows: DataFrame, path: str, width: int | None = None, mode: str = "append") -> None:
    """Write the column ``values`` of ``rows`` as NPY parts below ``path``; ``width`` is checked, or that of the rows themselves."""
    rows.sparkSession.dataSource.register(NpyRows)
    out = rows.select(F.col("values").cast("array<double>").alias("values")).write.format("npy_rows").mode(mode)
    (out.option("width", str(width)) if width else out).save(path)


def npy_shapes(spark: SparkSession, path: str) -> DataFrame:
    """(file, dtype, shape, n_rows) from the headers alone; a row for each file."""
    files = _Reader(path, BYTES).files
    rows = [(os.path.basename(p), str(h.dtype), list(h.shape), h.shape[0]) for p in files for h in [header(p)]]
    return spark.createDataFrame(rows, "file string, dtype string, shape array<long>, n_rows long")


def gathered(rows: DataFrame, arrays: DataFrame, index: str, file: str = "file", values: str = "values") -> DataFrame:
    """``rows`` with the values of the array row that (file, index) names; null, and in_range false, where there is none."""
    right = arrays.select(F.col("file").alias("_f"), F.col("row_index").alias("_i"), F.col("values").alias(values))
    out = rows.join(right, (F.col(file) == F.col("_f")) & (F.col(index) == F.col("_i")), "left")
    return out.withColumn("in_range", F.col("_i").isNotNull()).drop("_f", "_i")
