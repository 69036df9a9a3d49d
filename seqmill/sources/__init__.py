"""Sources and sinks: text CSV, CSV directories with keys in their paths, labelled matrices, JSON, array files, fixed headers."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_text_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV with every declared column as text; blanks are null."""
    return spark.read.csv(path, header=True, schema=", ".join(f"`{c}` string" for c in columns), nullValue="")


def read_set_directory(spark: SparkSession, root: str, columns: list[str]) -> DataFrame:
    """``*/set*.csv`` below ``root`` with match_name (folder) and set_id (file name)."""
    rows = spark.read.csv(f"{root}/*/set*.csv", header=True, schema=", ".join(f"`{c}` string" for c in columns), nullValue="")
    path = F.col("_metadata.file_path")
    number = F.regexp_extract(path, r"/set(\d+)\.csv$", 1)
    number = F.when(number != "", number.cast("int")).otherwise(F.raise_error(F.concat(F.lit("no set number in "), path)))
    return rows.select("*", F.url_decode(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)).alias("match_name"), number.alias("set_id"))


def write_columns(df: DataFrame, path: str, columns: list[str], fmt: str = "parquet") -> None:
    """Fixed header: extra columns are dropped, absent ones are null."""
    have = set(df.columns)
    out = df.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in columns])
    out.write.mode("overwrite").options(header=True).format(fmt).save(path)


def read_matrix(spark: SparkSession, path: str, labels: list[str], row: str = "cur", column: str = "nxt", value: str = "value") -> DataFrame:
    """A CSV matrix with row labels in its first column, in long form; blank cells have no row."""
    wide = spark.read.csv(path, header=True, schema="`_row` string, " + ", ".join(f"`{c}` double" for c in labels), nullValue="")
    return wide.unpivot("_row", [f"`{c}`" for c in labels], column, value).withColumnRenamed("_row", row).where(F.col(value).isNotNull())


def write_matrix(cells: DataFrame, path: str, labels: list[str], row: str = "cur", column: str = "nxt", value: str = "value") -> None:
    """Long cells as one CSV matrix over a fixed vocabulary, in its order; absent cells are zero."""
    wide = cells.groupBy(row).agg(*[F.coalesce(F.sum(F.when(F.col(column) == c, F.col(value))), F.lit(0.0)).alias(c) for c in labels])
    order = cells.sparkSession.createDataFrame([(i, c) for i, c in enumerate(labels)], f"_i int, `{row}` string")
    out = F.broadcast(order).join(wide, row, "left").fillna(0.0, labels)  # a vocabulary by itself
    out.coalesce(1).sortWithinPartitions("_i").select(row, *labels).write.mode("overwrite").csv(path, header=True)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents or lines with a declared schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; nulls are written, so that every row has every field."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_partitioned(df: DataFrame, path: str, *keys: str) -> None:
    """Parquet with a folder per key value; rows of a value come together first, so a folder has few files."""
    df.repartition(*keys).write.mode("overwrite").partitionBy(*keys).parquet(path)


def read_classes(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Files of ``root/class/file``: path, label (the folder) and length, without their bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(f"{root}/*/*").select("path", "length")
    return files.withColumn("label", F.url_decode(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)))


def _array_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            loaded = np.load(io.BytesIO(content), allow_pickle=False)
            named = loaded.items() if isinstance(loaded, np.lib.npyio.NpzFile) else [("", loaded)]
            for name, a in named:
                a = np.atleast_1d(a)
                for low in range(0, len(a), 1024):
                    part = a[low : low + 1024]
                    values = list(part.reshape(len(part), -1).astype("float64"))
                    yield pd.DataFrame({"path": path, "name": name, "row_index": np.arange(low, low + len(part)), "shape": [list(a.shape[1:])] * len(part), "values": values})


def read_arrays(spark: SparkSession, path: str, pattern: str = "*.np[yz]") -> DataFrame:
    """NPY and NPZ files as rows of their first axis: path, name (in an NPZ), row_index, shape of a row, its values flat.

    A task holds one file, so large tensors should come as many files; Spark refuses one over 2 GB.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    return files.mapInPandas(_array_rows, "path string, name string, row_index long, shape array<long>, values array<double>")


def checked_arrays(df: DataFrame, column: str, length: int) -> DataFrame:
    """``df`` whose arrays all have ``length`` finite values; any other raises when it is read."""
    c = F.col(column)
    ok = (F.size(c) == length) & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return df.withColumn(column, F.when(c.isNotNull() & ok, c).otherwise(F.raise_error(F.lit(f"{column}: not {length} finite values"))))


def file_inventory(spark: SparkSession, path: str, pattern: str = "*", hashed_below: int = 1 << 30) -> DataFrame:
    """(path, length, modified, sha256): every file below ``path``; only those under ``hashed_below`` bytes are read and hashed."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    facts = F.col("path"), F.col("length"), F.col("modificationTime").alias("modified")
    small = files.where(F.col("length") < hashed_below).select(*facts, F.sha2("content", 256).alias("sha256"))
    return small.unionByName(files.where(F.col("length") >= hashed_below).select(*facts, F.lit(None).cast("string").alias("sha256")))
