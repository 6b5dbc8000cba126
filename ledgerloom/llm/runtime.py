"""Shared folder for intermediate tables, table loading and Arrow batch helpers."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Intermediate tables of one operator call, written to the shared folder. A written
    table cuts the lineage and survives lost executors; a repeated task writes it anew.
    What a result still reads stays until the session ends, and is deleted then."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/ledgerloom-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.base)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def usual_length(vectors: DataFrame, vector_col: str) -> int:
    """The most frequent length of a table's vectors, the larger one of equally frequent; 0 without any.
    A vector of another length lacks components or has stray ones."""
    most = vectors.select(F.size(vector_col).alias("size")).where("size > 0").groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).head()
    return most["size"] if most else 0


def crc32_of(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string"))


#: Bytes of text that an Arrow-side helper works on at a time.
SLICE_BYTES = 3 << 20


def slices(batches, text_at: int = 1, limit: int = SLICE_BYTES):
    """Cuts record batches so that each has about `limit` bytes of text; one row at least."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        ends = np.cumsum(lengths(batch.column(text_at)))
        start = 0
        while start < n:
            done = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def lengths(column: pa.Array) -> np.ndarray:
    """UTF-8 bytes of each value; 0 for nulls."""
    return np.diff(text_buffer(column)[1])


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


_held: dict = {}


def worker_cache(key, make):
    """What a worker keeps between tasks under `key`, made by make(). A worker keeps one such thing
    at a time: of operators that run one after the other in a session, only the last holds memory."""
    if key not in _held:
        _held.clear()
        pa.default_memory_pool().release_unused()
        _held[key] = make()
    return _held[key]


def segment_ids(sizes: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(sizes)), sizes)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indexes start, start+1, ... of every segment, one after the other."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(total)
