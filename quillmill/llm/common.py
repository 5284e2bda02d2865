"""Shared plumbing of the training-data operators: shared storage, Arrow batches, safe column handling."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a folder of our own only where the cluster names none."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.quillmill.shared.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="quillmill-")
        spark.conf.set("spark.quillmill.shared.dir", found)
    return found


def materialize(df: DataFrame, name: str = "t", large: bool = True) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts lineage, survives lost executors.

    After a large step the driver collects its garbage, so that Spark removes the shuffle files of the step that is over; they would else stay until it happens to.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if large:
        spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    if _open:
        _open[-1].append(out)
    return out


_open: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """What is materialized within is deleted at the end, but for what `keep` names."""
    _open.append([])
    try:
        yield
    finally:
        discard(*_open.pop())


def keep(df: DataFrame) -> DataFrame:
    _open[-1].remove(df)
    return df


def discard(*steps: DataFrame | None) -> None:
    """Delete what `materialize` wrote for these; only for steps that nothing unwritten reads any more."""
    for df in steps:
        path = getattr(df, "_written", None)
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Arrow batches of texts stay small, so that Python workers do."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def lean(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f for mapInArrow, whose worker gives free memory back at the end of a task: workers wait for the next one, beside others, with what they hold."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(it)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # glibc only
                ctypes.CDLL(None).malloc_trim(0)

    return run


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    have = {c.lower() for c in df.columns}
    while name in have:
        name = "_" + name
    return name


def row_hash(doc_id: str = "doc_id", text: str = "text"):
    """A 64-bit id of a row's doc_id and text: rows that share a doc_id are told apart by it."""
    return F.xxhash64(F.col(doc_id).cast("long"), F.col(text))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def text_buffer(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the row offsets into them; a null row is empty."""
    if pa.types.is_large_string(arr.type):
        kind, arr = np.int64, arr
    else:
        kind, arr = np.int32, arr.cast(pa.string())
    if arr.null_count:
        arr = arr.fill_null("")
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = arr.buffers()
    off = np.frombuffer(offs, kind)[arr.offset : arr.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def pieces(arr: pa.Array, max_bytes: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column that hold about max_bytes each (one row at least)."""
    _, off = text_buffer(arr)
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + max_bytes, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def squeezed(texts: pa.Array) -> pa.Array:
    """Each text compressed: a third less than what a shuffle's own compression leaves of texts."""
    z = zstandard.ZstdCompressor(level=3)
    return pa.array([None if x is None else z.compress(x.encode()) for x in texts.to_pylist()], pa.binary())


def unsqueezed(packed: pa.Array) -> pa.Array:
    z = zstandard.ZstdDecompressor()
    return pa.array([None if x is None else z.decompress(x) for x in packed.to_pylist()], pa.binary()).cast(pa.string())


def batches(out: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) if not isinstance(out[f.name], pa.Array) else out[f.name] for f in schema], schema=schema)


def crc_mod(col: str, m: int = 5):
    """crc32 of the id's decimal text, modulo m."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % m


def empty_like(schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([], f.type) for f in schema], schema=schema)
