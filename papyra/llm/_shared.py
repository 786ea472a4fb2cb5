"""What the operators share: the cluster's shared folder, tables written there, Arrow helpers."""

from __future__ import annotations

import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of (key, id) that may be broadcast; beyond it the same join shuffles.
BROADCAST_ROWS = 400_000
#: Rows of an Arrow batch of texts, and bytes where operators follow each other in the same executors: larger buffers than
#: the allocator's chunks (4 MB) come from the C library, which keeps them when they are freed.
BATCH_ROWS, BATCH_BYTES = 2000, 1 << 20


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; only where that is unset and Spark is local (tests) below a temporary one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("papyra.own.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="papyra-")
            spark.conf.set("papyra.own.checkpoint.dir", base)
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/papyra-{name}-{uuid.uuid4().hex}"


_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables made inside are deleted when the block ends, but those made with outlives=True; what is lazy and reads them must be written by then."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.pop()
        drop_tables(spark, made)


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def table(df: DataFrame, name: str, outlives: bool = False) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts lineage, survives lost executors, and gives Catalyst real sizes.

    Inside scratch() the table goes with the block, or with the block around it if it outlives.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    if len(_scopes) > outlives:
        _scopes[-1 - outlives].append(path)
    return spark.read.schema(df.schema).parquet(path)


def maybe_broadcast(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Marks df for broadcast only if its counted rows are under the limit; otherwise Spark shuffles."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows <= limit else df


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of fewer rows: texts may be long, and both the JVM and the worker hold a batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def light_batches(spark: SparkSession) -> None:
    """small_batches that also end at BATCH_BYTES, so that long texts make no larger buffers; a row is never cut."""
    small_batches(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    given = spark.conf.get(name, "64m")
    if given.startswith("-") or spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(given) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def text_or_empty(df: DataFrame, col: str) -> Column:
    """The text column for an operator, nulls as empty texts."""
    small_batches(df.sparkSession)
    return F.coalesce(df[col].cast("string"), F.lit(""))


def pieces(batches: Iterator[pa.RecordBatch], column: str, chars: int = 8_000_000) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Cuts record batches into runs of rows with about so many bytes of text, with the texts of each run; only these are Python objects."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(texts):
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + chars, "right")))
            yield batch.slice(start, stop - start), texts.slice(start, stop - start).to_pylist()
            start = stop


_kept: dict = {}


def kept(key, make: Callable):
    """What a worker keeps between tasks, such as a tokenizer and its cache: of one key at a time, so that operators don't add up."""
    if key not in _kept:
        if _kept:
            _kept.clear()
            give_back()
        _kept[key] = make()
    return _kept[key]


def give_back() -> None:
    """Returns memory that is free in this worker to the system: workers live on between stages, and the C library and Arrow keep it else."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def remove_own_dir(spark: SparkSession) -> None:
    """Deletes the folder that shared_dir made where none was set."""
    base = spark.conf.get("papyra.own.checkpoint.dir", None)
    if base:
        shutil.rmtree(base, ignore_errors=True)
        spark.conf.unset("papyra.own.checkpoint.dir")
