"""Helpers shared by the corpus operators: scratch tables in the shared
checkpoint folder, per-row keys and Arrow batch plumbing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

# words are runs of anything but ASCII white space (fixed value)
WORD_SPACE = r"[\x20\x09-\x0D]+"
BATCH_BYTES = 2 << 20     # text handled at once inside a task


# shuffle files go when the query that made them ends, not when the driver's memory fills
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_RECORDS: list[list[str]] = []      # scratch paths made, of each open recording()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the session's shared checkpoint folder, removed when
    the application ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    for record in _RECORDS:
        record.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back, so
    that several readers don't recompute it and lost executors can't undo it. The
    shuffles behind it have no further reader and are freed at once."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch = path
    return table


def discard(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Deletes tables of :func:`materialize`, or their paths, after their last reader
    has been written itself."""
    for table in tables:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(table if isinstance(table, str) else table.scratch)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


@contextmanager
def recording() -> Iterator[list[str]]:
    """The scratch paths that are made meanwhile."""
    record: list[str] = []
    _RECORDS.append(record)
    try:
        yield record
    finally:
        _RECORDS[:] = [r for r in _RECORDS if r is not record]


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """What is written meanwhile hands texts to Python tasks ``rows`` at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


REMEMBERED: list[Callable[[], None]] = []      # each empties what a worker keeps between tasks


def let_go() -> None:
    """A worker that turns to an operator with large arrays of its own forgets what
    earlier operators kept in it."""
    for forget in REMEMBERED:
        forget()
    pa.default_memory_pool().release_unused()


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          *extra: Column) -> DataFrame:
    """``(_row, doc_id, text)`` of every input row: ``_row`` is unique per row,
    so repeated or null ids stay separate documents; null text is empty."""
    return docs.select(F.monotonically_increasing_id().alias("_row"),
                       F.col(id_col).cast("bigint").alias("doc_id"),
                       text_or_empty(text_col).alias("text"), *extra)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text",
           size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into pieces of about ``size`` bytes of ``column``
    (at least one row each), which bounds the memory of what follows."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        first, held = 0, 0
        for i in range(n):
            held += int(lengths[i])
            if held >= size or i - first >= 4095:
                yield batch.slice(first, i + 1 - first)
                first, held = i + 1, 0
        if first < n:
            yield batch.slice(first)


def record_batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c := columns[f.name], (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type)
         for f in schema], schema=schema)
