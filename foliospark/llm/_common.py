"""Helpers that the operators of this subpackage share: table access, scratch tables, text chunks.

Scratch tables live in the folder that the session names in ``spark.checkpoint.dir``
(shared by the driver and all executors), so a lost executor costs a re-read and
never a lost result.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.session import work_dir

#: Bytes of text that a Python worker holds as one chunk.
CHUNK_BYTES = 4 << 20
#: Rows in a batch between Spark and a Python worker, unless the session asks for fewer: texts and sets are long rows.
BATCH_ROWS = 1000
#: Bytes in such a batch, unless the session asks for fewer.
BATCH_BYTES = 8 << 20
#: Rows that the Parquet reader holds at a time, unless the session asks for fewer.
READ_ROWS = 256
#: Short rows (ids, links, list entries) that are worth a file of their own.
FILE_ROWS = 50_000
_BATCH, _BATCH_BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
_READ = "spark.sql.parquet.columnarReaderBatchSize"
#: Pages of few long rows are cut as soon as they are full, not first after 100 rows.
_PAGES = {"parquet.page.size.row.check.min": "1"}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's batch sizes, so that a worker, the Parquet reader and the executor's direct memory hold a few megabytes of rows at a time."""
    if int(spark.conf.get(_BATCH)) > BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    spark.conf.set(_BATCH_BYTES, str(BATCH_BYTES))
    if int(spark.conf.get(_READ)) > READ_ROWS:
        spark.conf.set(_READ, str(READ_ROWS))


class Scratch:
    """Tables written to the shared folder to cut lineage; ``drop`` removes one that nothing reads any more."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        bound_batches(spark)
        self.root = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._paths: dict[int, str] = {}
        self._count = 0

    def write(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """Materialise ``df``; its shuffle files go as soon as the table is written. Of a table of at most ``rows`` short rows no more files are made than these fill."""
        df = df if rows is None else df.coalesce(rows // FILE_ROWS + 1)
        path = f"{self.root}/{self._count:02d}-{name}"
        self._count += 1
        before = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.options(**_PAGES).parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(_CLEANUP)
            else:
                self.spark.conf.set(_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = self._paths.pop(id(df), None)
            if path is None:
                continue
            jvm = self.spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            with contextlib.suppress(Exception):  # left-over files cost disk, never a result
                target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def doc_text(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, ``text`` (null: empty) and the columns in ``more``; whatever else the table has is pruned."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def chunks(batches: Iterator[pa.RecordBatch], max_bytes: int = CHUNK_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each slice holds about ``max_bytes`` of text, one row at least."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(column)
        width = 4 if pa.types.is_string(col.type) or pa.types.is_binary(col.type) else 8
        kind = np.int32 if width == 4 else np.int64
        ends = np.frombuffer(col.buffers()[1], kind, count=n + 1, offset=col.offset * width).astype(np.int64)
        start = 0
        while start < n:
            stop = int(np.searchsorted(ends, ends[start] + max_bytes, side="right")) - 1
            stop = min(n, max(stop, start + 1))
            yield batch.slice(start, stop - start)
            start = stop
    trim()


def trim() -> None:
    """Give freed memory back to the system: Python workers are reused, and what one operator needed at its peak would stay with them."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def freed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, whose worker gives memory back when the task's rows are through and its arrays are gone."""

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return task


def tokenizer_file(path: str) -> str:
    """The file, or where this machine keeps it elsewhere, the public file of the same name; workers ask for themselves."""
    if os.path.exists(path):
        return path
    import public_tokenizers

    return public_tokenizers.path(os.path.basename(path))


def byte_list(col: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column without decoding them."""
    return col.cast(pa.binary() if pa.types.is_string(col.type) else pa.large_binary()).to_pylist()


#: Rows of ids (tens of bytes each) that may be broadcast; a larger side is shuffled.
BROADCAST_ROWS = 1_000_000


def checked_side(df: DataFrame, weight: str = "1") -> DataFrame:
    """A written table of ids, marked for broadcast if its counted rows (or summed ``weight``) are within the bound; else the join is a sort-merge one, which can spill."""
    rows = df.agg(F.coalesce(F.sum(F.expr(weight)), F.lit(0)).alias("n")).first().n
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def drop_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows whose ``doc_id`` is in the written table ``ids``; rows without an id stay."""
    return docs.join(checked_side(ids.select("doc_id")), "doc_id", "left_anti").select(*docs.columns)
