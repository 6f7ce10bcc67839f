"""What the operators share: tables in the shared folder and blocks of rows for Arrow tasks."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, a new local one if Spark is local, as in tests; on
    a cluster that is an error, as no machine's own folder is seen by all."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quotemill-"))
    return context.getCheckpointDir()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once, as `spark-submit --py-files` would."""
    application = spark.sparkContext.applicationId
    if application not in _shipped:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        to = os.path.join(tempfile.mkdtemp(prefix="quotemill-code-"), "quotemill-code")
        name = shutil.make_archive(to, "zip", os.path.dirname(package), os.path.basename(package))
        spark.sparkContext.addPyFile(name)
        _shipped.add(application)


#: Bytes of a batch of rows on its way to a Python worker.
BATCH_BYTES = 11 << 18


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of some BATCH_BYTES for what this session runs from here on, unless it has a size of its own. Spark's
    are of 10,000 rows up to 64 MB: often all rows of a task, held by JVM and worker besides what they work with. A row
    over the limit is a batch of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read again.

    Cuts the lineage: what comes later reads files that outlive any executor.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quotemill/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of some `limit` bytes of text each. A text over the limit has a slice of its own, so memory follows the
    longest text and not the batch. What Arrow holds unused goes back at the end: workers outlive their tasks."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    pa.default_memory_pool().release_unused()


def text_blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1 << 18) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with some `limit` bytes of text each, and their texts in UTF-8 (null: empty)."""
    for part in slices(batches, column, limit):
        yield part, [(x or "").encode("utf-8", "surrogatepass") for x in part.column(column).to_pylist()]


def string_blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """As text_blocks, with texts as strings."""
    for part in slices(batches, column, limit):
        yield part, [x or "" for x in part.column(column).to_pylist()]
