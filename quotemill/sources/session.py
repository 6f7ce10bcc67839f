"""What a session needs to run the library's Python in its tasks."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def checkpointed(df: DataFrame) -> DataFrame:
    """df as files in the folder that spark.checkpoint.dir names, so that later reads see the same rows in the same tasks,
    whatever executors are lost. Where it is unset, a new local folder if Spark is local, as in tests; else an error."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        configured = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not configured and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="quotemill-"))
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """df over as many tasks as shuffles have: a file of few bytes may hold rows that are much work."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def large(df: DataFrame) -> DataFrame:
    """df, joined by sorting both sides: a small file may hold so many rows that one table of them is too much for the
    driver, which would build it for a broadcast."""
    return df.hint("merge")


def ship(spark: SparkSession) -> None:
    """Sends the library to the executors, once an application; `spark-submit --py-files` does the same."""
    application = spark.sparkContext.applicationId
    if application not in _shipped:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        to = os.path.join(tempfile.mkdtemp(prefix="quotemill-"), "quotemill")
        spark.sparkContext.addPyFile(shutil.make_archive(to, "zip", os.path.dirname(package), os.path.basename(package)))
        _shipped.add(application)
