"""What is written: the warehouse's tables, lines of requests, predictions, summaries, models."""

from __future__ import annotations

import hashlib
import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.operators.requests import stored


def catalog(parts: DataFrame, path: str) -> None:
    """The whole catalog, over what was there. A number that occurs twice is an error, and nothing is written."""
    twice = parts.groupBy("mpn").count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"part numbers that occur more than once: {', '.join(r.mpn for r in twice)}")
    parts.write.mode("overwrite").parquet(path)


def quotes(rows: DataFrame, path: str) -> None:
    """All quotes, over what was there: files by ranges of part and week, so that a reader of few parts skips most."""
    rows.repartitionByRange("part_mpn", "week_start").sortWithinPartitions("part_mpn", "week_start").write.mode("overwrite").parquet(path)


def requests(lines: DataFrame, path: str) -> None:
    """Appends lines of requests, numbered from 1 in their order, as they are kept. lines: rfq_id, place, and more."""
    stored(lines.withColumn("line_no", (F.col("place") + 1).cast("int")).drop("place")).write.mode("append").parquet(path)


class RequestStore:
    """Requests with their lines in one folder, saved together: a manifest of both gets its number last, by a rename that
    fails where the number is taken. A writer that dies before leaves nothing to read; one that another overtakes checks
    anew. (rfq_id, line_no) and rfq_id are unique over all that is saved. The rename is atomic on HDFS."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._fs().mkdirs(self._path("manifests"))

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifests(self) -> list[str]:
        """Names of the manifests, each its number and the name of what it publishes: one a save."""
        return sorted(name for x in self._fs().listStatus(self._path("manifests")) if (name := x.getPath().getName()).isdigit())

    def _published(self) -> list[str]:
        names = self._manifests()
        return [self.spark.read.text(f"{self.folder}/manifests/{n}").first().value for n in names]

    def _read(self, what: str, saved: list[str]) -> DataFrame | None:
        return self.spark.read.option("mergeSchema", True).parquet(*[f"{self.folder}/{s}/{what}" for s in saved]) if saved else None

    def headers(self) -> DataFrame | None:
        """All requests; None where nothing was saved."""
        return self._read("headers", self._published())

    def lines(self) -> DataFrame | None:
        """All lines as they are kept; None where nothing was saved."""
        return self._read("lines", self._published())

    def _twice(self, saved: list[str], batch: str) -> list:
        """Names that the batch repeats, or has in common with what was saved."""
        out = []
        for what, keys in (("headers", ["rfq_id"]), ("lines", ["rfq_id", "line_no"])):
            own = self._read(what, [batch]).select(*keys)
            known = self._read(what, saved)
            every = own if known is None else own.unionByName(known.select(*keys).join(own.distinct(), keys, "left_semi"))
            out += every.groupBy(*keys).count().where("count > 1").limit(5).collect()
        return out

    def save(self, headers: DataFrame, lines: DataFrame) -> int:
        """Saves requests (rfq_id, and more) with their lines (rfq_id, place, and more), numbered from 1 in their order, and
        returns the number of the save. Names that are there already are an error, and nothing is saved; so are lines of
        no request in the batch."""
        batch = f"saved-{uuid.uuid4().hex}"
        headers.write.parquet(f"{self.folder}/{batch}/headers")
        requests(lines, f"{self.folder}/{batch}/lines")
        if not self._read("lines", [batch]).join(self._read("headers", [batch]), "rfq_id", "left_anti").isEmpty():
            self._fs().delete(self._path(batch), True)
            raise ValueError("lines of requests that are not in the batch")
        while True:
            number = max(map(int, self._manifests()), default=0) + 1
            if twice := self._twice(self._published(), batch):
                self._fs().delete(self._path(batch), True)
                raise ValueError(f"saved already, or twice in the batch: {twice}")
            if self._publish(number, batch):
                return number

    def _publish(self, number: int, batch: str) -> bool:
        made = self._path(f"making-{uuid.uuid4().hex}")
        out = self._fs().create(made, False)
        out.write(bytearray(batch.encode()))
        out.close()
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        files = hadoop.FileContext.getFileContext(self._path("").toUri(), self.spark._jsc.hadoopConfiguration())
        plainly = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)  # without replacing
        try:
            files.rename(made, self._path(f"manifests/{number:012d}"), plainly)
        except Py4JJavaError as error:
            self._fs().delete(made, False)
            if "AlreadyExists" in str(error.java_exception):
                return False
            raise
        return True


def raw_input(names: Column, items: Column) -> Column:
    """What stands for an upload's text: the file's name, then a line for each item, without empty ones."""
    return F.concat_ws("\n", names, F.filter(items, lambda x: x.isNotNull() & (x != "")))


def predictions(found: DataFrame, path: str) -> None:
    """CSV with a head line; prices to six decimals, spikes as 0 and 1."""
    price = lambda name: F.format_string("%.6f", name).alias(name)
    rows = found.select(
        F.col("part_mpn").alias("mpn"), "week_index", "model", price("actual"), price("predicted"), "lifecycle", "category",
        F.coalesce(F.col("during_spike"), F.lit(False)).cast("int").alias("during_spike"),
    )
    rows.write.mode("overwrite").option("header", True).csv(path)


def summary(metrics: DataFrame, path: str) -> None:
    """A few rows of metrics as lines of JSON."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def signature(rows: DataFrame, **settings) -> str:
    """What a model was made of: the settings, and number and hash of the training rows in any order."""
    seen = rows.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*rows.columns)).alias("h")).first()
    return hashlib.sha256(json.dumps({"n": seen.n, "h": seen.h, **settings}, sort_keys=True).encode()).hexdigest()


class Models:
    """Fitted models in a folder, by signature; one that is missing or can't be read is none."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def load(self, key: str) -> PipelineModel | None:
        try:
            return PipelineModel.load(f"{self.folder}/{key}")
        except Exception:  # noqa: BLE001  whatever is wrong with the files, the model is fitted anew
            return None

    def save(self, key: str, model: PipelineModel) -> None:
        model.write().overwrite().save(f"{self.folder}/{key}")

    def clear(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
