"""Operator 7: token totals by source, language and tokenizer version, maintained by signed deltas.

A batch is a set of changes: inserts, deletes and revised counts of documents. It becomes signed rows: an
insert adds a document and its tokens, a delete takes away what the ledger says was added, a revision takes
away the old count and adds the new one, in the group that the revised document names. Rows are summed by source,
language and version in the tasks, then by Spark, and the sums are stored with the batch. Totals are the sums of the
committed batches' sums; texts are read once, when they come.

A batch's files are written under a name of their own; a numbered commit makes them count. The commit's file is written
whole under another name and gets its number by a rename that fails where the number is taken: a commit is there with all
its content or not at all, and a writer that dies leaves none. The number is the one after the last commit that the
batch has read: of two batches at once one starts anew from the other's ledger. A commit that can't be read is an error,
never left out. A batch id that is committed is not taken again, so a batch may be sent or retried at will. After
COMPACT_AFTER commits the ledger, the totals and the ids of all batches are written as a snapshot, so that a batch reads
that and the few commits after it, not all history.

Null text: an empty one. Null source or language: groups of their own. Null doc_id: the documents without an id, which
a null in deletes or revisions names all together. Deletes and revisions of documents that the ledger lacks change
nothing. A document both deleted and revised in a batch is deleted. Rows with one doc_id in a batch: each insert adds;
a delete takes away all that was added; a revision gives each its count; of several revisions the one of most tokens
counts, then the greatest source and language. A very long text is encoded whole, alone in its block. Empty batches
commit and change nothing. Empty tables: no totals. Other columns are ignored.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_folder, string_blocks
from .tokenization import default_vocabulary, encoder

#: The vocabulary's file and the number of the way of counting, and what that adds to a text's ids: nothing, the end id.
VERSIONS = {"byte_bpe_50k/1": 0, "byte_bpe_50k/2": 1}
COMPACT_AFTER = 16
_ROW = "doc_id long, source string, lang string, tokenizer_version string, docs long, tokens long"
_SUM = "source string, lang string, tokenizer_version string, docs long, tokens long"
_COMMIT = "batch_id string, folder string"
_KEYS = ["source", "lang", "tokenizer_version"]


def counted(docs: DataFrame, vocabulary: str | None = None, versions: dict[str, int] | None = None, text: Column | None = None) -> DataFrame:
    """doc_id, source, lang, tokenizer_version, n_tokens of each row and version; text: another expression to count."""
    vocabulary = vocabulary or default_vocabulary()
    added = F.explode(F.array(*[F.struct(F.lit(v).alias("v"), F.lit(n).alias("n")) for v, n in (versions or VERSIONS).items()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for part, texts in string_blocks(batches):
            sizes = [len(x) // 4 for x in encode(texts)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("source"), part.column("lang"), pa.array(sizes, pa.int64())], ["doc_id", "source", "lang", "n"]
            )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"), (F.col("text") if text is None else text).alias("text"),
    )
    found = rows.mapInArrow(run, "doc_id long, source string, lang string, n long").withColumn("added", added)
    return found.select("doc_id", "source", "lang", F.col("added.v").alias("tokenizer_version"), (F.col("n") + F.col("added.n")).alias("n_tokens"))


def _named(rows: DataFrame) -> DataFrame:
    """rows with one column that names a document and version, nulls too."""
    return rows.withColumn("name", F.struct(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), "tokenizer_version"))


class TokenRollup:
    """The totals in one folder: commits, snapshots, and for each batch its signed rows and their sums."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        for name in ("commits", "snapshots"):
            self._fs().mkdirs(self._path(name))

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self, name: str) -> list[int]:
        """The numbers of commits or snapshots: a short file each."""
        return sorted(int(x.getPath().getName()) for x in self._fs().listStatus(self._path(name)) if x.getPath().getName().isdigit())

    def _published(self, name: str, content: dict) -> bool:
        """Writes a file whole and gives it its name, unless there is one of that name."""
        made = self._path(f"making-{uuid.uuid4().hex}")
        out = self._fs().create(made, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        files = hadoop.FileContext.getFileContext(self._path("").toUri(), self.spark._jsc.hadoopConfiguration())
        plainly = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)  # without replacing
        try:
            files.rename(made, self._path(name), plainly)
        except Py4JJavaError as error:
            self._fs().delete(made, False)
            if "AlreadyExists" in str(error.java_exception):
                return False
            raise
        return True

    def _since(self) -> tuple[int, int, list]:
        """The numbers of the last commit and snapshot, and what the commits after that say: a few."""
        last, start = max(self._numbers("commits"), default=0), max(self._numbers("snapshots"), default=0)
        if last <= start:
            return max(last, start), start, []
        files = [f"{self.folder}/commits/{n:012d}" for n in range(start + 1, last + 1)]
        rows = self.spark.read.schema(_COMMIT).option("mode", "FAILFAST").json(files).where("folder IS NOT NULL").collect()
        if len(rows) != len(files):
            raise RuntimeError(f"of {len(files)} commits after {start} in {self.folder} only {len(rows)} can be read")
        return last, start, rows

    def _state(self) -> tuple[int, list[str]]:
        """The number of the last commit, and the folders that make up what it left: the last snapshot's and those of
        the commits since."""
        last, start, rows = self._since()
        return last, ([f"snapshot-{start}"] if start else []) + sorted(r.folder for r in rows)

    def has(self, batch_id: str) -> bool:
        _, start, rows = self._since()
        if any(r.batch_id == batch_id for r in rows):
            return True
        return bool(start) and not self._read("ids", "batch_id string", [f"snapshot-{start}"]).where(F.col("batch_id") == batch_id).isEmpty()

    def _read(self, what: str, schema: str, folders: list[str]) -> DataFrame:
        paths = [f"{self.folder}/{x}/{what}" for x in folders]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _ledger(self, folders: list[str]) -> DataFrame:
        sums = self._read("rows", _ROW, folders).groupBy("doc_id", *_KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs <> 0 OR tokens <> 0")

    def ledger(self) -> DataFrame:
        """What stands of each document: doc_id, keys, docs, tokens."""
        return self._ledger(self._state()[1])

    def _totals(self, folders: list[str]) -> DataFrame:
        sums = self._read("sums", _SUM, folders).groupBy(*_KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs <> 0 OR tokens <> 0")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, n_docs, n_tokens of what stands."""
        return self._totals(self._state()[1]).select(*_KEYS, F.col("docs").alias("n_docs"), F.col("tokens").alias("n_tokens"))

    def _signed(self, stood: DataFrame, inserts: DataFrame | None, deletes: DataFrame | None, revisions: DataFrame | None) -> list[DataFrame]:
        columns, signed = ["doc_id", *_KEYS], []
        if inserts is not None:
            signed.append(inserts.select(*columns, F.lit(1).cast("long").alias("docs"), F.col("n_tokens").alias("tokens")))
        stood = _named(stood)
        gone = _named(deletes).select("name").distinct() if deletes is not None else None
        if gone is not None:
            signed.append(stood.join(gone, "name", "left_semi").select(*columns, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens")))
        if revisions is not None:
            new = _named(revisions).groupBy("name").agg(F.max(F.struct("n_tokens", "source", "lang")).alias("new"))
            if gone is not None:
                new = new.join(gone, "name", "left_anti")
            both = stood.join(new, "name")
            signed.append(both.select(*columns, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens")))
            signed.append(
                both.select(
                    "doc_id", F.col("new.source").alias("source"), F.col("new.lang").alias("lang"), "tokenizer_version", "docs",
                    (F.col("new.n_tokens") * F.col("docs")).alias("tokens"),
                )
            )
        return signed

    def apply(
        self, batch_id: str, inserts: DataFrame | None = None, deletes: DataFrame | None = None, revisions: DataFrame | None = None
    ) -> bool:
        """Commits a batch; False if its id was committed before. inserts and revisions: as from counted();
        deletes: doc_id and tokenizer_version. Deletes and revisions refer to what stood before the batch."""
        while True:
            last, folders = self._state()
            if self.has(batch_id):
                return False
            name = f"batch-{uuid.uuid4().hex}"
            signed = self._signed(self._ledger(folders), inserts, deletes, revisions)
            for rows in signed or [self.spark.createDataFrame([], _ROW)]:
                rows.write.mode("append").parquet(f"{self.folder}/{name}/rows")
            self._summed(name)
            if self._published(f"commits/{last + 1:012d}", {"batch_id": batch_id, "folder": name}):
                break
            self._fs().delete(self._path(name), True)
        if (last + 1) % COMPACT_AFTER == 0:
            self.compact()
        return True

    def _summed(self, name: str) -> None:
        rows = self._read("rows", _ROW, [name])
        sums = rows.groupBy(*_KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.write.parquet(f"{self.folder}/{name}/sums")

    def compact(self) -> None:
        """Writes what stands as a snapshot, which later batches read in place of the commits up to it."""
        last, start, commits = self._since()
        folders = ([f"snapshot-{start}"] if start else []) + [r.folder for r in commits]
        name, new = f"snapshot-{last}", f"making-{uuid.uuid4().hex}"
        if last == start:
            return
        ids = self._read("ids", "batch_id string", folders[:1] if start else [])
        ids.unionByName(self.spark.createDataFrame([(r.batch_id,) for r in commits], "batch_id string")).write.parquet(f"{self.folder}/{new}/ids")
        self._ledger(folders).write.parquet(f"{self.folder}/{new}/rows")
        self._summed(new)
        if self._fs().rename(self._path(new), self._path(name)):
            self._published(f"snapshots/{last}", {"folder": name})


def new_rollup(spark: SparkSession) -> TokenRollup:
    return TokenRollup(spark, f"{shared_folder(spark)}/quotemill/token-counts-{uuid.uuid4().hex}")


def maintained(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Totals after three batches: all documents come; those of low quality go; those that repeat lines are
    counted anew without the repeats. The first batch is sent twice."""
    rollup = new_rollup(docs.sparkSession)
    for _ in range(2):
        rollup.apply("load", inserts=counted(docs))
    versions = F.explode(F.array(*map(F.lit, VERSIONS))).alias("tokenizer_version")
    rollup.apply("low quality", deletes=labels.where("quality = 0").select(F.col("doc_id").cast("long").alias("doc_id"), versions))
    lines = F.split("text", "\n", -1)
    again = docs.where(F.size(lines) > F.size(F.array_distinct(lines)))
    rollup.apply("without repeated lines", revisions=counted(again, text=F.array_join(F.array_distinct(lines), "\n")))
    return rollup.totals()
