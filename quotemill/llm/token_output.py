"""Operator 2: token ids as entropy-coded binary blocks.

Documents are dealt to ranges of doc_id and sorted; each task tokenizes its range, writes blocks of whole documents
with plain ids, and counts ids. The counts of all documents make one static table of frequencies, shared by all
blocks, that codes them with interleaved asymmetric numeral systems (see rans). Blocks are independent, in ascending
doc_id order, with checkpoints and checksums. The container is Parquet, one row a block, so that any store that
Spark reaches can hold it; the table of frequencies, with a checksum, lies beside the blocks.

Null text: an empty one. Null doc_id: comes first, and stays null. Rows with one doc_id: all kept, ordered by a hash
of their texts; equal rows are alike, whatever their order. A very long text: a block of its own, or of what came
before it too; a task holds a few of its copies. Empty input: no blocks. Other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import rans
from .shared import shared_folder, slices, written
from .tokenization import END_ID, TEXT_BYTES, default_vocabulary, encoder

#: A block is closed at the document that brings it to so many ids.
BLOCK_TOKENS = 1 << 20
_PLAIN = "segment int, block int, n_docs long, n_tokens long, doc_ids array<long>, lengths array<long>, ids binary, counts binary"
_BLOCK = "segment int, block int, n_docs long, n_tokens long, payload binary"
_TABLE = "ids binary, counts binary, crc long"


def tokenized(docs: DataFrame, vocabulary: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of plain ids, 16 bits each if the vocabulary allows, with end ids; and a row a task with its counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        segment, encode = TaskContext.get().partitionId(), encoder(vocabulary).encode
        size = max(encoder(vocabulary).vocabulary_size, END_ID + 1)
        end, kind = np.array([END_ID], "<u4").tobytes(), np.uint16 if size <= 1 << 16 else np.uint32
        counts, block, ids, names, held = np.zeros(size, np.int64), 0, [], [], 0

        def row(*values) -> pa.RecordBatch:
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary())
            columns = "segment block n_docs n_tokens doc_ids lengths ids counts".split()
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((segment, *values), kinds)], columns)

        def close() -> pa.RecordBatch:
            nonlocal counts
            flat = np.frombuffer(b"".join(ids), "<u4")
            counts += np.bincount(flat, minlength=size)
            return row(block, len(names), len(flat), names, [len(x) // 4 for x in ids], flat.astype(kind).tobytes(), None)

        for part in slices(batches, limit=TEXT_BYTES):
            for name, x in zip(part.column("doc_id").to_pylist(), encode(part.column("text"))):
                ids.append(x + end)
                names.append(name)
                held += len(ids[-1]) // 4
                if held >= block_tokens:
                    yield close()
                    block, ids, names, held = block + 1, [], [], 0
        if names:
            yield close()
        if counts.any():
            yield row(None, None, None, None, None, None, counts.tobytes())

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    # the hash splits a doc_id, or none, that many rows share
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h")
    return ordered.select("doc_id", "text").mapInArrow(run, _PLAIN)


def token_counts(plain: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs in all documents: added in the tasks, then by Spark, one row an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for raw in batch.column("counts"):
                counts += np.frombuffer(raw.as_buffer(), np.int64)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(counts[seen])], ["id", "n"])

    found = plain.select("counts").where("counts IS NOT NULL")
    sums = found.mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(size, np.int64)
    for row in sums.toLocalIterator():  # one row an id of the vocabulary, however large the input
        counts[row.id] = row.n
    return counts


def write_blocks(docs: DataFrame, path: str, vocabulary: str | None = None, block_tokens: int = BLOCK_TOKENS) -> None:
    """Writes path/blocks and path/table."""
    spark, vocabulary = docs.sparkSession, vocabulary or default_vocabulary()
    plain = written(tokenized(docs, vocabulary, block_tokens), "tokens")
    counts = token_counts(plain, max(encoder(vocabulary).vocabulary_size, END_ID + 1))
    seen = np.flatnonzero(counts)
    ids, numbers = seen.astype("<u4").tobytes(), counts[seen].astype("<i8").tobytes()
    spark.createDataFrame([(ids, numbers, zlib.crc32(ids + numbers))], _TABLE).coalesce(1).write.parquet(f"{path}/table")
    coding = rans.table(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.uint16 if len(row["ids"]) == 2 * row["n_tokens"] else np.uint32)
                raw = rans.encode_block(ids.astype(np.uint32), row["doc_ids"], row["lengths"], coding)
                values = [[row[c]] for c in ("segment", "block", "n_docs", "n_tokens")]
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, k) for v, k in zip([*values, [raw]], kinds)], ["segment", "block", "n_docs", "n_tokens", "payload"]
                )

    blocks = plain.drop("counts").where("block IS NOT NULL").mapInArrow(run, _BLOCK)
    blocks.write.parquet(f"{path}/blocks")


def read_table(spark: SparkSession, path: str) -> rans.Table:
    row = spark.read.schema(_TABLE).parquet(f"{path}/table").first()  # bounded by the vocabulary
    if zlib.crc32(bytes(row.ids) + bytes(row.counts)) != row.crc:
        raise ValueError("the table of frequencies is damaged: its checksum differs")
    ids = np.frombuffer(row.ids, "<u4")
    counts = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.int64)
    counts[ids] = np.frombuffer(row.counts, "<i8")
    return rans.table(counts)


def read_documents(spark: SparkSession, path: str, with_ids: bool = False, shares: int = 1) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the blocks; ids too if asked for.

    shares: tasks may decode so many shares of a block apart, each from its own checkpoint.
    """
    coding = read_table(spark, path)
    blocks = spark.read.schema(_BLOCK).parquet(f"{path}/blocks")
    # a row a segment, so the running sum over segments is short
    sizes = blocks.groupBy("segment").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("segment", F.coalesce(before, F.lit(0)).alias("segment_start"))
    inside = F.sum("n_tokens").over(
        Window.partitionBy("segment").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        blocks.select("segment", "block", F.coalesce(inside, F.lit(0)).alias("inside"))
        .join(starts, "segment")
        .select("segment", "block", (F.col("segment_start") + F.col("inside")).alias("block_start"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = coding.symbols()
        for batch in batches:
            for at, share, raw in zip(batch.column("block_start").to_pylist(), batch.column("share").to_pylist(), batch.column("payload")):
                block = rans.Block(raw.as_py())
                i, j, ids = block.documents(coding, symbols, share, shares)
                lengths = block.lengths[i:j]
                stops, start = np.cumsum(lengths), at + int(block.lengths[:i].sum())
                flat = ids.astype("<u4").tobytes()
                each = [flat[4 * (k - n) : 4 * k] for k, n in zip(stops.tolist(), lengths.tolist())]
                columns = [
                    pa.array(block.doc_ids[i:j], pa.int64()),
                    pa.array(start + stops - lengths, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array([zlib.crc32(x) for x in each], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in each], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    placed = blocks.join(offsets, ["segment", "block"])
    share = F.explode(F.sequence(F.lit(0), F.lit(shares - 1))) if shares > 1 else F.lit(0)
    placed = placed.select("block_start", share.alias("share"), "payload")
    return (placed.repartition("block_start", "share") if shares > 1 else placed).mapInArrow(run, schema)


def token_files(docs: DataFrame, vocabulary: str | None = None, with_ids: bool = False, shares: int = 1) -> DataFrame:
    """Writes the documents' blocks to a new folder in the shared one and reads them back."""
    path = f"{shared_folder(docs.sparkSession)}/quotemill/token-files-{uuid.uuid4().hex}"
    write_blocks(docs, path, vocabulary)
    return read_documents(docs.sparkSession, path, with_ids, shares)
