"""A corpus pipeline over the table documents: each stage works on all that the one before it kept.

Language ID, line dedup, near duplicates, benchmark decontamination, packing. Every stage but the last returns
the columns of documents; the last returns the places of the documents' pieces in sequences.

Every stage takes rows with nulls in any column, empty and very long texts, repeated rows, columns beside those of
documents whatever their names, and an empty table, which gives an empty one. What it does with them stands with it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quotemill.llm import decontaminate, language_id, line_dedup, minhash, packing
from quotemill.llm.shared import shared_folder, ship, small_batches


def _ready(spark: SparkSession) -> None:
    """Stages follow each other on the same executors, whose JVM and Python workers keep what earlier ones took; so rows
    go from one to the other in small batches."""
    ship(spark)
    small_batches(spark)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: null and empty texts and those without letters too. Rows are judged
    one by one, whatever their doc_id."""
    _ready(spark)
    return language_id.accepted(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand on many sources go, but for their first copies; documents of nothing else go. Null and empty
    texts stay; a null source is none; a row without doc_id is never the first copy."""
    _ready(spark)
    return line_dedup.cleaned(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates stays, that of the least doc_id. Null and empty texts are like
    none and stay, as do rows without doc_id; rows with one doc_id are one document and stay or go together."""
    _ready(spark)
    return minhash.deduplicated(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go. Null and empty texts hold none; rows are judged one by one."""
    _ready(spark)
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents left, in sequences of 1024 places. Null and empty texts are an end id alone; each row is packed."""
    _ready(spark)
    return packing.packed(docs, at_once=packing.FEW_BYTES)


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("sequences", sequences),
]

#: No SQL says what MinHash finds or what the tokenizer returns; tests hold stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage is written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/quotemill/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
