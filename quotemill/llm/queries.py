"""The operators' queries over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, distance_keys, filter_audit, hnsw, language_id, licenses, line_dedup, minhash, packing, pii, token_counts, token_output, toxicity
from .shared import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without lines that stand on many sources."""
    return line_dedup.report(_table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as coded blocks and read back."""
    return token_output.token_files(_table(spark, sf_dir, "documents"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near duplicates among all documents."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of benchmark items in all documents."""
    return decontaminate.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 places."""
    return packing.packed(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for all documents."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals of all documents after inserts, deletes and revisions."""
    return token_counts.maintained(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licences among all documents and their lines."""
    return licenses.scanned(_table(spark, sf_dir, "documents"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors to each whose vec_id is divisible by 50."""
    table = _table(spark, sf_dir, "embeddings")
    return hnsw.nearest(table, table.where("vec_id % 50 = 0"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents."""
    return language_id.predicted(_table(spark, sf_dir, "documents"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    docs = _table(spark, sf_dir, "documents")
    return pii.found(docs, pii.fit(docs))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove of all documents, in each order and part."""
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives to each positive of the anchors among all vectors."""
    return distance_keys.hard_negatives(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_token_files": op2_token_files,
        "op3_near_duplicates": op3_near_duplicates,
        "op4_decontaminate": op4_decontaminate,
        "op5_packing": op5_packing,
        "op6_toxicity": op6_toxicity,
        "op7_token_counts": op7_token_counts,
        "op8_licenses": op8_licenses,
        "op9_nearest": op9_nearest,
        "op10_language_id": op10_language_id,
        "op11_pii": op11_pii,
        "op12_filter_audit": op12_filter_audit,
        "op13_hard_negatives": op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": line_dedup.ORACLE,
        "op4_decontaminate": decontaminate.ORACLE,
        "op8_licenses": licenses.oracle(),
        "op12_filter_audit": filter_audit.ORACLE,
        "op13_hard_negatives": distance_keys.ORACLE,
    }
