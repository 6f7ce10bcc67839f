"""Names of all queries, with the callables and the SQL that must return the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quotemill.plans import feeds, market, parts, texts

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {**market.QUERIES, **parts.QUERIES, **texts.QUERIES, **feeds.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**market.SQL, **parts.SQL, **texts.SQL, **feeds.SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole analysis of all requests: match by all tiers, price, heat and risk of each line."""
    return parts.analyze_all_tiers(spark, sf_dir)
