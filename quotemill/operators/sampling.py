"""Samples of parts for evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotemill.functions.risk import is_dead


def stratified(catalog: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """n parts: half of them dead ones, or as many as there are, the others alive; by a seeded hash."""
    dead = is_dead(F.col("lifecycle_status"))
    place = F.row_number().over(Window.partitionBy(dead).orderBy(F.md5(F.concat("mpn", F.lit(str(seed)))), "mpn"))
    rows = catalog.withColumns({"dead": dead, "place": place})
    few = rows.where(F.col("place") <= n)
    n_dead = few.where(F.col("dead") & (F.col("place") <= n // 2)).count()
    return few.where((F.col("dead") & (F.col("place") <= n // 2)) | (~F.col("dead") & (F.col("place") <= n - n_dead))).drop("place", "dead")


def first_by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    k = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("k", k).where("k = 1").drop("k")
