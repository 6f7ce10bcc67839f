"""Quotes, catalog, requests and their lines, as views of the warehouse tables.

Each has SQL of the same rows beside it, which the queries' SQL builds on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.sources.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def week_of(ts):
    """The Monday on or before."""
    return F.date_trunc("week", ts).cast("date")


def quotes(spark: SparkSession, sf_dir: str, with_lead: bool = False) -> DataFrame:
    """part_mpn, week_start, broker_id, quoted_price, quoted_qty and, if asked for, lead_time_days.

    A part is a brand: that gives it enough quotes a week.
    """
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("part_mpn"))
    out = lines.join(parts, lines["l_partkey"] == parts["p_partkey"])
    columns = [
        F.col("part_mpn"),
        week_of("l_shipdate").alias("week_start"),
        F.col("l_suppkey").alias("broker_id"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("quoted_price"),
        F.col("l_quantity").cast("int").alias("quoted_qty"),
    ]
    if with_lead:
        orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
        out = out.join(orders, out["l_orderkey"] == orders["o_orderkey"])
        days = F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date"))
        columns.append(F.greatest(F.lit(1), F.least(F.lit(365), days)).alias("lead_time_days"))
    return out.select(*columns)


QUOTES = """
quotes AS (
  SELECT p_brand AS part_mpn, CAST(date_trunc('week', l_shipdate) AS DATE) AS week_start, l_suppkey AS broker_id,
         l_extendedprice / l_quantity AS quoted_price, CAST(l_quantity AS INT) AS quoted_qty
  FROM lineitem JOIN part ON l_partkey = p_partkey
)"""

QUOTES_LEAD = """
quotes AS (
  SELECT p_brand AS part_mpn, CAST(date_trunc('week', l_shipdate) AS DATE) AS week_start, l_suppkey AS broker_id,
         l_extendedprice / l_quantity AS quoted_price, CAST(l_quantity AS INT) AS quoted_qty,
         greatest(1, least(365, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)))) AS lead_time_days
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
)"""


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part_mpn, lifecycle, category of the parts of quotes."""
    number = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")
    return (
        table(spark, sf_dir, "part").select("p_brand").distinct()
        .select(
            F.col("p_brand").alias("part_mpn"),
            F.element_at(F.array(*map(F.lit, ("Active", "NRND", "Obsolete", "EOL"))), number % 4 + 1).alias("lifecycle"),
            F.element_at(F.array(*map(F.lit, ("Fixed Resistors", "SRAM", "Power FETs"))), number % 3 + 1).alias("category"),
        )
    )


BRANDS = """
brands AS (
  SELECT DISTINCT p_brand AS part_mpn,
         ['Active', 'NRND', 'Obsolete', 'EOL'][CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INT) % 4 + 1] AS lifecycle,
         ['Fixed Resistors', 'SRAM', 'Power FETs'][CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INT) % 3 + 1] AS category
  FROM part
)"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part number each, with maker, category, lifecycle, stock and numeric specs."""
    p = table(spark, sf_dir, "part")
    suffix = F.when(F.col("p_partkey") % 3 == 0, "T6").when(F.col("p_partkey") % 3 == 1, "").otherwise("I8")
    mpn = F.concat(
        F.upper(F.left("p_type", F.lit(3))), (F.lit(10000) + F.col("p_partkey") * 7).cast("string"), F.lit("-C"),
        F.col("p_size").cast("string"), suffix,
    )
    turn = F.col("p_size") % 8
    lifecycle = F.when(turn == 0, "Obsolete").when(turn == 1, "EOL").when(turn == 2, "NRND").otherwise("Active")
    return p.select(
        mpn.alias("mpn"), F.col("p_brand").alias("manufacturer"), F.col("p_type").alias("category"),
        F.col("p_name").alias("description"), lifecycle.alias("lifecycle_status"),
        F.when(turn < 2, 0).otherwise(F.col("p_partkey") % 5 * 100).cast("long").alias("authorized_stock"),
        (F.col("p_partkey") % 11 == 0).alias("is_defense_grade"),
        F.when(F.col("p_partkey") % 9 == 0, "").otherwise(
            F.date_format(F.date_add(F.lit("1998-01-01").cast("date"), (F.col("p_partkey") % 9000).cast("int")), "yyyy-MM-dd")
        ).alias("date_introduced"),
        F.create_map(F.lit("size"), F.col("p_size").cast("double"), F.lit("price"), F.col("p_retailprice"),
                     F.lit("weight"), F.when(F.col("p_partkey") % 4 != 0, (F.col("p_partkey") % 17).cast("double"))).alias("specs"),
        F.col("p_partkey").alias("part_id"),
    )


CATALOG = """
catalog AS (
  SELECT upper(left(p_type, 3)) || CAST(10000 + p_partkey * 7 AS VARCHAR) || '-C' || CAST(p_size AS VARCHAR)
           || CASE p_partkey % 3 WHEN 0 THEN 'T6' WHEN 1 THEN '' ELSE 'I8' END AS mpn,
         p_brand AS manufacturer, p_type AS category, p_name AS description,
         CASE p_size % 8 WHEN 0 THEN 'Obsolete' WHEN 1 THEN 'EOL' WHEN 2 THEN 'NRND' ELSE 'Active' END AS lifecycle_status,
         CAST(CASE WHEN p_size % 8 < 2 THEN 0 ELSE p_partkey % 5 * 100 END AS BIGINT) AS authorized_stock,
         p_partkey % 11 = 0 AS is_defense_grade,
         CASE WHEN p_partkey % 9 = 0 THEN '' ELSE strftime(DATE '1998-01-01' + CAST(p_partkey % 9000 AS INT), '%Y-%m-%d') END
           AS date_introduced,
         CAST(p_size AS DOUBLE) AS spec_size, p_retailprice AS spec_price,
         CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_partkey % 17 AS DOUBLE) END AS spec_weight, p_partkey AS part_id
  FROM part
)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """input_id, input_string, kind, expected_mpn: catalog numbers as people write them, and some that aren't."""
    c = catalog(spark, sf_dir)
    turn, mpn = F.col("part_id") % 8, F.col("mpn")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (turn + 1).cast("int"))
    text = (
        F.when(turn == 0, mpn)
        .when(turn == 1, F.lower(mpn))
        .when(turn == 2, F.concat(mpn, F.lit("-TR-ND QTY "), (F.col("part_id") + 1).cast("string")))
        .when(turn == 3, F.concat(F.lit("296-"), mpn, F.lit("/REEL")))
        .when(turn == 4, F.left(mpn, F.lit(8)))
        .when(turn == 5, F.regexp_replace(F.replace(mpn, F.lit("0"), F.lit("O")), "-", ""))
        .when(turn == 6, F.concat(F.lit("  "), F.replace(mpn, F.lit("-"), F.lit("  ")), F.lit("X9")))
        .otherwise(F.concat(F.lit("ZQ-"), F.reverse(F.col("part_id").cast("string")), F.lit("W77-KX")))
    )
    return c.select(
        F.col("part_id").alias("input_id"), text.alias("input_string"), kind.alias("kind"),
        F.when(turn != 7, mpn).alias("expected_mpn"),
    )


KINDS = ["exact", "lowercase", "packaging_suffix", "distributor_prefix", "truncation", "o0_confusion", "grade", "nonexistent"]
REQUESTS = f"""
requests AS (
  SELECT part_id AS input_id, {KINDS!r}[part_id % 8 + 1] AS kind, CASE WHEN part_id % 8 <> 7 THEN mpn END AS expected_mpn,
         CASE part_id % 8 WHEN 0 THEN mpn WHEN 1 THEN lower(mpn)
           WHEN 2 THEN mpn || '-TR-ND QTY ' || CAST(part_id + 1 AS VARCHAR) WHEN 3 THEN '296-' || mpn || '/REEL'
           WHEN 4 THEN left(mpn, 8) WHEN 5 THEN replace(replace(mpn, '0', 'O'), '-', '')
           WHEN 6 THEN '  ' || replace(mpn, '-', '  ') || 'X9'
           ELSE 'ZQ-' || reverse(CAST(part_id AS VARCHAR)) || 'W77-KX' END AS input_string
  FROM catalog
)"""
