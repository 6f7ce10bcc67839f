"""Checks of price history and catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _dispersed(quotes: DataFrame) -> DataFrame:
    p = F.percentile("quoted_price", F.array(*map(F.lit, (0.25, 0.5, 0.75))))
    lead = [F.avg("lead_time_days").alias("lead_time")] if "lead_time_days" in quotes.columns else []
    weeks = quotes.groupBy("part_mpn", "week_start").agg(p.alias("p"), F.count("*").alias("quotes"), *lead)
    ratio = F.try_divide(F.col("p")[2] - F.col("p")[0], F.nullif(F.col("p")[1], F.lit(0.0)))
    return weeks.where("quotes >= 3").withColumn("dispersion_ratio", ratio)


def peak_heat(quotes: DataFrame) -> DataFrame:
    """baseline and peak heat of each part, from weeks of three quotes or more and the whole history."""
    frame = Window.partitionBy("part_mpn").orderBy("week_start").rowsBetween(-7, 0)
    smooth = _dispersed(quotes).select("part_mpn", "dispersion_ratio", F.avg("dispersion_ratio").over(frame).alias("smooth"))
    # the baseline is one number a part, so the peak of the ratio is the ratio of the peak
    base = smooth.groupBy("part_mpn").agg(F.percentile("dispersion_ratio", F.lit(0.5)).alias("baseline"), F.max("smooth").alias("peak"))
    return base.select("part_mpn", "baseline", F.try_divide("peak", F.nullif("baseline", F.lit(0.0))).alias("peak_heat_index"))


def dispersion_summary(quotes: DataFrame) -> DataFrame:
    heat = F.col("peak_heat_index")
    return peak_heat(quotes).agg(
        F.count("*").alias("parts"), F.count_if(heat > 2.0).alias("volatile_parts"),
        F.count_if(heat.between(1.3, 2.0)).alias("elevated_parts"),
        F.percentile("baseline", F.lit(0.5)).alias("typical_baseline"),
        F.percentile("peak_heat_index", F.lit(0.5)).alias("typical_peak_heat"),
    )


def busy_weeks(quotes: DataFrame) -> DataFrame:
    calm, busy = F.col("quotes") <= 4, F.col("quotes") >= 6
    ratio, lead = F.col("dispersion_ratio"), F.col("lead_time")
    return _dispersed(quotes).agg(
        F.percentile(F.when(calm, ratio), F.lit(0.5)).alias("calm_dispersion"),
        F.percentile(F.when(busy, ratio), F.lit(0.5)).alias("busy_dispersion"),
        F.avg(F.when(calm, lead)).alias("calm_lead"), F.avg(F.when(busy, lead)).alias("busy_lead"),
        F.count_if(busy).alias("busy_weeks"),
    )


def history(quotes: DataFrame) -> DataFrame:
    return quotes.agg(
        F.count("*").alias("n_rows"), F.countDistinct("part_mpn").alias("parts"), F.countDistinct("week_start").alias("weeks")
    )


def short_series(quotes: DataFrame, least: int) -> DataFrame:
    weeks = quotes.groupBy("part_mpn").agg(F.countDistinct("week_start").alias("weeks"))
    return weeks.where(F.col("weeks") < least)


def catalog_counts(catalog: DataFrame) -> DataFrame:
    dead = F.col("lifecycle_status").isin("Obsolete", "EOL")
    return catalog.agg(
        F.count("*").alias("parts"), F.countDistinct("category").alias("categories"),
        F.countDistinct("manufacturer").alias("manufacturers"), F.count_if(dead).alias("dead_parts"),
        F.count_if("is_defense_grade").alias("defense_parts"), F.count_if(F.col("authorized_stock") > 0).alias("stocked_parts"),
        F.array_join(F.array_sort(F.collect_set("category")), ",").alias("category_list"),
    )


def catalog_summary(catalog: DataFrame) -> DataFrame:
    """Parts and share of each category."""
    counts = catalog.groupBy("category").agg(F.count("*").alias("parts"), F.sum("authorized_stock").alias("stock"))
    return counts.withColumn("share", F.col("parts") / F.sum("parts").over(Window.partitionBy()))
