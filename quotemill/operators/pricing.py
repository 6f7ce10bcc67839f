"""Weekly quote aggregates, price bands, market heat and forecast features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.operators.order_statistics import quantiles

HEAT_WEEKS, BASE_WEEKS, BAND_WEEKS = 8, 52, 8
ELEVATED, VOLATILE, FLOOR = 1.3, 2.0, 1e-4
LAGS, ROLLS, FIRST_WEEK = (1, 2, 4, 8, 12), (4, 12), 12


def _by_week() -> Window:
    return Window.partitionBy("part_mpn").orderBy("week_start")


def _last(n: int):
    return _by_week().rowsBetween(-(n - 1), 0)


def weekly(quotes: DataFrame) -> DataFrame:
    """Quartiles, count and, where known, mean lead time of each part and week; dispersion is 0 at no price."""
    lead = [F.avg("lead_time_days").alias("avg_lead")] if "lead_time_days" in quotes.columns else []
    p = F.percentile("quoted_price", F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias("p")
    out = quotes.groupBy("part_mpn", "week_start").agg(p, F.count("*").alias("quotes"), *lead)
    p25, p50, p75 = (F.col("p")[i] for i in range(3))
    return out.select(
        "part_mpn", "week_start", p25.alias("p25"), p50.alias("p50"), p75.alias("p75"), "quotes",
        *[c for c in out.columns if c == "avg_lead"],
        F.when(p50 > 0, (p75 - p25) / p50).otherwise(0.0).alias("dispersion"),
    )


def price_band(quotes: DataFrame, weeks: int = BAND_WEEKS) -> DataFrame:
    """Quartiles of all quotes of each part's last weeks, later than its latest week less `weeks`. A part may have any
    number of quotes: they are ranked in many tasks."""
    latest = quotes.groupBy("part_mpn").agg(F.max("week_start").alias("latest"))
    recent = quotes.join(latest, "part_mpn").where(F.col("week_start") > F.date_sub("latest", 7 * weeks))
    found = quantiles(recent, ["part_mpn"], "quoted_price", {"p25": 0.25, "p50": 0.5, "p75": 0.75}).drop("size")
    return recent.groupBy("part_mpn").agg(F.count("*").alias("quotes")).join(found, "part_mpn", "left").select("part_mpn", "p25", "p50", "p75", "quotes")


def heat_ratio(now: Column, base: Column) -> Column:
    """Dispersion against its baseline; 1 where there is no baseline to speak of."""
    return F.when(base >= FLOOR, now / base).otherwise(1.0)


def flag(heat: Column) -> Column:
    return F.when(heat > VOLATILE, "VOLATILE").when(heat >= ELEVATED, "ELEVATED").otherwise("STABLE")


def heat_asof(weeks: DataFrame) -> DataFrame:
    """Heat as it was known in each week: the last 8 weeks' mean dispersion over the last 52 weeks' median."""
    now, base = F.avg("dispersion").over(_last(HEAT_WEEKS)), F.percentile("dispersion", F.lit(0.5)).over(_last(BASE_WEEKS))
    heat = heat_ratio(F.col("now"), F.col("base"))
    return weeks.withColumns({"now": now, "base": base}).select(
        *weeks.columns, heat.alias("heat_index"), flag(heat).alias("volatility_flag")
    )


def heat_latest(weeks: DataFrame) -> DataFrame:
    """Heat of each part in its last week: one aggregation over its last weeks."""
    rank = F.row_number().over(Window.partitionBy("part_mpn").orderBy(F.desc("week_start")))
    recent = weeks.select("part_mpn", "dispersion", rank.alias("k")).where(F.col("k") <= BASE_WEEKS)
    out = recent.groupBy("part_mpn").agg(
        F.avg(F.when(F.col("k") <= HEAT_WEEKS, F.col("dispersion"))).alias("now"),
        F.percentile("dispersion", F.lit(0.5)).alias("base"), F.count("*").cast("int").alias("weeks"),
    )
    heat = heat_ratio(F.col("now"), F.col("base"))
    return out.select("part_mpn", "now", "base", "weeks", heat.alias("heat_index"), flag(heat).alias("volatility_flag"))


def indexed(weeks: DataFrame) -> DataFrame:
    return weeks.withColumn("week_index", F.row_number().over(_by_week()) - 1)


def features(weeks: DataFrame, parts: DataFrame) -> DataFrame:
    """What a forecast may know in each week, and the target: the log of next week's median over this one's.

    Prices are ratios to the week's own. Rows start at the thirteenth week and need a price above 0.
    """
    p = F.col("p50")
    columns = {"week_index": F.row_number().over(_by_week()) - 1, "target": F.ln(F.lead("p50").over(_by_week()) / p)}
    columns |= {f"lag_{k}": F.lag("p50", k).over(_by_week()) / p for k in LAGS}
    for n in ROLLS:
        columns[f"mean_{n}"] = F.avg("p50").over(_last(n)) / p
        columns[f"std_{n}"] = F.stddev_pop("p50").over(_last(n)) / p
    columns["to_high"] = p / F.max("p50").over(_last(BASE_WEEKS))
    columns["to_low"] = p / F.min("p50").over(_last(BASE_WEEKS))
    columns["dispersion_8"] = F.avg("dispersion").over(_last(HEAT_WEEKS))
    columns["dispersion_52"] = F.percentile("dispersion", F.lit(0.5)).over(_last(BASE_WEEKS))
    columns["past"] = F.collect_list("dispersion").over(_last(BASE_WEEKS))
    columns["log_price"] = F.ln(p)
    out = weeks.where("p50 IS NOT NULL").withColumns(columns)
    # the threshold is this week's, so each row looks through its own window
    spikes = F.filter(F.sequence(F.lit(1), F.size("past")), lambda i: F.element_at("past", i) > 2 * F.col("dispersion_52"))
    since = F.when(F.col("dispersion_52") > 0, F.size("past") - F.array_max(spikes))
    out = out.withColumn("weeks_since_spike", F.coalesce(since, F.lit(BASE_WEEKS)))
    out = out.where((F.col("week_index") >= FIRST_WEEK) & (p > 0)).join(parts, "part_mpn", "left")
    for name in ("Active", "NRND", "Obsolete", "EOL"):
        out = out.withColumn(f"is_{name.lower()}", (F.coalesce(F.col("lifecycle"), F.lit("Active")) == name).cast("int"))
    return out.drop("past")


def naive(weeks: DataFrame) -> DataFrame:
    """The last weekly median of each part."""
    return weeks.groupBy("part_mpn").agg(
        F.max_by("p50", "week_start").alias("forecast_price"), F.max("week_start").alias("week_start")
    )
