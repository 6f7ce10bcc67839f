"""Requests, their lines, and the whole analysis of a request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.functions.part_numbers import key_of
from quotemill.functions.risk import assessed
from quotemill.operators import alternates, forecast, matching, pricing
from quotemill.sources.session import checkpointed, large

PREVIEW, LINE_CAP, REVIEW_BELOW = 120, 200, 0.7
#: Weeks of a part's history that its details tell.
HISTORY = 52


def listed(requests: DataFrame, lines: DataFrame, limit: int, offset: int) -> DataFrame:
    """A page of requests, newest first, with numbers of lines and of matched ones.

    requests: rfq_id, raw_input, source_type, created_at; lines: rfq_id, matched_mpn. The page is cut before
    the join, so lines of other requests are not counted.
    """
    page = requests.orderBy(F.desc("created_at"), F.desc("rfq_id")).offset(offset).limit(limit)
    counts = lines.join(F.broadcast(page.select("rfq_id")), "rfq_id", "left_semi").groupBy("rfq_id").agg(
        F.count("*").alias("n"), F.count("matched_mpn").alias("m")
    )
    out = page.join(counts, "rfq_id", "left")
    return out.select(
        "rfq_id", F.left("raw_input", F.lit(PREVIEW)).alias("preview"), "source_type", "created_at",
        F.coalesce("n", F.lit(0)).alias("line_count"), F.coalesce("m", F.lit(0)).alias("matched_count"),
    )


def detail(lines: DataFrame, rfq_id: int) -> DataFrame:
    return lines.where(F.col("rfq_id") == rfq_id).orderBy("line_no")


def capped(lines: DataFrame, most: int = LINE_CAP) -> DataFrame:
    """The first lines of each request: the limit is the feature."""
    k = F.row_number().over(Window.partitionBy("rfq_id").orderBy("line_no"))
    return lines.withColumn("k", k).where(F.col("k") <= most).drop("k")


def stored(lines: DataFrame) -> DataFrame:
    """Lines as they are kept: prices of 0 or less become null, arrays become JSON."""
    out = lines
    for name in ("price_p25", "price_p50", "price_p75", "forecast_price"):
        if name in lines.columns:
            out = out.withColumn(name, F.when(F.col(name) > 0, F.col(name)))
    for name, kind in lines.dtypes:
        if kind.startswith("array"):
            out = out.withColumn(name, F.to_json(F.coalesce(F.col(name), F.array().cast(kind))))
    return out


def panel(lines: DataFrame) -> DataFrame:
    """Counts over a result: matched, to be reviewed, hot, full test."""
    return lines.agg(
        F.count("*").alias("lines"), F.count_if(F.col("matched_mpn").isNotNull()).alias("matched"),
        F.count_if(F.col("confidence") < REVIEW_BELOW).alias("needs_review"),
        F.count_if(F.col("volatility_flag") != "STABLE").alias("hot"), F.count_if(F.col("risk_score") > 55).alias("full_test"),
    )


def snapshot(quotes: DataFrame, parts: DataFrame | None = None, model: str = "naive") -> DataFrame:
    """Band, heat and forecast, by the model of that name, of each part: null, never 0, where there are no quotes.
    parts: part_mpn, lifecycle, category, for models that look at them."""
    # a row a series: once, and before anything larger stands beside it
    weeks = checkpointed(pricing.weekly(quotes))
    if parts is None:
        parts = quotes.select("part_mpn").distinct().select("part_mpn", F.lit("Active").alias("lifecycle"), F.lit("").alias("category"))
    heat = pricing.heat_latest(weeks).select("part_mpn", "heat_index", "volatility_flag")
    band = pricing.price_band(quotes).select("part_mpn", *[F.col(c).alias(f"price_{c}") for c in ("p25", "p50", "p75")])
    last = forecast.forecasts(weeks, parts, model)
    return checkpointed(band.join(heat, "part_mpn", "full").join(last, "part_mpn", "full"))


def analyzed(requests: DataFrame, catalog: DataFrame, quotes: DataFrame, today: Column, with_fuzzy: bool = True) -> DataFrame:
    """One row an input: best match, its part, the price of its series, and risk.

    catalog.manufacturer names the series that prices a part.
    """
    found, near = matching.cascade(requests, catalog, with_fuzzy)
    best = found.where("rank = 1").select("input_id", F.col("mpn").alias("matched_mpn"), "confidence", F.col("method").alias("match_method"))
    counts = found.groupBy("input_id").agg(F.count("*").alias("candidates"))
    out = requests.select("input_id", "input_string").join(large(best), "input_id", "left").join(large(counts), "input_id", "left")
    parts = catalog.select(F.col("mpn").alias("matched_mpn"), "manufacturer", "category", "lifecycle_status", "authorized_stock", "is_defense_grade", "date_introduced")
    out = out.join(large(parts), "matched_mpn", "left")
    prices = snapshot(quotes).withColumnRenamed("part_mpn", "manufacturer")
    out = out.join(prices, "manufacturer", "left")
    out = out.withColumns({"confidence": F.coalesce("confidence", F.lit(0.0)), "match_method": F.coalesce("match_method", F.lit("no_match")), "candidates": F.coalesce("candidates", F.lit(0))})
    return assessed(out, today)


def stand_ins(catalog: DataFrame, wanted: DataFrame) -> DataFrame:
    """mpn and alternates, its best stand-ins in order (at most five)."""
    found = checkpointed(alternates.alternates(catalog, wanted))
    state = catalog.select(F.col("mpn").alias("alternate"), "manufacturer", "description")
    row = F.struct("rank", F.col("alternate").alias("mpn"), "manufacturer", "description", "lifecycle_status", "authorized_stock", "similarity")
    return found.join(large(state), "alternate").groupBy("mpn").agg(F.array_sort(F.collect_list(row)).alias("alternates"))


def _first(hits: DataFrame, name: str) -> DataFrame:
    """The first three hits of an input in order."""
    row = F.struct("rank", "mpn", "confidence", "method")
    return hits.where(F.col("rank") <= matching.NEAR_MISSES).groupBy("input_id").agg(F.array_sort(F.collect_list(row)).alias(name))


def analyzed_whole(
    requests: DataFrame, catalog: DataFrame, quotes: DataFrame, today: Column, parts: DataFrame | None = None, model: str = "naive", with_fuzzy: bool = True
) -> DataFrame:
    """As analyzed, with all that is told of a line: its key and the rules that made it, the first three candidates or
    near misses, the part's description and stand-ins, and a forecast by the model of that name (parts: see snapshot)."""
    inputs = matching.read(requests)
    found, near = matching.cascade(requests, catalog, with_fuzzy, inputs)
    found = checkpointed(found)
    read = inputs.select("input_id", F.col("key").alias("normalized_key"), F.col("applied").alias("rules_applied"))
    best = found.where("rank = 1").select("input_id", F.col("mpn").alias("matched_mpn"), "confidence", F.col("method").alias("match_method"))
    out = requests.select("input_id", "input_string").join(large(read), "input_id", "left").join(large(best), "input_id", "left")
    out = out.join(large(_first(found, "candidates")), "input_id", "left").join(large(_first(near, "near_misses")), "input_id", "left")
    columns = ("manufacturer", "description", "category", "lifecycle_status", "authorized_stock", "is_defense_grade", "date_introduced")
    out = out.join(large(catalog.select(F.col("mpn").alias("matched_mpn"), *columns)), "matched_mpn", "left")
    out = out.join(large(stand_ins(catalog, best.select(F.col("matched_mpn").alias("mpn"))).withColumnRenamed("mpn", "matched_mpn")), "matched_mpn", "left")
    out = out.join(snapshot(quotes, parts, model).withColumnRenamed("part_mpn", "manufacturer"), "manufacturer", "left")
    none = lambda name: F.coalesce(name, F.array().cast(out.schema[name].dataType)).alias(name)
    lists = ("candidates", "near_misses", "alternates")
    out = out.withColumns({"confidence": F.coalesce("confidence", F.lit(0.0)), "match_method": F.coalesce("match_method", F.lit("no_match"))} | {n: none(n) for n in lists})
    return assessed(out, today)


def details_whole(asked: DataFrame, catalog: DataFrame, quotes: DataFrame, parts: DataFrame | None = None, model: str = "naive", weeks: int = HISTORY) -> DataFrame:
    """As details, with band, heat and forecast of the part's series, its last weeks oldest first, and its stand-ins."""
    found = checkpointed(details(asked, catalog))
    series = history(pricing.weekly(quotes), weeks)
    point = F.struct(*[c for c in ("week_start", "p25", "p50", "p75", "quotes", "avg_lead", "dispersion") if c in series.columns])
    told = series.groupBy("part_mpn").agg(F.array_sort(F.collect_list(point)).alias("history"))  # at most `weeks`
    out = found.join(told.withColumnRenamed("part_mpn", "manufacturer"), "manufacturer", "left")
    out = out.join(snapshot(quotes, parts, model).withColumnRenamed("part_mpn", "manufacturer"), "manufacturer", "left")
    out = out.join(large(stand_ins(catalog, found.select("mpn"))), "mpn", "left")
    return out.withColumns({n: F.coalesce(n, F.array().cast(out.schema[n].dataType)) for n in ("history", "alternates")})


def overridden(lines: DataFrame, overrides: DataFrame) -> DataFrame:
    """Lines with a person's choice laid over: the part's columns are the chosen one's, sure and exact.

    overrides: input_id, and chosen_ before the names of the part's columns.
    """
    names = [c.removeprefix("chosen_") for c in overrides.columns if c != "input_id"]
    out = lines.join(large(overrides), "input_id", "left").withColumn("chosen", F.col("chosen_matched_mpn").isNotNull())
    for name in names:
        out = out.withColumn(name, F.when(F.col("chosen"), F.col(f"chosen_{name}")).otherwise(F.col(name)))
    out = out.withColumn("confidence", F.when(F.col("chosen"), 1.0).otherwise(F.col("confidence")))
    out = out.withColumn("match_method", F.when(F.col("chosen"), "exact").otherwise(F.col("match_method")))
    return out.select(*lines.columns)


def details(asked: DataFrame, catalog: DataFrame) -> DataFrame:
    """asked (input_id, input_string) with the part printed so, else the best of the same key; those of no part go."""
    parts = matching.keyed(catalog)
    found = asked.join(large(parts), key_of(F.upper("input_string")) == F.col("part_key"))
    order = [F.upper("mpn") != F.upper("input_string"), F.col("lifecycle_status").isin("Obsolete", "EOL"), F.col("authorized_stock") == 0, "mpn"]
    k = F.row_number().over(Window.partitionBy("input_id").orderBy(*order))
    return found.withColumn("k", k).where("k = 1").drop("k", "part_key", "part_base")


def history(weeks: DataFrame, last: int) -> DataFrame:
    """The last weeks of each part's series, oldest first."""
    k = F.row_number().over(Window.partitionBy("part_mpn").orderBy(F.desc("week_start")))
    return weeks.withColumn("k", k).where(F.col("k") <= last).drop("k")


def sparkline(weeks: DataFrame) -> DataFrame:
    """Least, most, first and last median of each part, and the change in percent."""
    out = weeks.groupBy("part_mpn").agg(
        F.min("p50").alias("low"), F.max("p50").alias("high"), F.min_by("p50", "week_start").alias("first"), F.max_by("p50", "week_start").alias("last")
    )
    return out.withColumn("change_pct", F.try_divide(F.col("last") - F.col("first"), F.nullif("first", F.lit(0.0))) * 100)


def restored(lines: DataFrame) -> DataFrame:
    """Stored lines with their reasons, alternates and near misses as arrays again."""
    schemas = {
        "risk_reasons": "array<struct<code:string,label:string,points:int,detail:string>>",
        "alternates": "array<struct<mpn:string,similarity:double,lifecycle_status:string,authorized_stock:long>>",
        "near_misses": "array<struct<mpn:string,confidence:double>>",
    }
    return lines.withColumns({name: F.from_json(name, schema) for name, schema in schemas.items() if name in lines.columns})
