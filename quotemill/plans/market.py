"""Queries over quotes: aggregates, heat, checks, features, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.operators import backtest, forecast, pricing, requests, verify
from quotemill.sources import tables
from quotemill.sources.tables import BRANDS, QUOTES, QUOTES_LEAD

LEAST_WEEKS = 104


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """Doubles to nine decimals: engines add and interpolate in different orders."""
    return df.withColumns({n: F.round(n, 9) for n in names})


def weekly_quotes(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pricing.weekly(tables.quotes(spark, sf, True)), "p25", "p50", "p75", "dispersion", "avg_lead")


WEEKLY = """
weekly AS (
  SELECT part_mpn, week_start, quantile_cont(quoted_price, 0.25) AS p25, quantile_cont(quoted_price, 0.5) AS p50,
         quantile_cont(quoted_price, 0.75) AS p75, count(*) AS quotes,
         CASE WHEN quantile_cont(quoted_price, 0.5) > 0 THEN (quantile_cont(quoted_price, 0.75) - quantile_cont(quoted_price, 0.25))
              / quantile_cont(quoted_price, 0.5) ELSE 0 END AS dispersion
  FROM quotes GROUP BY part_mpn, week_start
)"""
HEAT_ASOF = """
heat AS (
  SELECT *, CASE WHEN base >= 1e-4 THEN now / base ELSE 1.0 END AS heat_index FROM (
    SELECT *, avg(dispersion) OVER (PARTITION BY part_mpn ORDER BY week_start ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS now,
           quantile_cont(dispersion, 0.5) OVER (PARTITION BY part_mpn ORDER BY week_start ROWS BETWEEN 51 PRECEDING AND CURRENT ROW) AS base
    FROM weekly)
)"""
FLAG = "CASE WHEN heat_index > 2.0 THEN 'VOLATILE' WHEN heat_index >= 1.3 THEN 'ELEVATED' ELSE 'STABLE' END"
BAND = """
band AS (
  SELECT part_mpn, quantile_cont(quoted_price, 0.25) AS p25, quantile_cont(quoted_price, 0.5) AS p50,
         quantile_cont(quoted_price, 0.75) AS p75, count(*) AS quotes
  FROM quotes q WHERE week_start > (SELECT max(week_start) FROM quotes x WHERE x.part_mpn = q.part_mpn) - INTERVAL 56 DAY
  GROUP BY part_mpn
)"""
PREDICTIONS = """
rows_ AS (
  SELECT *, row_number() OVER w - 1 AS week_index, count(*) OVER (PARTITION BY part_mpn) AS n, lead(p50) OVER w AS actual,
         lead(heat_index) OVER w > 2.0 AS during_spike, p50 AS naive,
         avg(p50) OVER (PARTITION BY part_mpn ORDER BY week_start ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS mean4
  FROM heat WINDOW w AS (PARTITION BY part_mpn ORDER BY week_start)
), chosen AS (
  SELECT * FROM rows_ WHERE n >= 104 AND week_index BETWEEN 77 AND 101
), found AS (
  SELECT part_mpn, week_index + 1 AS week_index, 'naive' AS model, actual, naive AS predicted, during_spike FROM chosen
  UNION ALL SELECT part_mpn, week_index + 1, 'mean4', actual, mean4, during_spike FROM chosen
), predictions AS (
  SELECT f.*, coalesce(lifecycle, 'Active') AS lifecycle, coalesce(category, '') AS category,
         abs(actual - predicted) / actual AS ape, (actual - predicted) * (actual - predicted) AS se
  FROM found f LEFT JOIN brands USING (part_mpn)
)"""
METRICS = "count(*) AS n, round(avg(ape), 9) AS mape, round(quantile_cont(ape, 0.5), 9) AS median_ape, round(sqrt(avg(se)), 7) AS rmse"
_ALL = f"WITH {QUOTES}, {WEEKLY}, {HEAT_ASOF}, {BRANDS}, {PREDICTIONS}"


def price_band(spark, sf):
    return rounded(pricing.price_band(tables.quotes(spark, sf)), "p25", "p50", "p75")


def heat_latest(spark, sf):
    return rounded(pricing.heat_latest(pricing.weekly(tables.quotes(spark, sf))), "now", "base", "heat_index")


def heat_asof(spark, sf):
    out = pricing.heat_asof(pricing.weekly(tables.quotes(spark, sf)))
    return rounded(out.select("part_mpn", "week_start", "heat_index", "volatility_flag"), "heat_index")


def verify_dispersion(spark, sf):
    return rounded(verify.dispersion_summary(tables.quotes(spark, sf)), "typical_baseline", "typical_peak_heat")


def verify_busy_weeks(spark, sf):
    return rounded(verify.busy_weeks(tables.quotes(spark, sf, True)), "calm_dispersion", "busy_dispersion", "calm_lead", "busy_lead")


def verify_history(spark, sf):
    return verify.history(tables.quotes(spark, sf))


def verify_short_series(spark, sf):
    """Parts are catalog rows here, whose series are short."""
    lines = tables.table(spark, sf, "lineitem")
    q = lines.select(F.col("l_partkey").alias("part_mpn"), tables.week_of("l_shipdate").alias("week_start"))
    return verify.short_series(q, LEAST_WEEKS)


def forecast_features(spark, sf):
    out = pricing.features(pricing.weekly(tables.quotes(spark, sf)), tables.brands(spark, sf))
    doubles = [n for n, t in out.dtypes if t == "double" and n not in ("p25", "p50", "p75", "dispersion")]
    return rounded(out.drop("p25", "p50", "p75", "dispersion", "quotes"), *doubles)


FEATURES = f"""
WITH {QUOTES}, {WEEKLY}, {BRANDS}, w AS (
  SELECT *, row_number() OVER o - 1 AS week_index, lead(p50) OVER o AS nxt,
         {", ".join(f"lag(p50, {k}) OVER o AS l{k}" for k in pricing.LAGS)},
         avg(p50) OVER r4 AS m4, stddev_pop(p50) OVER r4 AS s4, avg(p50) OVER r12 AS m12, stddev_pop(p50) OVER r12 AS s12,
         max(p50) OVER r52 AS hi, min(p50) OVER r52 AS lo, avg(dispersion) OVER r8 AS d8, quantile_cont(dispersion, 0.5) OVER r52 AS d52
  FROM weekly WINDOW o AS (PARTITION BY part_mpn ORDER BY week_start),
    r4 AS (PARTITION BY part_mpn ORDER BY week_start ROWS BETWEEN 3 PRECEDING AND CURRENT ROW),
    r8 AS (PARTITION BY part_mpn ORDER BY week_start ROWS BETWEEN 7 PRECEDING AND CURRENT ROW),
    r12 AS (PARTITION BY part_mpn ORDER BY week_start ROWS BETWEEN 11 PRECEDING AND CURRENT ROW),
    r52 AS (PARTITION BY part_mpn ORDER BY week_start ROWS BETWEEN 51 PRECEDING AND CURRENT ROW)
), spikes AS (
  SELECT a.part_mpn, a.week_index, min(a.week_index - b.week_index) AS since
  FROM w a JOIN w b ON a.part_mpn = b.part_mpn AND b.week_index BETWEEN a.week_index - 51 AND a.week_index
    AND b.dispersion > 2 * a.d52 AND a.d52 > 0 GROUP BY 1, 2
)
SELECT w.part_mpn, week_start, w.week_index, round(ln(nxt / p50), 9) AS target,
       {", ".join(f"round(l{k} / p50, 9) AS lag_{k}" for k in pricing.LAGS)},
       round(m4 / p50, 9) AS mean_4, round(s4 / p50, 9) AS std_4, round(m12 / p50, 9) AS mean_12, round(s12 / p50, 9) AS std_12,
       round(p50 / hi, 9) AS to_high, round(p50 / lo, 9) AS to_low, round(d8, 9) AS dispersion_8, round(d52, 9) AS dispersion_52,
       round(ln(p50), 9) AS log_price, coalesce(since, 52) AS weeks_since_spike, lifecycle, category,
       CAST(coalesce(lifecycle, 'Active') = 'Active' AS INT) AS is_active, CAST(coalesce(lifecycle, 'Active') = 'NRND' AS INT) AS is_nrnd,
       CAST(coalesce(lifecycle, 'Active') = 'Obsolete' AS INT) AS is_obsolete, CAST(coalesce(lifecycle, 'Active') = 'EOL' AS INT) AS is_eol
FROM w LEFT JOIN spikes s ON s.part_mpn = w.part_mpn AND s.week_index = w.week_index LEFT JOIN brands b ON b.part_mpn = w.part_mpn
WHERE w.week_index >= 12 AND p50 > 0
"""


def naive_forecast(spark, sf):
    return rounded(pricing.naive(pricing.weekly(tables.quotes(spark, sf))), "forecast_price")


def _found(spark, sf):
    return backtest.predictions(pricing.weekly(tables.quotes(spark, sf)), tables.brands(spark, sf))


def backtest_predictions(spark, sf):
    out = backtest.with_errors(_found(spark, sf))
    return rounded(out, "actual", "predicted", "ape").drop("se")


def backtest_segments(spark, sf):
    return backtest.segments(_found(spark, sf)).withColumn("rmse", F.round("rmse", 7)).withColumns({n: F.round(n, 9) for n in ("mape", "median_ape")})


def backtest_lifecycle(spark, sf):
    return backtest.by_lifecycle(_found(spark, sf)).withColumn("rmse", F.round("rmse", 7)).withColumns({n: F.round(n, 9) for n in ("mape", "median_ape")})


def backtest_wins(spark, sf):
    return rounded(backtest.wins(_found(spark, sf)), "share")


def model_rank(spark, sf):
    return rounded(backtest.ranked(_found(spark, sf)), "mape")


def backtest_side_by_side(spark, sf):
    return rounded(backtest.side_by_side(_found(spark, sf)), "actual", "naive", "mean4")


def price_swing(spark, sf):
    weeks = pricing.weekly(tables.quotes(spark, sf))
    out = weeks.groupBy("part_mpn").agg((F.max("p50") / F.greatest(F.min("p50"), F.lit(1e-9))).alias("swing"))
    return rounded(out, "swing")


def sparkline_stats(spark, sf):
    return rounded(requests.sparkline(pricing.weekly(tables.quotes(spark, sf))), "low", "high", "first", "last", "change_pct")


def history_projection(spark, sf):
    out = requests.history(pricing.weekly(tables.quotes(spark, sf, True)), 52)
    return rounded(out.select("part_mpn", "week_start", "p25", "p50", "p75", "avg_lead"), "p25", "p50", "p75", "avg_lead")


def series_arrays(spark, sf):
    """Each part's medians in one array, oldest first, as its checksum; at most a few hundred weeks."""
    weeks = pricing.weekly(tables.quotes(spark, sf))
    series = F.array_sort(F.collect_list(F.struct("week_start", "quotes")))
    return weeks.groupBy("part_mpn").agg(series.alias("s")).select(
        "part_mpn", F.size("s").alias("weeks"), F.array_join(F.transform("s", lambda x: x["quotes"].cast("string")), ",").alias("quotes"),
        F.array_join(F.transform(F.slice("s", -4, 4), lambda x: x["quotes"].cast("string")), ",").alias("last_four"),
    )


def week_spine(spark, sf):
    """Every Monday between a part's first and last week, and whether it has quotes."""
    weeks = pricing.weekly(tables.quotes(spark, sf)).select("part_mpn", "week_start", "quotes")
    ends = weeks.groupBy("part_mpn").agg(F.min("week_start").alias("a"), F.max("week_start").alias("b"))
    spine = ends.select("part_mpn", F.explode(F.expr("sequence(a, b, interval 7 days)")).alias("week_start"))
    return spine.join(weeks, ["part_mpn", "week_start"], "left").select("part_mpn", "week_start", F.coalesce("quotes", F.lit(0)).alias("quotes"))


def min_history(spark, sf):
    """Parts with enough weeks for the evaluation."""
    weeks = pricing.weekly(tables.quotes(spark, sf))
    return weeks.groupBy("part_mpn").agg(F.count("*").alias("weeks")).where(F.col("weeks") >= LEAST_WEEKS)


def series_scan(spark, sf):
    """Quotes of the parts that a list names: the brands of defense parts."""
    wanted = tables.catalog(spark, sf).where("is_defense_grade").select(F.col("manufacturer").alias("part_mpn")).distinct()
    q = tables.quotes(spark, sf).join(wanted, "part_mpn", "left_semi")
    return rounded(q.groupBy("part_mpn").agg(F.count("*").alias("n"), F.min("quoted_price").alias("low")), "low")


def error_metrics(spark, sf):
    out = backtest.with_errors(_found(spark, sf)).where("model = 'naive'")
    delta = (F.col("predicted") - F.col("actual")) / F.col("actual")
    label = F.when(F.abs(delta) < 0.005, "flat").when(delta > 0, "up").otherwise("down")
    return out.groupBy(label.alias("direction")).agg(F.count("*").alias("n"))


def _features(spark, sf):
    return pricing.features(pricing.weekly(tables.quotes(spark, sf)), tables.brands(spark, sf))


def gbm_forecast(spark, sf):
    """Next week of every part by boosted trees trained on all weeks but each part's last."""
    return forecast.rolling_gbm(_features(spark, sf), [None])


#: Origins that the evaluation of all models takes, and trees of a fit at each.
MODEL_ORIGINS, TREES = tuple(range(77, 102)), 200


def _model_predictions(spark, sf):
    weeks = pricing.weekly(tables.quotes(spark, sf))
    return backtest.full_predictions(weeks, _features(spark, sf), tables.brands(spark, sf), list(MODEL_ORIGINS), TREES)


def backtest_models(spark, sf):
    """Last median, boosted trees and ARIMA for each part at MODEL_ORIGINS, in five segments."""
    return backtest.segments(_model_predictions(spark, sf))


def backtest_model_wins(spark, sf):
    """How often each of the three models was nearest."""
    return backtest.wins(_model_predictions(spark, sf), backtest.FULL_MODELS)


def arima_forecast(spark, sf):
    return forecast.arima(pricing.weekly(tables.quotes(spark, sf)))


def arima_orders(spark, sf):
    """How many parts each order was chosen for, by likelihood."""
    fits = forecast.arima_fits(pricing.weekly(tables.quotes(spark, sf)))
    return fits.groupBy(F.array_join("order", ",").alias("chosen")).agg(F.count("*").alias("parts"))


QUERIES = {
    f.__name__: f
    for f in (
        weekly_quotes, price_band, heat_latest, heat_asof, verify_dispersion, verify_busy_weeks, verify_history, verify_short_series,
        forecast_features, naive_forecast, backtest_predictions, backtest_segments, backtest_lifecycle, backtest_wins, model_rank,
        backtest_side_by_side, price_swing, sparkline_stats, history_projection, series_arrays, week_spine, min_history, series_scan,
        error_metrics, gbm_forecast, arima_forecast, arima_orders, backtest_models, backtest_model_wins,
    )
}

_RATIO = "(quantile_cont(quoted_price, 0.75) - quantile_cont(quoted_price, 0.25)) / nullif(quantile_cont(quoted_price, 0.5), 0)"
SQL = {
    "weekly_quotes": f"""WITH {QUOTES_LEAD}, {WEEKLY}, l AS (
  SELECT part_mpn, week_start, avg(lead_time_days) AS avg_lead FROM quotes GROUP BY ALL)
SELECT part_mpn, week_start, round(p25, 9) AS p25, round(p50, 9) AS p50, round(p75, 9) AS p75, quotes, round(avg_lead, 9) AS avg_lead,
       round(dispersion, 9) AS dispersion FROM weekly JOIN l USING (part_mpn, week_start)""",
    "price_band": f"WITH {QUOTES}, {BAND} SELECT part_mpn, round(p25, 9) AS p25, round(p50, 9) AS p50, round(p75, 9) AS p75, quotes FROM band",
    "heat_asof": f"""WITH {QUOTES}, {WEEKLY}, {HEAT_ASOF}
SELECT part_mpn, week_start, round(heat_index, 9) AS heat_index, {FLAG} AS volatility_flag FROM heat""",
    "heat_latest": f"""WITH {QUOTES}, {WEEKLY}, k AS (
  SELECT *, row_number() OVER (PARTITION BY part_mpn ORDER BY week_start DESC) AS k FROM weekly
), a AS (
  SELECT part_mpn, avg(dispersion) FILTER (WHERE k <= 8) AS now, quantile_cont(dispersion, 0.5) AS base, CAST(count(*) AS INT) AS weeks
  FROM k WHERE k <= 52 GROUP BY part_mpn
), h AS (SELECT *, CASE WHEN base >= 1e-4 THEN now / base ELSE 1.0 END AS heat_index FROM a)
SELECT part_mpn, round(now, 9) AS now, round(base, 9) AS base, weeks, round(heat_index, 9) AS heat_index, {FLAG} AS volatility_flag FROM h""",
    "verify_dispersion": f"""WITH {QUOTES}, d AS (
  SELECT part_mpn, week_start, {_RATIO} AS ratio FROM quotes GROUP BY ALL HAVING count(*) >= 3
), s AS (
  SELECT *, avg(ratio) OVER (PARTITION BY part_mpn ORDER BY week_start ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS smooth FROM d
), b AS (SELECT part_mpn, quantile_cont(ratio, 0.5) AS baseline FROM s GROUP BY part_mpn), h AS (
  SELECT s.part_mpn, max(smooth / nullif(baseline, 0)) AS peak, baseline FROM s JOIN b USING (part_mpn) GROUP BY s.part_mpn, baseline)
SELECT count(*) AS parts, count(*) FILTER (WHERE peak > 2.0) AS volatile_parts,
       count(*) FILTER (WHERE peak BETWEEN 1.3 AND 2.0) AS elevated_parts,
       round(quantile_cont(baseline, 0.5), 9) AS typical_baseline, round(quantile_cont(peak, 0.5), 9) AS typical_peak_heat FROM h""",
    "verify_busy_weeks": f"""WITH {QUOTES_LEAD}, d AS (
  SELECT part_mpn, week_start, count(*) AS quotes, {_RATIO} AS ratio, avg(lead_time_days) AS lead_time
  FROM quotes GROUP BY ALL HAVING count(*) >= 3)
SELECT round(quantile_cont(ratio, 0.5) FILTER (WHERE quotes <= 4), 9) AS calm_dispersion,
       round(quantile_cont(ratio, 0.5) FILTER (WHERE quotes >= 6), 9) AS busy_dispersion,
       round(avg(lead_time) FILTER (WHERE quotes <= 4), 9) AS calm_lead, round(avg(lead_time) FILTER (WHERE quotes >= 6), 9) AS busy_lead,
       count(*) FILTER (WHERE quotes >= 6) AS busy_weeks FROM d""",
    "verify_history": f"WITH {QUOTES} SELECT count(*) AS n_rows, count(DISTINCT part_mpn) AS parts, count(DISTINCT week_start) AS weeks FROM quotes",
    "verify_short_series": f"""SELECT l_partkey AS part_mpn, count(DISTINCT date_trunc('week', l_shipdate)) AS weeks FROM lineitem
GROUP BY 1 HAVING count(DISTINCT date_trunc('week', l_shipdate)) < {LEAST_WEEKS}""",
    "forecast_features": FEATURES,
    "naive_forecast": f"""WITH {QUOTES}, {WEEKLY}
SELECT part_mpn, round(arg_max(p50, week_start), 9) AS forecast_price, max(week_start) AS week_start FROM weekly GROUP BY part_mpn""",
    "backtest_predictions": f"""{_ALL} SELECT part_mpn, week_index, model, round(actual, 9) AS actual, round(predicted, 9) AS predicted,
       during_spike, lifecycle, category, round(ape, 9) AS ape FROM predictions""",
    "backtest_segments": f"""{_ALL}, seg AS (
  SELECT *, unnest(['overall', CASE WHEN lifecycle IN ('Obsolete', 'EOL') THEN 'obsolete' ELSE 'active' END,
                    CASE WHEN during_spike THEN 'during_spike' ELSE 'normal' END]) AS segment FROM predictions)
SELECT segment, model, {METRICS} FROM seg GROUP BY segment, model""",
    "backtest_lifecycle": f"{_ALL} SELECT lifecycle, model, {METRICS} FROM predictions GROUP BY lifecycle, model",
    "backtest_wins": f"""{_ALL}, b AS (
  SELECT part_mpn, week_index, min_by(model, row(ape, CASE model WHEN 'naive' THEN 1 ELSE 2 END)) AS model FROM predictions
  GROUP BY part_mpn, week_index HAVING count(*) = 2)
SELECT model, count(*) AS wins, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM b GROUP BY model""",
    "model_rank": f"{_ALL} SELECT model, round(avg(ape), 9) AS mape, CAST(row_number() OVER (ORDER BY avg(ape), model) AS INT) AS rank FROM predictions GROUP BY model",
    "backtest_side_by_side": f"""{_ALL} SELECT part_mpn, week_index, round(actual, 9) AS actual,
       round(max(predicted) FILTER (WHERE model = 'naive'), 9) AS naive, round(max(predicted) FILTER (WHERE model = 'mean4'), 9) AS mean4
FROM predictions GROUP BY part_mpn, week_index, actual""",
    "price_swing": f"WITH {QUOTES}, {WEEKLY} SELECT part_mpn, round(max(p50) / greatest(min(p50), 1e-9), 9) AS swing FROM weekly GROUP BY part_mpn",
    "sparkline_stats": f"""WITH {QUOTES}, {WEEKLY}, s AS (
  SELECT part_mpn, min(p50) AS low, max(p50) AS high, arg_min(p50, week_start) AS first, arg_max(p50, week_start) AS last FROM weekly GROUP BY part_mpn)
SELECT part_mpn, round(low, 9) AS low, round(high, 9) AS high, round(first, 9) AS first, round(last, 9) AS last,
       round((last - first) / nullif(first, 0) * 100, 9) AS change_pct FROM s""",
    "history_projection": f"""WITH {QUOTES_LEAD}, {WEEKLY}, l AS (
  SELECT part_mpn, week_start, avg(lead_time_days) AS avg_lead FROM quotes GROUP BY ALL
), k AS (SELECT *, row_number() OVER (PARTITION BY part_mpn ORDER BY week_start DESC) AS k FROM weekly JOIN l USING (part_mpn, week_start))
SELECT part_mpn, week_start, round(p25, 9) AS p25, round(p50, 9) AS p50, round(p75, 9) AS p75, round(avg_lead, 9) AS avg_lead FROM k WHERE k <= 52""",
    "series_arrays": f"""WITH {QUOTES}, {WEEKLY}, s AS (
  SELECT part_mpn, list(quotes ORDER BY week_start) AS q FROM weekly GROUP BY part_mpn)
SELECT part_mpn, CAST(len(q) AS INT) AS weeks, array_to_string(q, ',') AS quotes, array_to_string(q[-4:], ',') AS last_four FROM s""",
    "week_spine": f"""WITH {QUOTES}, {WEEKLY}, e AS (
  SELECT part_mpn, unnest(generate_series(CAST(min(week_start) AS TIMESTAMP), CAST(max(week_start) AS TIMESTAMP), INTERVAL 7 DAY)) AS w FROM weekly GROUP BY part_mpn)
SELECT e.part_mpn, CAST(w AS DATE) AS week_start, coalesce(quotes, 0) AS quotes
FROM e LEFT JOIN weekly k ON k.part_mpn = e.part_mpn AND k.week_start = CAST(w AS DATE)""",
    "min_history": f"WITH {QUOTES} SELECT part_mpn, count(DISTINCT week_start) AS weeks FROM quotes GROUP BY 1 HAVING count(DISTINCT week_start) >= {LEAST_WEEKS}",
    "series_scan": f"""WITH {QUOTES} SELECT part_mpn, count(*) AS n, round(min(quoted_price), 9) AS low FROM quotes
WHERE part_mpn IN (SELECT p_brand FROM part WHERE p_partkey % 11 = 0) GROUP BY part_mpn""",
    "error_metrics": f"""{_ALL} SELECT CASE WHEN abs((predicted - actual) / actual) < 0.005 THEN 'flat' WHEN predicted > actual THEN 'up' ELSE 'down' END AS direction,
       count(*) AS n FROM predictions WHERE model = 'naive' GROUP BY 1""",
}
