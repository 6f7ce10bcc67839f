"""Rolling-origin evaluation of forecasts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import forecast
from .pricing import VOLATILE, heat_asof, indexed

TRAIN_WEEKS, ORIGINS = 78, 25
#: Models that SQL can say; and the three that are evaluated, first ones first where they tie.
MODELS = ("naive", "mean4")
FULL_MODELS = ("naive", "gbm", "arima")


def _evaluated(weeks: DataFrame) -> DataFrame:
    """The weeks that are origins, with what comes next; a part needs a week more than training and origins.

    A week is in a spike by the heat known in it.
    """
    by_week = Window.partitionBy("part_mpn").orderBy("week_start")
    rows = indexed(heat_asof(weeks)).withColumns(
        {
            "n": F.count("*").over(Window.partitionBy("part_mpn")),
            "actual": F.lead("p50").over(by_week),
            "during_spike": F.lead("heat_index").over(by_week) > VOLATILE,
            "naive": F.col("p50"),
            "mean4": F.avg("p50").over(by_week.rowsBetween(-3, 0)),
        }
    )
    rows = rows.where(F.col("n") >= TRAIN_WEEKS + ORIGINS + 1)
    return rows.where(F.col("week_index").between(TRAIN_WEEKS - 1, TRAIN_WEEKS + ORIGINS - 2))


def _described(rows: DataFrame, parts: DataFrame) -> DataFrame:
    rows = rows.select("part_mpn", (F.col("week_index") + 1).alias("week_index"), "model", "actual", "predicted", "during_spike")
    meta = rows.join(parts, "part_mpn", "left")
    return meta.withColumns({"lifecycle": F.coalesce("lifecycle", F.lit("Active")), "category": F.coalesce("category", F.lit(""))})


def predictions(weeks: DataFrame, parts: DataFrame) -> DataFrame:
    """A row for each part, origin and model: last median, and the mean of the last four."""
    rows = _evaluated(weeks)
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("predicted")) for m in MODELS]))
    return _described(rows.select("part_mpn", "week_index", "actual", "during_spike", each.alias("m")).select("*", "m.model", "m.predicted"), parts)


def full_predictions(weeks: DataFrame, features: DataFrame, parts: DataFrame, origins: list[int], trees: int = 200) -> DataFrame:
    """A row for each part, origin and model of FULL_MODELS: boosted trees are fitted anew at each origin on what was
    known then, ARIMA once a part. origins: week numbers, the last week known at each."""
    rows = _evaluated(weeks).where(F.col("week_index").isin(origins))
    known = rows.select("part_mpn", "week_index", "actual", "during_spike")
    found = [
        rows.select("part_mpn", "week_index", F.col("naive").alias("predicted"), F.lit("naive").alias("model")),
        forecast.rolling_gbm(features, origins, trees).select("part_mpn", "week_index", "predicted", F.lit("gbm").alias("model")),
        forecast.rolling_arima(weeks, origins).select("part_mpn", "week_index", "predicted", F.lit("arima").alias("model")),
    ]
    return _described(reduce(DataFrame.unionByName, found).join(known, ["part_mpn", "week_index"]), parts)


def with_errors(found: DataFrame) -> DataFrame:
    error = F.col("actual") - F.col("predicted")
    return found.withColumns({"ape": F.abs(error) / F.col("actual"), "se": error * error})


def _metrics():
    return [
        F.count("*").alias("n"), F.avg("ape").alias("mape"), F.percentile("ape", F.lit(0.5)).alias("median_ape"),
        F.sqrt(F.avg("se")).alias("rmse"),
    ]


def segments(found: DataFrame) -> DataFrame:
    """Metrics by model in five segments; a row is in several of them."""
    dead = F.col("lifecycle").isin("Obsolete", "EOL")
    names = F.array_compact(
        F.array(
            F.lit("overall"), F.when(dead, "obsolete").otherwise("active"),
            F.when(F.col("during_spike"), "during_spike").otherwise("normal"),
        )
    )
    return with_errors(found).withColumn("segment", F.explode(names)).groupBy("segment", "model").agg(*_metrics())


def by_lifecycle(found: DataFrame) -> DataFrame:
    return with_errors(found).groupBy("lifecycle", "model").agg(*_metrics())


def wins(found: DataFrame, models: tuple[str, ...] = MODELS) -> DataFrame:
    """How often each model was nearest; ties go to the first of the models, weeks without all of them don't count."""
    order = F.array_position(F.array(*map(F.lit, models)), F.col("model"))
    best = with_errors(found).groupBy("part_mpn", "week_index").agg(
        F.min_by("model", F.struct("ape", order)).alias("model"), F.count("*").alias("k")
    )
    won = best.where(F.col("k") == len(models)).groupBy("model").agg(F.count("*").alias("wins"))
    return won.withColumn("share", F.col("wins") / F.sum("wins").over(Window.partitionBy()))


def ranked(found: DataFrame) -> DataFrame:
    scores = with_errors(found).groupBy("model").agg(F.avg("ape").alias("mape"))
    return scores.withColumn("rank", F.row_number().over(Window.orderBy("mape", "model")))


def side_by_side(found: DataFrame) -> DataFrame:
    return found.groupBy("part_mpn", "week_index", "actual").pivot("model", list(MODELS)).agg(F.first("predicted"))


def report(found: DataFrame) -> str:
    """The models in order, as a table of Markdown: a row a segment and model."""
    rows = segments(found).orderBy("segment", "mape", "model").collect()  # five segments by a few models
    lines = ["| segment | model | n | MAPE | median APE | RMSE |", "|---|---|---:|---:|---:|---:|"]
    lines += [f"| {r.segment} | {r.model} | {r.n} | {r.mape:.1%} | {r.median_ape:.1%} | {r.rmse:.2f} |" for r in rows]
    return "\n".join(lines)


def forecaster(name: str) -> str:
    """The model's name, if there is one of it."""
    if name not in FULL_MODELS:
        raise ValueError(f"unknown model {name!r}; there are {', '.join(FULL_MODELS)}")
    return name
