"""Forecast accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from larder.functions.dates import week_start
from larder.functions.numbers import accuracy_pct


def scored(forecast: DataFrame, actual: DataFrame, dense: bool = False) -> DataFrame:
    """Forecast next to the actual of the same item, outlet and day.

    Days without a sale have no actual row; they are left out of the score, or
    counted as zero sales with ``dense``.
    """
    truth = actual.select("sku", "outlet", F.col("date").alias("forecast_date"), "qty_sold")
    out = forecast.join(truth, ["sku", "outlet", "forecast_date"], "left" if dense else "inner")
    if dense:
        out = out.withColumn("qty_sold", F.coalesce("qty_sold", F.lit(0.0)))
    return out.withColumn("abs_err", F.abs(F.col("qty_predicted") - F.col("qty_sold")))


def wmape(pairs: DataFrame, *keys, out: str = "accuracy") -> DataFrame:
    """``max(0, 100 (1 - sum|error| / sum actual))`` per key, or over everything without keys."""
    totals = pairs.groupBy(*keys).agg(F.sum("abs_err").alias("_e"), F.sum("qty_sold").alias("_a"))
    names = [c for c in totals.columns if c not in ("_e", "_a")]
    return totals.select(*names, F.round(accuracy_pct(F.col("_e"), F.col("_a")), 4).alias(out))


def wmape_weekly(pairs: DataFrame) -> DataFrame:
    return wmape(pairs, week_start(F.col("forecast_date")).alias("week")).orderBy("week")


def mape_accuracy(pairs: DataFrame, actual: Column, predicted: Column, *keys, empty: float | None = None) -> DataFrame:
    """``max(0, 100 - MAPE)`` over rows with positive actuals; ``empty`` where there are none."""
    error = F.avg(F.when(actual > 0, F.abs(predicted - actual) / actual)) * 100
    value = F.greatest(F.lit(0.0), F.lit(100.0) - error)
    return pairs.groupBy(*keys).agg(
        F.round(F.when(error.isNotNull(), value).otherwise(F.lit(empty).cast("double")), 4).alias("accuracy")
    )


def mape_nonzero(pairs: DataFrame, actual: Column, predicted: Column, *keys) -> DataFrame:
    """Mean absolute percentage error over non-zero actuals; 0 where there are none."""
    error = F.avg(F.when(actual != 0, F.abs((actual - predicted) / actual))) * 100
    return pairs.groupBy(*keys).agg(F.round(F.coalesce(error, F.lit(0.0)), 4).alias("mape"))
