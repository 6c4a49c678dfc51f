"""Statistical forecasts that are plain aggregates and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

HORIZON = 30
AVERAGED_DAYS = 14
BAND = 0.2


def with_band(df: DataFrame, qty: str = "qty_predicted", band: float = BAND) -> DataFrame:
    """Lower and upper bound around a non-negative, rounded prediction."""
    q = F.greatest(F.col(qty), F.lit(0.0))
    return df.withColumns(
        {
            "qty_lower": F.round(q * (1 - band), 2),
            "qty_upper": F.round(q * (1 + band), 2),
            qty: F.round(q, 2),
        }
    )


def over_horizon(levels: DataFrame, run_date: Column, horizon: int = HORIZON) -> DataFrame:
    """One row per future day; the horizon is exploded in place, without a join."""
    days = F.sequence(F.date_add(run_date, 1), F.date_add(run_date, horizon))
    return levels.withColumn("forecast_date", F.explode(days)).withColumn("model_run_date", run_date)


def recent_mean(history: DataFrame, keys: list[str], n: int = AVERAGED_DAYS) -> DataFrame:
    """Mean of the last ``n`` observed days per series.

    Filtering on the row number lets Spark cut each series to ``n`` rows before
    the shuffle, so a long series costs its reducer no more than a short one.
    """
    newest = W.partitionBy(*keys).orderBy(F.col("date").desc())
    return (
        history.withColumn("rn", F.row_number().over(newest))
        .where(F.col("rn") <= n)
        .groupBy(*keys)
        .agg(F.avg("qty_sold").alias("level"))
    )


def moving_average(
    history: DataFrame,
    run_date: Column,
    keys: list[str],
    n: int = AVERAGED_DAYS,
    horizon: int = HORIZON,
) -> DataFrame:
    """Flat forecast at the recent mean, with its band."""
    flat = over_horizon(recent_mean(history, keys, n), run_date, horizon)
    return with_band(flat.withColumnRenamed("level", "qty_predicted")).select(
        "forecast_date", *keys, "qty_predicted", "qty_lower", "qty_upper", "model_run_date"
    )


def ewma(history: DataFrame, keys: list[str], span: int = 7) -> DataFrame:
    """Exponentially weighted mean over each series' calendar days, absent days counting as zero.

    The weight depends only on the distance to the last day, and the weights of
    all days add up to a closed form, so the gaps never have to be filled in.
    """
    decay = 1.0 - 2.0 / (span + 1)
    last = F.max("date").over(W.partitionBy(*keys))
    weighted = history.withColumn("age", F.datediff(last, F.col("date")))
    length = F.max("age") + 1
    total_weight = (F.lit(1.0) - F.pow(F.lit(decay), length)) / (1.0 - decay)
    return weighted.groupBy(*keys).agg(
        (F.sum(F.col("qty_sold") * F.pow(F.lit(decay), F.col("age"))) / total_weight).alias("level")
    )


def ingredient_demand(forecast: DataFrame, unit: str = "unit") -> DataFrame:
    """Network demand per day and ingredient from an item forecast."""
    return (
        forecast.groupBy("forecast_date", F.col("sku").alias("ingredient"))
        .agg(F.round(F.sum("qty_predicted"), 2).alias("total_qty_needed"))
        .select("forecast_date", F.lit("ALL").alias("outlet"), "ingredient", F.lit(unit).alias("unit"), "total_qty_needed")
    )


def demand_total(demand: DataFrame) -> DataFrame:
    return demand.groupBy("ingredient").agg(F.round(F.sum("total_qty_needed"), 2).alias("total_qty_needed"))


def history_depth(history: DataFrame, min_days: int = 30) -> DataFrame:
    """Series with enough distinct days of history."""
    return (
        history.groupBy("sku", "outlet")
        .agg(F.countDistinct("date").alias("days"), F.sum("qty_sold").alias("total_qty"))
        .where(F.col("days") >= min_days)
    )


def active_combos(recent: DataFrame) -> DataFrame:
    return recent.groupBy("sku", "outlet").agg(F.sum("qty_sold").alias("qty")).where(F.col("qty") > 0)


def top_combos(recent: DataFrame, k: int | None = 100) -> DataFrame:
    """The ``k`` series that sold most, ties by name; with None every series that sold."""
    sold = recent.groupBy("sku", "outlet").agg(F.sum("qty_sold").alias("qty"))
    return sold if k is None else sold.orderBy(F.col("qty").desc(), "sku", "outlet").limit(k)
