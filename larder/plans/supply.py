"""Warehouse and kitchen supply plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from larder.functions.text import contains_ignore_case, equals_ignore_case
from larder.operators import joins, stock as st

LOW_HEADROOM = 0.10
STATUS_ORDER = ["RED", "YELLOW", "GREEN"]


def rank_of(col: Column, order: list[str]) -> Column:
    """Position of a value in a fixed order, unknown values last."""
    out = F.when(col == order[0], 0)
    for i, value in enumerate(order[1:], start=1):
        out = out.when(col == value, i)
    return out.otherwise(len(order))


def red_first(df: DataFrame, *then: str) -> DataFrame:
    return df.orderBy(rank_of(F.col("status"), STATUS_ORDER), *then)


def horizon_total(forecast: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Predicted quantity per item and outlet over ``days`` from the first forecast day on or after ``as_of``."""
    start = forecast.where(F.col("forecast_date") >= as_of).select(F.min("forecast_date")).scalar()
    window = F.col("forecast_date").between(start, F.date_add(start, days - 1))
    return forecast.where(window).groupBy("sku", "outlet").agg(F.round(F.sum("qty_predicted"), 2).alias("total_predicted"))


def _status(net: Column, need: Column, held: Column, floor: Column) -> Column:
    headroom = F.try_divide(held - need, floor)
    return F.when(net > 0, "RED").when((need > 0) & (headroom < LOW_HEADROOM), "YELLOW").otherwise("GREEN")


def warehouse_plan(need: DataFrame, stock: DataFrame, location: str = "location") -> DataFrame:
    """Shortage per ingredient: total need against the newest warehouse stock."""
    held = st.warehouse_stock(stock, location, "plan")
    joined = joins.left_or_zero(
        need.withColumn("ingredient", F.trim("ingredient")), held, "ingredient", ["warehouse_stock"]
    )
    net = F.round(F.greatest(F.col("total_qty_needed") - F.col("warehouse_stock"), F.lit(0.0)), 2)
    out = joined.withColumn("net_requirement", net)
    status = _status(
        F.col("net_requirement"), F.col("total_qty_needed"), F.col("warehouse_stock"), F.col("total_qty_needed")
    )
    return red_first(out.withColumn("status", status), "ingredient")


def warehouse_view(
    recipe_need: DataFrame,
    stock: DataFrame,
    location: str = "location",
    status: str | None = None,
    ingredient: str | None = None,
) -> DataFrame:
    """The listing variant: need from recipes, lower-cased ingredients, shortage not clipped at 0.

    ``stock`` is a warehouse table, so every location counts.
    """
    newest = st.latest_ties(stock, [location, "ingredient"])
    held = newest.groupBy(F.lower(F.trim("ingredient")).alias("ingredient")).agg(
        F.sum("qty_available").alias("warehouse_stock")
    )
    need = recipe_need.withColumn("ingredient", F.lower(F.trim("ingredient")))
    joined = joins.left_or_zero(need, held, "ingredient", ["warehouse_stock"])
    out = joined.withColumn("net_requirement", F.round(F.col("total_qty_needed") - F.col("warehouse_stock"), 2))
    level = _status(
        F.col("net_requirement"), F.col("total_qty_needed"), F.col("warehouse_stock"),
        F.greatest(F.col("total_qty_needed"), F.lit(1.0)),
    )
    out = out.withColumn("status", level)
    if status:
        out = out.where(F.col("status") == status.upper())
    if ingredient:
        out = out.where(contains_ignore_case(F.col("ingredient"), ingredient))
    return red_first(out, "ingredient")


def supply_base(demand: DataFrame, skus: DataFrame, stock: DataFrame, tracker: DataFrame, as_of: Column) -> DataFrame:
    """Three-day demand with network stock and safety stock per item."""
    soon = demand.where(F.col("forecast_date").between(as_of, F.date_add(as_of, 3)))
    need = (
        soon.groupBy(F.col("ingredient").alias("sku_code"), F.col("outlet").alias("kitchen"))
        .agg(F.round(F.sum("total_qty_needed"), 2).alias("forecast_3day"))
        .join(skus.select("sku_code", F.col("sku_name").alias("sku")), "sku_code")
    )
    held = (
        st.latest_ties(stock, ["kitchen", "ingredient"])
        .groupBy(F.col("ingredient").alias("sku_code"))
        .agg(F.sum("qty_available").alias("stock_qty"))
        .withColumn("kitchen", F.lit("ALL"))
    )
    safety = tracker.select(
        F.lower("ingredient").alias("_s"), (F.col("drr") * F.col("lead_time_days")).alias("safety_stock_qty")
    )
    return (
        need.join(held, ["sku_code", "kitchen"], "left")
        .join(safety, F.lower("sku") == F.col("_s"), "left")
        .select(
            "sku_code", "sku", "kitchen", "forecast_3day",
            F.coalesce("stock_qty", F.lit(0.0)).alias("stock_qty"),
            F.coalesce("safety_stock_qty", F.lit(0.0)).alias("safety_stock_qty"),
        )
    )


def supply_plan(base: DataFrame, kitchen: str | None = None, status: str | None = None) -> DataFrame:
    need = F.col("forecast_3day") + F.col("safety_stock_qty") - F.col("stock_qty")
    out = base.withColumn("replenishment_needed", F.round(F.greatest(need, F.lit(0.0)), 2))
    fill = F.col("replenishment_needed")
    level = (
        F.when(fill <= 0, "GREEN")
        .when((F.col("forecast_3day") > 0) & (fill > 0.5 * F.col("forecast_3day")), "RED")
        .otherwise("YELLOW")
    )
    out = out.withColumn("status", level)
    if kitchen:
        out = out.where(equals_ignore_case(F.col("kitchen"), kitchen))
    if status:
        out = out.where(F.col("status") == status.upper())
    return red_first(out, "sku_code", "kitchen")


def status_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("status").agg(F.count("*").alias("n"))
