"""Purchase recommendations and the procurement tracker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from larder.functions.numbers import moq_round_up
from larder.functions.text import equals_ignore_case
from larder.operators import joins, stock as st

COVER_DAYS = 7
RUN_RATE_DAYS = 30
DEFAULT_LEAD_DAYS = 7.0


def open_quantity(pos: DataFrame, status: str = "open") -> DataFrame:
    return pos.where(F.col("status") == status).groupBy(F.trim("ingredient").alias("ingredient")).agg(
        F.sum("qty_ordered").alias("po_qty")
    )


def plan(
    demand: DataFrame,
    stock: DataFrame,
    pos: DataFrame,
    vendors: DataFrame,
    as_of: Column,
    location: str = "location",
    all_snapshots: bool = False,
) -> DataFrame:
    """Net requirement plus lead-time cover minus open orders, in whole minimum order quantities.

    The cover window holds both end days, and the daily rate divides by seven;
    both follow the published rule.
    """
    soon = demand.where(F.col("forecast_date").between(as_of, F.date_add(as_of, COVER_DAYS)))
    need = soon.groupBy(F.trim("ingredient").alias("ingredient"), "unit").agg(
        F.round(F.sum("total_qty_needed"), 2).alias("total_demand")
    )
    held = st.warehouse_stock(stock, location, "procurement", all_snapshots)
    recs = joins.left_or_zero(need, held, "ingredient", ["warehouse_stock"])
    recs = joins.left_or_zero(recs, open_quantity(pos), "ingredient", ["po_qty"])
    recs = joins.vendor_left(recs, vendors)
    recs = recs.withColumns(
        {
            "net_requirement": F.greatest(F.col("total_demand") - F.col("warehouse_stock"), F.lit(0.0)),
            "safety_buffer": F.col("total_demand") / COVER_DAYS * F.col("lead_time_days"),
        }
    )
    raw = F.col("net_requirement") + F.col("safety_buffer") - F.col("po_qty")
    recs = recs.withColumn("recommended_qty", moq_round_up(raw, F.col("moq"))).where(F.col("recommended_qty") > 0)
    urgent = (F.col("warehouse_stock") <= 0) & (F.col("total_demand") > 0)
    rounded = ["total_demand", "warehouse_stock", "net_requirement", "safety_buffer", "po_qty"]
    return recs.select(
        "ingredient", "unit",
        *[F.round(c, 2).alias(c) for c in rounded],
        "vendor_name", "lead_time_days", "moq", "price",
        F.round("recommended_qty", 2).alias("recommended_qty"),
        F.round(F.col("recommended_qty") * F.col("price"), 2).alias("estimated_cost"),
        F.date_add(as_of, F.col("lead_time_days")).alias("expected_delivery"),
        F.when(urgent, "URGENT").otherwise("NORMAL").alias("urgency"),
    )


def listing(recs: DataFrame, vendor: str | None = None, urgency: str | None = None) -> DataFrame:
    if vendor:
        recs = recs.where(equals_ignore_case(F.col("vendor_name"), vendor))
    if urgency:
        recs = recs.where(F.col("urgency") == urgency.upper())
    return recs.orderBy(F.when(F.col("urgency") == "URGENT", 0).otherwise(1), "vendor_name", "ingredient")


def vendor_groups(recs: DataFrame) -> DataFrame:
    """Subtotal per vendor and whether any line is urgent."""
    return recs.groupBy("vendor_name").agg(
        F.count("*").alias("lines"),
        F.round(F.sum("estimated_cost"), 2).alias("vendor_total"),
        F.bool_or(F.col("urgency") == "URGENT").alias("has_urgent"),
    )


def run_rate(recent: DataFrame, tracker: DataFrame, days: int = RUN_RATE_DAYS) -> DataFrame:
    """Daily rate per tracked code over sales the caller bounded."""
    sold = recent.groupBy(F.col("sku").alias("code")).agg(F.round(F.sum("qty_sold") / float(days), 4).alias("drr"))
    return sold.join(tracker.select("code").distinct(), "code", "left_semi")


def refresh_tracker(
    tracker: DataFrame, rates: DataFrame, stock: DataFrame, pos: DataFrame, location: str = "location",
    all_snapshots: bool = False,
) -> DataFrame:
    """Run rate, warehouse stock, open orders and the new order per tracked code."""
    held = st.warehouse_stock(stock, location, "run_rate", all_snapshots).toDF("code", "wh_sih")
    ordered = open_quantity(pos).toDF("code", "open_po")
    out = tracker.select(
        "code", "ingredient", F.coalesce(F.nullif(F.col("lead_time_days").cast("double"), F.lit(0.0)), F.lit(DEFAULT_LEAD_DAYS)).alias("lead_time_days")
    )
    out = joins.left_or_zero(out, rates.select("code", "drr"), "code", ["drr"])
    out = joins.left_or_zero(out, held, "code", ["wh_sih"])
    out = joins.left_or_zero(out, ordered, "code", ["open_po"])
    net = F.greatest(F.col("drr") * COVER_DAYS - F.col("wh_sih"), F.lit(0.0))
    raw = net + F.col("drr") * F.col("lead_time_days") - F.col("open_po")
    return out.withColumn("neworder", moq_round_up(F.round(raw, 4), F.lit(1.0)))
