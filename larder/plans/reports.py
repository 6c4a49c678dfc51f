"""Dashboard and catalog reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from larder.functions.dates import LOCAL_ZONE
from larder.functions.numbers import accuracy_pct
from larder.operators import accuracy
from larder.operators.cleaning import keep_first, keep_last

COST_SHARE = 0.33
ACCURACY_DAYS = 14


def dashboard(
    sales: DataFrame,
    forecast: DataFrame,
    recs: DataFrame,
    pos: DataFrame,
    alerts: DataFrame,
    newest: Column,
    as_of: Column,
) -> DataFrame:
    """One row of key figures.

    Each source is reduced to one row on its own; the figures are then scalar
    subqueries of a single projection, so nothing is joined.
    ``newest`` is the last sales day, ``as_of`` the day forecasts are read for.
    """
    recs_row = recs.agg(
        F.sum(F.when(F.col("urgency").isin("URGENT", "WARNING"), F.col("estimated_cost"))).alias("cost"),
        F.sum("total_demand").alias("need"),
        F.sum(F.least("total_demand", "warehouse_stock")).alias("covered"),
    ).select(
        F.struct(
            F.coalesce(F.round(F.col("cost") / COST_SHARE, 2), F.lit(0.0)).alias("revenue_at_risk"),
            F.when(F.col("need") > 0, F.round(F.col("covered") / F.col("need") * 100, 4)).otherwise(100.0).alias("sufficiency"),
        )
    ).scalar()
    open_po = F.coalesce(F.col("status") != "Delivered", F.lit(False))
    pos_row = pos.agg(
        F.struct(
            F.count_if(open_po).alias("open"), F.count_if(open_po & (F.col("expected_date") < as_of)).alias("late")
        )
    ).scalar()
    log_row = alerts.where(F.col("resolved") == 0).agg(
        F.struct(F.count("*").alias("active"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"))
    ).scalar()
    pairs = accuracy.scored(forecast.where(F.col("forecast_date") >= F.date_sub(as_of, ACCURACY_DAYS)), sales)
    score = pairs.agg(F.round(accuracy_pct(F.sum("abs_err"), F.sum("qty_sold")), 4)).scalar()
    today = sales.where(F.col("date") == newest).agg(F.coalesce(F.sum("qty_sold"), F.lit(0.0)).cast("bigint")).scalar()
    risk = (
        forecast.where((F.col("forecast_date") == as_of) & (F.col("qty_predicted") > 0))
        .agg(F.countDistinct("sku")).scalar()
    )
    one = sales.sparkSession.range(1)
    row = one.select(
        today.alias("total_orders_today"), risk.alias("skus_at_risk"), recs_row.alias("r"), score.alias("forecast_accuracy_percent"),
        pos_row.alias("p"), log_row.alias("a"),
    )
    return row.select(
        "total_orders_today", "skus_at_risk",
        F.col("r.revenue_at_risk").alias("revenue_at_risk"), "forecast_accuracy_percent",
        F.col("p.open").alias("total_open_pos"), F.col("p.late").alias("overdue_pos"),
        F.col("r.sufficiency").alias("warehouse_sufficiency_pct"),
        F.col("a.active").alias("active_alerts_count"), F.col("a.critical").alias("critical_alerts_count"),
    )


def outlets_by_city(outlets: DataFrame) -> DataFrame:
    """Sorted outlet names per city, from the (small) outlet dimension."""
    distinct = outlets.select("city", "outlet").distinct()
    return distinct.groupBy("city").agg(F.sort_array(F.collect_list("outlet")).alias("outlets"))


def build_dimensions(feed: DataFrame, order: list[str]) -> dict[str, DataFrame]:
    """Ingredient and outlet dimensions (first attributes seen) and the outlet-item mapping of a consumption feed."""
    return {
        "dim_ingredients": keep_first(feed.select("sku_code", "sku", *order), ["sku_code"], order).select("sku_code", "sku"),
        "dim_outlets": keep_first(feed.select("outlet", "city", *order), ["outlet"], order).select("outlet", "city"),
        "mapping": feed.select("outlet", "sku_code").distinct(),
    }


def latest_version_before(versions: DataFrame, key: list[str], today: Column) -> DataFrame:
    """Newest plan version whose local plan date lies strictly before ``today``."""
    day = F.to_date(F.from_utc_timestamp(F.col("plan_date").cast("timestamp"), LOCAL_ZONE))
    past = versions.withColumn("entry_date", day).where(F.col("entry_date") < today)
    return keep_last(past, key, ["plan_date", "version"])


def load_once(versions: DataFrame) -> DataFrame:
    """Each version once, with the dates it covers counted."""
    return versions.groupBy("version").agg(
        F.min("entry_date").alias("first_date"), F.max("entry_date").alias("last_date"), F.count("*").alias("dates")
    )
