"""Sales rollups and report aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from larder.functions import numbers
from larder.operators.joins import first_rows

TOP_SKUS = 10
TOP_MOVERS = 5


def order_item_join(items: DataFrame, orders: DataFrame) -> DataFrame:
    """Items with their order. An order holding a large share of the lines is split by the AQE skew join."""
    return items.join(orders, F.col("order_id") == F.col("id"), "inner")


def pos_detail(items_text: DataFrame, orders: DataFrame, limit: int | None = None) -> DataFrame:
    """Sales by day, item and place from textual order lines, newest first."""
    joined = order_item_join(items_text, orders.select("id", "order_date", "brand_name", "store_name", "city"))
    totals = (
        joined.groupBy(
            F.col("order_date").alias("date"), F.col("item_name").alias("sku"), F.col("brand_name").alias("brand"),
            F.col("store_name").alias("outlet"), "city",
        )
        .agg(
            F.sum(numbers.parse_formatted(F.col("quantity"))).cast("double").alias("qty_sold"),
            F.sum(numbers.parse_formatted(F.col("total_price"))).cast("double").alias("revenue"),
            F.countDistinct("id").alias("order_count"),
        )
        .orderBy(F.col("date").desc(), "sku", "brand", "outlet", "city")
    )
    return first_rows(totals, limit)


def consumption(sales: DataFrame, limit: int | None = None) -> DataFrame:
    """Totals over the whole range, without the date: far fewer groups than the daily table."""
    totals = (
        sales.groupBy("sku", "brand", "outlet", "city")
        .agg(
            F.sum("qty_sold").alias("qty_sold"),
            F.round(F.sum("revenue"), 2).alias("revenue"),
            F.sum("order_count").alias("order_count"),
        )
        .orderBy(F.col("qty_sold").desc_nulls_last(), "sku", "brand", "outlet", "city")
    )
    return first_rows(totals, limit)


def order_summary(orders: DataFrame, items: DataFrame, amount: str = "total_amount") -> DataFrame:
    """One row of totals; the average order value is 0 without orders."""
    sold = order_item_join(items.select("order_id", "item_name"), orders.select("id"))
    revenue, count = F.coalesce(F.sum(amount), F.lit(0.0)), F.count("id")
    totals = orders.agg(revenue.alias("revenue"), count.alias("total_orders"))
    return totals.select(
        F.round("revenue", 2).alias("total_revenue"),
        "total_orders",
        F.coalesce(F.round(F.try_divide("revenue", "total_orders"), 2), F.lit(0.0)).alias("avg_order_value"),
        sold.select(F.countDistinct("item_name")).scalar().alias("unique_skus"),
    )


def sales_summary(sales: DataFrame) -> DataFrame:
    total = sales.agg(
        F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("revenue"),
        F.coalesce(F.sum("order_count"), F.lit(0)).alias("total_orders"),
        F.coalesce(F.sum("qty_sold"), F.lit(0.0)).alias("total_qty"),
        F.countDistinct("sku").alias("unique_skus"),
    )
    return total.select(
        F.round("revenue", 2).alias("total_revenue"),
        "total_orders",
        "total_qty",
        F.coalesce(F.round(F.try_divide("revenue", "total_orders"), 2), F.lit(0.0)).alias("avg_order_value"),
        "unique_skus",
    )


def top_skus(sales: DataFrame, k: int = TOP_SKUS) -> DataFrame:
    return (
        sales.groupBy("sku")
        .agg(F.sum("qty_sold").alias("total_qty"), F.round(F.sum("revenue"), 2).alias("total_revenue"))
        .orderBy(F.col("total_qty").desc_nulls_last(), "sku")
        .limit(k)
    )


def top_movers(sales: DataFrame, tracked: DataFrame, sku: str = "sku", k: int = TOP_MOVERS) -> DataFrame:
    """Most sold tracked items of the frame (the caller bounds the days)."""
    moved = sales.groupBy(sku).agg(F.sum("qty_sold").alias("total_qty"))
    return (
        moved.join(tracked.select(F.col("code").alias(sku)).distinct(), sku, "left_semi")
        .orderBy(F.col("total_qty").desc_nulls_last(), sku)
        .limit(k)
    )


def by_brand(orders: DataFrame) -> DataFrame:
    return (
        orders.groupBy(F.col("brand_name").alias("brand"))
        .agg(F.round(F.sum("total_amount"), 2).alias("revenue"), F.count("id").alias("orders"))
        .orderBy(F.col("revenue").desc_nulls_last(), "brand")
    )


def rollup_with_attributes(df: DataFrame, key: list[str], qty: str, attributes: list[str], order: Column) -> DataFrame:
    """Sum per key; descriptive attributes from the first row in ``order``."""
    return df.groupBy(*key).agg(
        F.sum(qty).alias(qty), *[F.min_by(F.col(a), order).alias(a) for a in attributes]
    )


def share_of_total(df: DataFrame, col: str, out: str = "percentage") -> DataFrame:
    """Percentage of the grand total. The total is a scalar subquery: no single-partition window."""
    total = df.select(F.sum(col)).scalar()
    return df.withColumn(
        out, F.when(total > 0, F.round(F.try_divide(F.col(col), total) * 100, 2)).otherwise(F.lit(0.0))
    )


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = part if out is None else out.unionByName(part)
    return out
