"""Stock snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from larder.functions.locations import is_warehouse
from larder.operators.cleaning import keep_last


def latest_snapshot(stock: DataFrame, key: list[str], time: str = "snapshot_date", tie: list[str] | None = None) -> DataFrame:
    """Exactly one row per key, the newest."""
    return keep_last(stock, key, [time, *(tie or [])])


def latest_ties(stock: DataFrame, key: list[str], time: str = "snapshot_date") -> DataFrame:
    """All rows of the newest snapshot per key (ties kept)."""
    newest = F.rank().over(W.partitionBy(*key).orderBy(F.col(time).desc()))
    return stock.withColumn("_r", newest).where(F.col("_r") == 1).drop("_r")


def warehouse_stock(
    stock: DataFrame, location: str = "location", variant: str = "plan", all_snapshots: bool = False
) -> DataFrame:
    """Stock per ingredient over warehouse locations; the newest snapshot of each unless all are asked for."""
    held = stock.where(is_warehouse(F.col(location), variant))
    if not all_snapshots:
        held = latest_ties(held, [location, "ingredient"])
    return held.groupBy(F.trim("ingredient").alias("ingredient")).agg(F.sum("qty_available").alias("warehouse_stock"))
