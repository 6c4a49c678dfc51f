"""Join shapes used by several plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from larder.operators.skew import salted_join


def first_rows(df: DataFrame, limit: int | None) -> DataFrame:
    """The whole result, or as many leading rows as the caller asks for."""
    return df if limit is None else df.limit(limit)


def left_or_zero(df: DataFrame, other: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Left join whose missing values are 0."""
    return df.join(other, key, "left").withColumns({v: F.coalesce(F.col(v), F.lit(0.0)) for v in values})


def vendor_left(df: DataFrame, vendors: DataFrame) -> DataFrame:
    """Vendor attributes with the planning defaults where the vendor is unknown."""
    return df.join(vendors.withColumn("ingredient", F.trim("ingredient")), "ingredient", "left").withColumns(
        {
            "vendor_name": F.coalesce("vendor_name", F.lit("Unknown Vendor")),
            "lead_time_days": F.coalesce(F.col("lead_time_days").try_cast("int"), F.lit(7)),
            "moq": F.coalesce(F.col("moq").try_cast("double"), F.lit(1.0)),
            "price": F.coalesce(F.col("price").try_cast("double"), F.lit(0.0)),
        }
    )


def tracked_only(df: DataFrame, column: str, tracked: DataFrame, hot: Column | None = None) -> DataFrame:
    """Rows whose code is tracked; ``hot`` are the codes worth salting, all if not given."""
    return salted_join(df, tracked.select(F.col("code").alias(column)).distinct(), [column], "left_semi", hot=hot)


def active_pairs(stock: DataFrame, sold: DataFrame) -> DataFrame:
    """Stock rows at outlets that sold the item; outlets compare case-insensitively."""
    pairs = sold.select(F.lower("outlet").alias("_outlet"), F.col("sku").alias("_sku")).distinct()
    return stock.join(
        pairs, (F.lower("kitchen") == F.col("_outlet")) & (F.col("ingredient") == F.col("_sku")), "left_semi"
    )


def with_network_label(skus: DataFrame, forecast: DataFrame, limit: int | None = None) -> DataFrame:
    """Every item, also without a forecast, which then stands for the whole network."""
    labelled = (
        skus.join(forecast, F.col("sku_code") == F.col("sku"), "left")
        .select(
            "sku_code",
            F.col("sku_name").alias("sku"),
            F.coalesce("outlet", F.lit("Network-Wide")).alias("outlet"),
            F.coalesce("total_predicted", F.lit(0.0)).alias("total_predicted"),
        )
        .orderBy(F.col("total_predicted").desc(), "sku_code", "outlet")
    )
    return first_rows(labelled, limit)


def with_city(df: DataFrame, outlets: DataFrame, outlet: str = "outlet") -> DataFrame:
    """City of the outlet, NULL where it has none (such as the network-wide label)."""
    cities = outlets.select(F.col("outlet").alias("_o"), F.col("city").alias("mapped_city"))
    return df.join(cities, F.col(outlet) == F.col("_o"), "left").drop("_o")


def update_from(target: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """New column values where ``updates`` has the key, the old ones elsewhere."""
    fresh = updates.select(key, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_hit"))
    joined = target.join(fresh, key, "left")
    return joined.select(
        *[
            F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
            for c in target.columns
        ]
    )


def on_calendar(combos: DataFrame, start: Column, end: Column) -> DataFrame:
    """Every combination on every day. The days are exploded inside each row: no join, no shuffle."""
    return combos.withColumn("date", F.explode(F.sequence(start, end)))
