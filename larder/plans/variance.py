"""Expected against actual ingredient use."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from larder.functions.text import contains_ignore_case, equals_ignore_case
from larder.operators import recipes as rc
from larder.operators.joins import first_rows

WINDOW_DAYS = 7
# Thresholds in percent where an ingredient has none of its own.
GREEN_PCT, YELLOW_PCT = 5.0, 15.0
KEYS = ["date", "outlet", "ingredient"]


def usage_of(r) -> tuple[DataFrame, DataFrame]:
    """(expected, actual) of the last seven order days of the supplied tables."""
    start = F.date_sub(r.order_as_of, WINDOW_DAYS - 1).cast("timestamp_ntz")
    recent = F.col("o_orderdate") >= start
    expected = rc.expected_usage(
        r.pos_order_items(recent), r.pos_orders(recent).select("id", "order_date", "store_name"),
        r.item_alias(), r.recipe_master(), r.dim_sku(), r.dim_ingredients(),
    )
    return expected, rc.actual_usage(r.actual_usage(recent))


def expected_and_actual(expected: DataFrame, actual: DataFrame) -> DataFrame:
    return expected.join(actual, KEYS, "full")


def report(expected: DataFrame, actual: DataFrame, display: bool = False) -> DataFrame:
    """One row per day, outlet and ingredient with any use. Nothing expected counts as 100 percent."""
    both = expected_and_actual(expected, actual).select(
        *KEYS,
        F.coalesce("expected_qty", F.lit(0.0)).alias("expected_qty"),
        F.coalesce("actual_qty", F.lit(0.0)).alias("actual_qty"),
        F.coalesce("unit", F.lit("units")).alias("unit"),
    )
    diff = F.round(F.col("actual_qty") - F.col("expected_qty"), 8)
    out = both.where((F.col("expected_qty") > 0) | (F.col("actual_qty") > 0)).withColumn("variance_qty", diff)
    pct = F.when(F.col("expected_qty") > 0, F.col("variance_qty") / F.col("expected_qty") * 100).otherwise(100.0)
    out = out.withColumn("variance_pct", F.round(pct, 4))
    if display:
        out = out.withColumns({c: F.initcap(c) for c in ("outlet", "ingredient")})
    return out


def flagged(
    rows: DataFrame,
    settings: DataFrame,
    mapped: DataFrame,
    outlet: str | None = None,
    ingredient: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Traffic light per row, largest variance first; a ``limit`` cuts the flagged rows. ``settings`` holds thresholds per ingredient and the fallback under ``*``."""
    if outlet:
        rows = rows.where(equals_ignore_case(F.col("outlet"), outlet))
    if ingredient:
        rows = rows.where(contains_ignore_case(F.col("ingredient"), ingredient))
    totals = rows.groupBy(*KEYS, "unit").agg(
        *[F.round(F.sum(c), 2).alias(c) for c in ("expected_qty", "actual_qty", "variance_qty")]
    )
    own = settings.where(F.col("ingredient") != "*").select(
        F.lower("ingredient").alias("_i"), F.col("green_threshold").alias("_g"), F.col("yellow_threshold").alias("_y")
    )
    fallback = settings.where(F.col("ingredient") == "*")

    def default(col: str, value: float):
        return F.coalesce(fallback.select(F.max(col)).scalar(), F.lit(value))

    known = mapped.select(F.col("ingredient").alias("_m")).distinct()
    name = F.lower("ingredient")
    joined = totals.join(own, name == F.col("_i"), "left").join(known, name == F.col("_m"), "left")
    exp, act, var = F.col("expected_qty"), F.col("actual_qty"), F.col("variance_qty")
    pct = F.when(exp > 0, var / exp * 100).when(act > 0, F.lit(100.0)).otherwise(0.0)
    unmapped = (exp == 0) & (act > 0) & F.col("_m").isNull()
    green = F.coalesce("_g", default("green_threshold", GREEN_PCT))
    yellow = F.coalesce("_y", default("yellow_threshold", YELLOW_PCT))
    flag = (
        F.when(unmapped, "unmapped").when(F.abs(pct) <= green, "green").when(F.abs(pct) <= yellow, "yellow").otherwise("red")
    )
    out = joined.select(
        *KEYS, "unit", exp, act, var, F.when(~unmapped, F.round(pct, 2)).alias("variance_pct"), flag.alias("flag")
    )
    return first_rows(out.orderBy(F.col("variance_qty").desc(), *KEYS), limit)
