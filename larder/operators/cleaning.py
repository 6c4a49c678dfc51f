"""Cleaning, deduplication and validation of feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from larder.functions import dates, numbers, text

# Order states that count as completed.
COMPLETED = ["completed", "delivered", "complete", "fulfilled", "done", "success"]


def completed_orders(df: DataFrame, status: str = "status") -> DataFrame:
    return df.where(F.lower(status).isin(COMPLETED))


def positive_quantity(df: DataFrame, qty: str, allow_zero: bool = False) -> DataFrame:
    """Numeric quantities, malformed ones counted as 0; keep > 0 (or >= 0)."""
    out = df.withColumn(qty, numbers.coerce(F.col(qty), 0))
    return out.where(F.col(qty) >= 0 if allow_zero else F.col(qty) > 0)


def drop_tombstones(df: DataFrame, sign: str = "sign") -> DataFrame:
    return df.where(F.col(sign).cast("string") == "1")


def _numbered(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """First row per key under a total order.

    ``row_number() = 1`` is cut to one row per key in every input partition
    before the shuffle (window group limit), so a key holding a large share of
    the rows does not gather them in one task.
    """
    rank = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    return df.withColumn("_rn", rank).where(F.col("_rn") == 1).drop("_rn")


def keep_last(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Newest version per key. ``order`` must end in a tie-breaker to be deterministic."""
    return _numbered(df, key, [F.col(c).desc_nulls_last() for c in order])


def keep_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return _numbered(df, key, [F.col(c).asc_nulls_last() for c in order])


def reject_blank_key(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.trim(key) != "")


def clean_feed(df: DataFrame, key: list[str], order: list[str], sign: str | None = "sign") -> DataFrame:
    """The POS feed: retractions out, exact duplicates out, newest version per key."""
    if sign and sign in df.columns:
        df = drop_tombstones(df, sign)
    return keep_last(df.distinct(), key, order)


def clean_orders(df: DataFrame, order: list[str]) -> DataFrame:
    """Completed orders, local timestamps, one row per non-blank order id."""
    out = completed_orders(text.strip_strings(df))
    out = out.withColumn("created_at", dates.to_local(F.col("created_at")))
    return keep_last(reject_blank_key(out, "order_id"), ["order_id"], order)


def clean_items(df: DataFrame, order: list[str]) -> DataFrame:
    out = positive_quantity(text.strip_strings(df), "quantity")
    out = out.withColumn("item_name", text.normalise_name(F.col("item_name")))
    return keep_last(out, ["id"], order)


def clean_menu(df: DataFrame, order: list[str]) -> DataFrame:
    out = text.strip_strings(df).withColumns(
        {
            "name": text.normalise_name(F.col("name")),
            "active": numbers.coerce(F.col("active"), 0).cast("int"),
            "price": numbers.coerce(F.col("price"), 0),
        }
    )
    return keep_last(out, ["id"], order)


def clean_recipes(df: DataFrame, order: list[str]) -> DataFrame:
    """Positive portions, yield factor within (0, 1]."""
    out = text.strip_strings(df).withColumns(
        {
            "dish_name": text.normalise_name(F.col("dish_name")),
            "ingredient": text.normalise_name(F.col("ingredient")),
        }
    )
    out = positive_quantity(out, "qty_per_portion")
    factor = numbers.coerce(F.col("yield_factor"), 1) if "yield_factor" in df.columns else F.lit(1.0)
    out = out.withColumn("yield_factor", numbers.clip(factor, 0.01, 1.0))
    return keep_last(out, ["dish_name", "ingredient"], order)


def clean_stock(df: DataFrame) -> DataFrame:
    out = positive_quantity(text.strip_strings(df), "qty_available", allow_zero=True)
    if "snapshot_time" in df.columns and "snapshot_date" not in df.columns:
        out = out.withColumn("snapshot_date", F.try_to_timestamp("snapshot_time").cast("date"))
    return out


def _day(name: str) -> Column:
    """A date, whatever the feed delivers it as; NULL where it is none."""
    return F.try_to_timestamp(F.col(name).cast("string")).cast("date")


def clean_open_pos(df: DataFrame, order: list[str]) -> DataFrame:
    """Open purchase orders: one row per order and ingredient, malformed quantities 0, malformed dates NULL."""
    out = text.strip_strings(df)
    out = out.withColumns({"qty_ordered": numbers.coerce(F.col("qty_ordered"), 0), "expected_date": _day("expected_date")})
    return keep_last(out, ["po_number", "ingredient"], order)


def clean_receipts(df: DataFrame) -> DataFrame:
    """Goods receipts: every row stays, malformed quantities 0, malformed dates NULL."""
    out = text.strip_strings(df)
    amounts = [c for c in ("qty_ordered", "qty_received") if c in out.columns]
    return out.withColumns({**{c: numbers.coerce(F.col(c), 0) for c in amounts}, "received_date": _day("received_date")})


def clean_vendors(df: DataFrame, order: list[str]) -> DataFrame:
    out = text.strip_strings(df).withColumns(
        {
            "lead_time_days": numbers.coerce(F.col("lead_time_days"), 3).cast("int"),
            "moq": numbers.coerce(F.col("moq"), 1),
            "price": numbers.coerce(F.col("price"), 0),
        }
    )
    if "vendor_id" not in df.columns:
        out = out.withColumn("vendor_id", text.vendor_code(F.col("vendor_name")))
    return keep_last(out, ["vendor_name", "ingredient"], order)


def unmapped(items: DataFrame, item_col: str, menu: DataFrame, menu_col: str) -> DataFrame:
    """Distinct non-null item names the menu does not list."""
    sold = items.select(F.col(item_col).alias("sku")).where(F.col("sku").isNotNull()).distinct()
    known = menu.select(F.col(menu_col).alias("sku")).distinct()
    return sold.join(known, "sku", "left_anti")


def missing_dates(df: DataFrame, col: str) -> DataFrame:
    """Calendar days between the first and the last without any row."""
    present = df.select(F.to_date(col).alias("date")).where(F.col("date").isNotNull()).distinct()
    span = present.agg(F.min("date").alias("lo"), F.max("date").alias("hi")).where(F.col("lo").isNotNull())
    return span.select(F.explode(F.sequence("lo", "hi")).alias("date")).join(present, "date", "left_anti")


def filters(
    df: DataFrame,
    date_col: str | None = None,
    start: Column | None = None,
    end: Column | None = None,
    equal: dict[str, str | None] | None = None,
    containing: dict[str, str | None] | None = None,
) -> DataFrame:
    """Optional conditions of a report, ANDed; an absent one does not restrict."""
    if date_col and start is not None:
        df = df.where(F.col(date_col) >= start)
    if date_col and end is not None:
        df = df.where(F.col(date_col) <= end)
    for col, value in (equal or {}).items():
        if value:
            df = df.where(text.equals_ignore_case(F.col(col), value))
    for col, value in (containing or {}).items():
        if value:
            df = df.where(text.contains_ignore_case(F.col(col), value))
    return df
