"""Purchase orders, receipts and vendors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from larder.operators.skew import salted_join

MIN_VENDOR_ORDERS = 5
DELAY_TOP = 3
OVERAGE_TOP = 20


def _open(status: Column) -> Column:
    return F.coalesce(status != "Delivered", F.lit(False))


def order_counts(pos: DataFrame, as_of: Column) -> DataFrame:
    late = _open(F.col("status")) & (F.col("expected_date") < as_of)
    return pos.agg(F.count_if(_open(F.col("status"))).alias("total_open_pos"), F.count_if(late).alias("overdue_pos"))


def vendor_delays(pos: DataFrame, as_of: Column, top: int = DELAY_TOP) -> DataFrame:
    """Vendors with the highest share of overdue orders."""
    late = _open(F.col("status")) & (F.col("expected_date") < as_of)
    per_vendor = pos.groupBy("vendor").agg(F.count("*").alias("total_pos"), F.count_if(late).alias("overdue_pos"))
    share = F.try_divide(F.col("overdue_pos"), F.col("total_pos"))
    return (
        per_vendor.where(F.col("total_pos") >= MIN_VENDOR_ORDERS)
        .withColumn("delay_rate_pct", F.round(share * 100, 4))
        .orderBy(share.desc(), F.col("total_pos").desc(), "vendor")
        .limit(top)
    )


def vendor_on_time(pos: DataFrame, receipts: DataFrame) -> DataFrame:
    """Receipts on or before the expected date, per vendor.

    Orders and receipts are related by order number alone, so every line of an
    order counts against every receipt of it. Counting the pairs does not need
    them: lines and receipts are first counted per order and day, then a running
    count of receipts by day gives, for each expected date, how many were in
    time. A huge order is one window over its distinct days.
    """
    lines = pos.groupBy("po_number", F.col("expected_date").alias("day"), "vendor").agg(F.count("*").alias("lines"))
    got = (
        receipts.where(F.col("grn_number") != "")
        .groupBy("po_number", F.col("received_date").alias("day"))
        .agg(F.count("*").alias("got"))
    )
    both = lines.unionByName(got, allowMissingColumns=True)
    whole = W.partitionBy("po_number")
    so_far = whole.orderBy("day").rangeBetween(W.unboundedPreceding, W.currentRow)
    dated = F.when(F.col("day").isNotNull(), F.col("got"))
    counted = both.withColumns(
        {"received": F.sum("got").over(whole), "in_time": F.coalesce(F.sum(dated).over(so_far), F.lit(0))}
    ).where(F.col("lines").isNotNull() & (F.col("received") > 0))
    per_vendor = counted.groupBy("vendor").agg(
        F.sum(F.col("lines") * F.col("received")).alias("total_orders"),
        F.sum(F.when(F.col("day").isNotNull(), F.col("lines") * F.col("in_time")).otherwise(0)).alias("on_time"),
    )
    pct = F.round(F.try_divide("on_time", "total_orders") * 100, 1)
    band = F.when(pct >= 90, "good").when(pct >= 75, "fair").otherwise("poor")
    return per_vendor.select("vendor", "total_orders", "on_time", pct.alias("on_time_pct"), band.alias("band")).orderBy(
        F.col("on_time_pct").desc_nulls_last(), "vendor"
    )


def pairs_per_order(pos: DataFrame, receipts: DataFrame) -> DataFrame:
    """Line-receipt pairs per order and vendor, counted without being formed."""
    lines = pos.groupBy("po_number", "vendor").agg(F.count("*").alias("lines"))
    got = receipts.where(F.col("grn_number") != "").groupBy("po_number").agg(F.count("*").alias("got"))
    return lines.join(got, "po_number").select(
        "po_number", "vendor", (F.col("lines") * F.col("got")).alias("pairs")
    )


def order_receipts(pos: DataFrame, receipts: DataFrame) -> DataFrame:
    """Each receipt with its order line."""
    return receipts.join(pos, ["po_number", "ingredient"])


def receipt_overage(pos: DataFrame, receipts: DataFrame, since: Column, top: int = OVERAGE_TOP) -> DataFrame:
    """Ingredients received beyond the ordered quantity.

    A pair sum: totals per (order, ingredient) times the other side's row count,
    so repeated lines and receipts of one order are never multiplied out. Both
    sides meet in one grouping instead of a join, which would sort them.
    """
    got = receipts.where(F.col("received_date") >= since).select(
        "po_number", "ingredient", F.col("qty_received").alias("r"), F.lit(1).alias("nr")
    )
    ordered = pos.select("po_number", "ingredient", F.col("qty_ordered").alias("o"), F.lit(1).alias("no"))
    both = got.unionByName(ordered, allowMissingColumns=True).where(F.col("po_number").isNotNull() & F.col("ingredient").isNotNull())
    per_line = both.groupBy("po_number", "ingredient").agg(F.sum("r").alias("r"), F.count("nr").alias("nr"), F.sum("o").alias("o"), F.count("no").alias("no"))
    per_item = per_line.where((F.col("nr") > 0) & (F.col("no") > 0)).groupBy("ingredient").agg(
        F.sum(F.col("r") * F.col("no")).alias("total_received"),
        F.sum(F.col("o") * F.col("nr")).alias("total_ordered"),
    )
    extra = F.col("total_received") - F.col("total_ordered")
    return (
        per_item.withColumn("potential_wastage", extra)
        .where(F.col("potential_wastage") > 0)
        .orderBy(F.col("potential_wastage").desc(), "ingredient")
        .limit(top)
    )


def mark_ordered(pos: DataFrame, ordered: DataFrame, hot: Column | None = None) -> DataFrame:
    """Open orders of the listed ingredients become ``ordered``.

    ``hot``, measured on a column ``_i``, holds the lower-case ingredients worth
    salting; all are, if it is not given.
    """
    listed = ordered.select(F.lower("ingredient").alias("_i")).distinct().withColumn("_hit", F.lit(True))
    joined = salted_join(pos.withColumn("_i", F.lower("ingredient")), listed, ["_i"], "left", hot=hot)
    changed = F.col("_hit").isNotNull() & (F.col("status") == "open")
    return joined.withColumn("status", F.when(changed, F.lit("ordered")).otherwise(F.col("status"))).drop("_i", "_hit")
