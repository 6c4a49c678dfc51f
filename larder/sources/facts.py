"""Facts stored by month, so that a window of days reads its own months only.

Months rather than days are the partitions: a day of a small feed would be a
file of a few rows. Within a file rows are sorted by day, and the day is a DATE,
so the reader skips pages of the other days of a month.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from larder.session import checkpointed
from larder.sources.sinks import delete_path

MONTH = "month"


def _write(keyed: DataFrame, path: str, day: str, mode: str) -> None:
    # Large months are split over tasks, small ones share one.
    laid = keyed.hint("rebalance", MONTH).sortWithinPartitions(MONTH, day)
    laid.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(MONTH).parquet(path)


def store_fact(df: DataFrame, path: str, day: str = "date") -> None:
    """Write all of ``df``, one folder per month of ``day``; rows without a day have a folder of their own."""
    _write(df.withColumn(MONTH, F.trunc(day, "month")), path, day, "static")


def read_fact(
    spark: SparkSession, path: str, schema: T.StructType, since: Column | None = None, until: Column | None = None,
    day: str = "date",
) -> DataFrame:
    """Rows of the days from ``since`` to ``until``, both included; ``schema`` is that of what was stored.

    The bounds may be scalar subqueries: months are then chosen when the query
    runs. Rows without a day are read only if no bound is given.
    """
    stored = spark.read.schema(T.StructType([*schema.fields, T.StructField(MONTH, T.DateType())])).parquet(path)
    if since is not None:
        stored = stored.where((F.col(MONTH) >= F.trunc(since, "month")) & (F.col(day) >= since))
    if until is not None:
        stored = stored.where((F.col(MONTH) <= F.trunc(until, "month")) & (F.col(day) <= until))
    return stored.drop(MONTH)


def _months(start: dt.date, end: dt.date) -> list[dt.date]:
    count = (end.year - start.year) * 12 + end.month - start.month + 1
    return [dt.date(start.year + (start.month - 1 + n) // 12, (start.month - 1 + n) % 12 + 1, 1) for n in range(count)]


def refresh_fact(recomputed: DataFrame, path: str, start: dt.date, end: dt.date, day: str = "date") -> None:
    """Replace the days from ``start`` to ``end``, both included, by those rows of ``recomputed``.

    Only the months of the window are read and written again; a month left
    without a row is removed. A repeated refresh changes nothing.
    """
    spark, months = recomputed.sparkSession, _months(start, end)
    inside = F.col(day).between(F.lit(start), F.lit(end))
    stored = spark.read.schema(T.StructType([*recomputed.schema.fields, T.StructField(MONTH, T.DateType())])).parquet(path)
    kept = stored.where(F.col(MONTH).isin(months) & ~inside)
    new = recomputed.where(inside).withColumn(MONTH, F.trunc(day, "month"))
    # What is written is cut from the months that it replaces.
    merged = checkpointed(kept.unionByName(new))
    _write(merged, path, day, "dynamic")
    held = {row[0] for row in merged.select(MONTH).distinct().collect()}
    for month in months:
        if month not in held:
            delete_path(spark, f"{path}/{MONTH}={month}")
