"""Daily series per item and outlet: dense panels and features.

A series never holds more rows than its look-back window has days, because it
is built from daily totals; windows over one series are therefore bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from larder.functions.dates import near_holiday

KEYS = ["sku", "outlet"]
LAGS = [7, 14, 28]
MIN_HISTORY_DAYS = 30
FEATURES = [
    "lag_7", "lag_14", "lag_28", "roll_mean_7", "roll_mean_14", "roll_mean_28",
    "dow", "dom", "month", "is_holiday_window", "combo_mean",
]


def _by_date() -> W:
    return W.partitionBy(*KEYS).orderBy("date")


def enough_history(history: DataFrame, min_days: int = MIN_HISTORY_DAYS) -> DataFrame:
    """Rows of series with at least ``min_days`` observed days, on the partitioning the panel needs anyway."""
    days = F.count("date").over(W.partitionBy(*KEYS))
    return history.withColumn("_days", days).where(F.col("_days") >= min_days).drop("_days")


def few_days(history: DataFrame, min_days: int = MIN_HISTORY_DAYS) -> DataFrame:
    """The rows that ``enough_history`` leaves out."""
    days = F.count("date").over(W.partitionBy(*KEYS))
    return history.withColumn("_days", days).where(F.col("_days") < min_days).drop("_days")


def dense_panel(history: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """One row per series and day of [start, end], days without sales as 0.

    Each observed row is stretched over the gap up to the next one, so the
    calendar appears after the one shuffle on the series key; nothing is cross
    joined and no calendar row crosses the network. Without bounds a series
    runs from its own first to its own last day. ``observed`` marks real rows.
    """
    w = _by_date()
    edged = history.withColumns({"_prev": F.lag("date").over(w), "_next": F.lead("date").over(w)})
    lo = F.when(F.col("_prev").isNull(), F.col("date") if start is None else start).otherwise(F.col("date"))
    hi = F.when(F.col("_next").isNull(), F.col("date") if end is None else end).otherwise(F.date_sub("_next", 1))
    days = edged.select(*KEYS, F.col("date").alias("_at"), "qty_sold", F.explode(F.sequence(lo, hi)).alias("date"))
    real = F.col("date") == F.col("_at")
    return days.select(*KEYS, "date", F.when(real, F.col("qty_sold")).otherwise(0.0).alias("qty_sold"), real.alias("observed"))


def lags(panel: DataFrame) -> DataFrame:
    w = _by_date()
    return panel.withColumns({f"lag_{n}": F.lag("qty_sold", n).over(w) for n in LAGS})


def rolling_means(panel: DataFrame) -> DataFrame:
    """Means of the previous days, never of the day itself."""
    w = _by_date()
    return panel.withColumns({f"roll_mean_{n}": F.avg("qty_sold").over(w.rowsBetween(-n, -1)) for n in LAGS})


def calendar(panel: DataFrame) -> DataFrame:
    return panel.withColumns(
        {
            "dow": F.weekday("date"),
            "dom": F.dayofmonth("date"),
            "month": F.month("date"),
            "is_holiday_window": near_holiday(F.col("date")),
        }
    )


def feature_frame(panel: DataFrame, complete_only: bool = True) -> DataFrame:
    """All features; every window shares the panel's partitioning, so no further shuffle."""
    observed = F.avg(F.when(F.col("observed"), F.col("qty_sold"))).over(W.partitionBy(*KEYS))
    out = calendar(rolling_means(lags(panel.withColumn("combo_mean", F.coalesce(observed, F.lit(0.0))))))
    return out.where(F.col("lag_28").isNotNull()) if complete_only else out


def model_choice(history: DataFrame, as_of: Column, top: DataFrame) -> DataFrame:
    """Which model forecasts each active series: length of its calendar, then its volume rank."""
    recent = F.col("date") >= F.date_sub(as_of, 45)
    spans = history.groupBy(*KEYS).agg(
        (F.datediff(F.max("date"), F.min("date")) + 1).alias("days"),
        F.sum(F.when(recent, F.col("qty_sold"))).alias("recent_qty"),
    )
    marked = spans.where(F.col("recent_qty") > 0).join(top.select(*KEYS, F.lit(True).alias("_top")), KEYS, "left")
    model = (
        F.when(F.col("days") < 21, "sma_7d")
        .when(F.coalesce("_top", F.lit(False)), "additive_holiday")
        .otherwise("seasonal_additive")
    )
    return marked.select(*KEYS, "days", model.alias("model_name"))


def dwell_times(events: DataFrame, key: str, time: str, state: str, tie: str, slot: str = "hour") -> DataFrame:
    """Seconds each entity stays in a state until its next event.

    The next event is looked up within (entity, slot of time); only the last
    event of a slot takes the first event of the entity's next active slot. An
    entity with a large share of all events is thus spread over its slots, of
    which one task links the first events only.
    """
    slotted = events.withColumn("_slot", F.date_trunc(slot, time))
    order = [F.col(time), F.col(tie)]
    inside = W.partitionBy(key, "_slot").orderBy(*order)
    stepped = slotted.withColumns({"_next_at": F.lead(time).over(inside), "_next": F.lead(state).over(inside)})
    first = slotted.groupBy(key, "_slot").agg(
        F.min(time).alias("_first_at"), F.min_by(state, F.struct(time, tie)).alias("_first")
    )
    slots = W.partitionBy(key).orderBy("_slot")
    following = first.select(
        key, "_slot", F.lead("_first_at").over(slots).alias("_later_at"), F.lead("_first").over(slots).alias("_later")
    )
    joined = stepped.join(following, [key, "_slot"], "left")
    at = F.coalesce("_next_at", "_later_at")
    seconds = F.timestamp_diff("SECOND", F.date_trunc("second", time), F.date_trunc("second", at))
    return joined.select(
        key, F.col(tie), F.col(state).alias("from_state"), F.coalesce("_next", "_later").alias("to_state"),
        seconds.alias("dwell_seconds"),
    ).where(F.col("to_state").isNotNull())
