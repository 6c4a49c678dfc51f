"""Rolling-origin back-tests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from larder.operators.series_models import additive_holiday

FOLDS = 12
FOLD_STEP_DAYS = 7
TEST_DAYS = 6
LOOKBACK_DAYS = 120
MIN_HISTORY_DAYS = 30


def cutoffs(as_of: Column, folds: int = FOLDS) -> Column:
    """Array of (fold, cutoff): weekly training ends, the last leaving a full test window."""
    return F.transform(
        F.sequence(F.lit(1), F.lit(folds)),
        lambda i: F.struct(
            i.alias("fold"), F.date_sub(as_of, F.lit(TEST_DAYS) + (F.lit(folds) - i) * FOLD_STEP_DAYS).alias("cutoff")
        ),
    )


def by_fold(daily: DataFrame, as_of: Column, folds: int = FOLDS) -> DataFrame:
    """Each daily row once per fold whose training or test window holds it.

    The folds are a literal array filtered inside the row, so the range
    condition needs neither a range join nor a cross join.
    """
    day = F.col("date")

    def holds(f):
        return (day >= F.date_sub(f["cutoff"], LOOKBACK_DAYS)) & (day <= F.date_add(f["cutoff"], TEST_DAYS))

    # The planning date is a subquery, which lambdas may not contain: bring it into the row first.
    dated = daily.withColumn("_as_of", as_of)
    return dated.withColumn("_f", F.explode(F.filter(cutoffs(F.col("_as_of"), folds), holds))).select(
        F.col("_f.fold").alias("fold"), F.col("_f.cutoff").alias("cutoff"), *daily.columns
    )


def moving_average_backtest(daily: DataFrame, as_of: Column, n: int = 14, folds: int = FOLDS) -> DataFrame:
    """Scored test rows of the recent-mean model. Training sees nothing after the cutoff."""
    rows = by_fold(daily, as_of, folds)
    series = ["fold", "sku", "outlet"]
    train = rows.where(F.col("date") <= F.col("cutoff"))
    newest = W.partitionBy(*series).orderBy(F.col("date").desc())
    seen = W.partitionBy(*series)
    level = (
        train.withColumns({"_rn": F.row_number().over(newest), "_days": F.count("date").over(seen)})
        .where((F.col("_rn") <= n) & (F.col("_days") >= MIN_HISTORY_DAYS))
        .groupBy(*series)
        .agg(F.round(F.avg("qty_sold"), 2).alias("qty_predicted"))
    )
    test = rows.where(F.col("date") > F.col("cutoff"))
    return test.join(level, series).withColumn("abs_err", F.abs(F.col("qty_predicted") - F.col("qty_sold")))


def per_series_backtest(daily: DataFrame, as_of: Column, folds: int = FOLDS) -> DataFrame:
    """Scored test rows of the holiday regression, fitted anew for every (fold, series) on its training days.

    All folds are one shuffle on (fold, series); a group holds one look-back
    window of a series. Series of under 30 training days are left out; a fit
    that fails or is too slow predicts its recent mean. The days to predict come
    from the calendar, so no test quantity reaches a fit.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        days, y = pdf["date"].to_numpy(dtype="datetime64[D]"), pdf["qty_sold"].to_numpy(dtype=float)
        future = np.datetime64(pdf["cutoff"].iloc[0], "D") + np.arange(1, TEST_DAYS + 1)
        try:
            level = additive_holiday(days, y, future)[0]
            if not np.isfinite(level).all():
                raise ValueError("not finite")
            name = "additive_holiday"
        except (ValueError, np.linalg.LinAlgError):
            level, name = np.full(TEST_DAYS, y[-14:].mean()), "moving_average"
        first = {c: pdf[c].iloc[0] for c in ("fold", "sku", "outlet")}
        return pd.DataFrame({**first, "date": pd.DatetimeIndex(future).date, "qty_predicted": np.clip(level, 0, None).round(2), "model_name": name})

    rows = by_fold(daily.where(F.col("qty_sold").isNotNull()), as_of, folds)
    series = ["fold", "sku", "outlet"]
    train = rows.where(F.col("date") <= F.col("cutoff")).withColumn("_days", F.count("date").over(W.partitionBy(*series)))
    train = train.where(F.col("_days") >= MIN_HISTORY_DAYS).drop("_days")
    predicted = train.groupBy(*series).applyInPandas(
        fit, "fold int, sku string, outlet string, date date, qty_predicted double, model_name string"
    )
    test = rows.where(F.col("date") > F.col("cutoff")).select(*series, "date", "qty_sold")
    return test.join(predicted, [*series, "date"]).withColumn("abs_err", F.abs(F.col("qty_predicted") - F.col("qty_sold")))
