"""Per-series models that need a recursion or a linear solve.

They run as grouped maps: Spark shuffles by series and every group is at most
one look-back window of daily rows. A series that cannot be fitted falls back
to its recent mean instead of failing the job.
"""

from __future__ import annotations

import datetime as dt
import time

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from larder.functions.dates import HOLIDAY_REACH_DAYS, HOLIDAYS
from larder.operators.forecast import ewma, recent_mean
from larder.operators.series import dense_panel

SEASON = 7
#: Days that a series needs to be fitted: on the calendar for the smoother, sold ones for the regression.
MIN_POINTS = {"seasonal_additive": 14, "additive_holiday": 30}
#: Candidate trend bends, the scale of their Laplace prior and that of the effects' normal one: fixed values.
BENDS, BEND_SCALE, EFFECT_SCALE = 25, 0.05, 10.0
ROUNDS, SLOW_SECONDS = 60, 15.0
OUTPUT = (
    "sku string, outlet string, forecast_date date, qty_predicted double, qty_lower double, qty_upper double, "
    "model_name string, accuracy double"
)


def dense(days: np.ndarray, qty: np.ndarray) -> np.ndarray:
    """Quantities on every day from the first to the last, absent days 0."""
    at = (days - days.min()).astype("timedelta64[D]").astype(int)
    out = np.zeros(at.max() + 1)
    np.add.at(out, at, qty)
    return out


def _smoothed(y: np.ndarray, alpha: np.ndarray, gamma: np.ndarray, weeks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fitted values, last levels and seasons of all parameter pairs at once; the first ``weeks`` weeks give the start."""
    first = y[: SEASON * weeks].reshape(weeks, SEASON).mean(axis=0)
    level = np.full(len(alpha), first.mean())
    season = np.repeat((first - first.mean())[:, None], len(alpha), axis=1)
    fitted = np.empty((len(y), len(alpha)))
    for t, value in enumerate(y):
        s = season[t % SEASON].copy()
        fitted[t] = level + s
        fresh = alpha * (value - s) + (1 - alpha) * level
        season[t % SEASON] = gamma * (value - level) + (1 - gamma) * s
        level = fresh
    return fitted, level, season


def seasonal_additive(y: np.ndarray, horizon: int, rounds: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Level plus additive weekly season, exponentially smoothed: (forecast, fitted).

    Both parameters and the number of weeks that give the start level and season
    are estimated by the squared one-step error: a grid over all pairs first,
    then ever finer grids around the best pair so far, which stays a candidate.
    """
    alphas = gammas = np.linspace(0.05, 0.95, 10)
    width, best = 0.1, None
    for _ in range(rounds):
        alpha, gamma = (m.ravel() for m in np.meshgrid(alphas, gammas, indexing="ij"))
        for weeks in {1, min(2, len(y) // SEASON), min(4, len(y) // SEASON)}:
            fitted, level, season = _smoothed(y, alpha, gamma, weeks)
            error = ((fitted - y[:, None]) ** 2).sum(axis=0)
            at = int(error.argmin())
            if best is None or error[at] < best[0]:
                best = error[at], alpha[at], gamma[at], level[at], season[:, at].copy(), fitted[:, at].copy()
        alphas, gammas = (np.clip(np.linspace(c - width, c + width, 7), 0.001, 0.999) for c in best[1:3])
        width /= 3
    _, _, _, level, season, fitted = best
    ahead = np.arange(len(y), len(y) + horizon) % SEASON
    return level + season[ahead], fitted


def holiday_columns(days: pd.DatetimeIndex) -> np.ndarray:
    """One indicator per listed holiday and day offset within its reach."""
    cols = []
    for _, month, dom in HOLIDAYS:
        for k in range(-HOLIDAY_REACH_DAYS, HOLIDAY_REACH_DAYS + 1):
            near = dt.date(2001, month, dom) + dt.timedelta(days=k)
            cols.append(((days.month == near.month) & (days.day == near.day)).astype(float))
    return np.column_stack(cols)


def additive_holiday(
    days: np.ndarray, y: np.ndarray, future: np.ndarray, rounds: int = ROUNDS, seconds: float = SLOW_SECONDS
) -> tuple[np.ndarray, np.ndarray]:
    """Trend with few bends, weekday effects, and an effect per holiday and day offset: (forecast, fitted).

    Candidate bends lie evenly over the first four fifths of the days. They have
    a Laplace prior, solved by ridge rounds whose weights follow the last
    round's bends, so that most end at zero; the other effects have a normal
    one. A fit that takes longer than ``seconds`` is an error.
    """
    begun = time.monotonic()
    origin, span = days.min(), max(int((days.max() - days.min()).astype("timedelta64[D]").astype(int)), 1)
    bends = np.linspace(0, 0.8, BENDS + 1)[1:]
    peak = float(np.abs(y).max()) or 1.0

    def design(at: np.ndarray) -> np.ndarray:
        index = pd.DatetimeIndex(at)
        t = (at - origin).astype("timedelta64[D]").astype(float) / span
        weekday = np.eye(SEASON)[index.dayofweek]
        return np.column_stack([np.ones(len(at)), t, np.clip(t[:, None] - bends, 0, None), weekday, holiday_columns(index)])

    x, target = design(days), y / peak
    effects = x.shape[1] - 2 - BENDS
    gram, moment = x.T @ x, x.T @ target
    delta, noise, beta = np.full(BENDS, 1.0), float(target.var()) or 1.0, None
    for _ in range(rounds):
        if time.monotonic() - begun > seconds:
            raise ValueError("too slow")
        shrink = np.r_[1e-6, 1e-6, noise / (BEND_SCALE * (np.abs(delta) + 1e-6)), np.full(effects, noise / EFFECT_SCALE**2 + 1e-6)]
        fresh = np.linalg.solve(gram + np.diag(shrink), moment)
        done = beta is not None and np.abs(fresh - beta).max() < 1e-6
        beta, delta = fresh, fresh[2 : 2 + BENDS]
        noise = max(float(np.mean((target - x @ beta) ** 2)), 1e-8)
        if done:
            break
    return design(future) @ beta * peak, x @ beta * peak


def _mape_accuracy(actual: np.ndarray, fitted: np.ndarray) -> float | None:
    mask = actual > 0
    if not mask.any():
        return None
    return max(0.0, 100.0 - float(np.mean(np.abs(actual[mask] - fitted[mask]) / actual[mask]) * 100))


def _frame(pdf: pd.DataFrame, future, level, name: str, accuracy) -> pd.DataFrame:
    q = np.clip(np.asarray(level, dtype=float), 0, None)
    return pd.DataFrame(
        {
            "sku": pdf["sku"].iloc[0],
            "outlet": pdf["outlet"].iloc[0],
            "forecast_date": pd.DatetimeIndex(future).date,
            "qty_predicted": q.round(2),
            "qty_lower": (q * 0.8).round(2),
            "qty_upper": (q * 1.2).round(2),
            "model_name": name,
            "accuracy": accuracy,
        }
    )


def _fit(pdf: pd.DataFrame, model: str, horizon: int, seconds: float = SLOW_SECONDS) -> pd.DataFrame:
    pdf = pdf.dropna(subset=["date", "qty_sold"]).sort_values("date")
    if pdf.empty:
        return pd.DataFrame(columns=[c.split()[0] for c in OUTPUT.split(", ")])
    days = pdf["date"].to_numpy(dtype="datetime64[D]")
    y = pdf["qty_sold"].to_numpy(dtype=float)
    run = np.datetime64(pdf["run_date"].iloc[0], "D")
    future = run + np.arange(1, horizon + 1)
    try:
        if not np.isfinite(y).all():
            raise ValueError("not finite")
        if model == "seasonal_additive":
            filled = dense(days, y)
            if len(filled) < MIN_POINTS[model]:
                raise ValueError("series too short")
            # Days between the last sale and the run date are forecast and skipped.
            gap = int((run - days.max()).astype(int))
            level, fitted = seasonal_additive(filled, gap + horizon)
            level, accuracy = level[gap:], _mape_accuracy(filled[-SEASON:], fitted[-SEASON:])
        else:
            if len(y) < MIN_POINTS[model]:
                raise ValueError("series too short")
            level, fitted = additive_holiday(days, y, future, ROUNDS, seconds)
            accuracy = _mape_accuracy(y, fitted)
        if not np.isfinite(level).all():
            raise ValueError("not finite")
        return _frame(pdf, future, level, model, accuracy)
    except (ValueError, np.linalg.LinAlgError):
        return _frame(pdf, future, np.full(horizon, y[-14:].mean()), "moving_average", None)


def forecast_per_series(
    history: DataFrame, run_date, model: str, horizon: int = 30, seconds: float = SLOW_SECONDS, weighted: bool = False
) -> DataFrame:
    """Fit ``model`` to every series of ``history`` (sku, outlet, date, qty_sold) and forecast from ``run_date`` on.

    Series too short for the model, those it can't fit and those the regression
    works on for more than ``seconds`` get their recent mean; with ``weighted``
    the short ones get their exponentially weighted mean instead.
    """
    if model not in ("seasonal_additive", "additive_holiday"):
        raise ValueError(model)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        return _fit(pdf, model, horizon, seconds)

    series = W.partitionBy("sku", "outlet")
    if model == "seasonal_additive":
        points = F.datediff(F.max("date").over(series), F.min("date").over(series)) + 1
    else:
        points = F.count("qty_sold").over(series)
    sized = history.select("sku", "outlet", "date", "qty_sold").withColumn("_points", points)
    rows = sized.where(F.col("_points") >= MIN_POINTS[model]).withColumn("run_date", run_date).drop("_points")
    fitted = rows.groupBy("sku", "outlet").applyInPandas(fit, OUTPUT)
    # Series too short to fit never enter Python.
    rest = sized.where(F.col("_points") < MIN_POINTS[model]).drop("_points")
    if weighted:
        short = ewma(rest, ["sku", "outlet"]).withColumn("model_name", F.lit("weighted_mean"))
    else:
        short = recent_mean(rest, ["sku", "outlet"]).withColumn("model_name", F.lit("moving_average"))
    return fitted.unionByName(flat_rows(short, run_date, horizon))


def flat_rows(levels: DataFrame, run_date, horizon: int) -> DataFrame:
    """Flat forecast rows in the output layout of the fitted models."""
    days = F.explode(F.sequence(F.date_add(run_date, 1), F.date_add(run_date, horizon)))
    q = F.greatest(F.col("level"), F.lit(0.0))
    return levels.select("sku", "outlet", days.alias("forecast_date"), "model_name", q.alias("q")).select(
        "sku", "outlet", "forecast_date", F.round("q", 2).alias("qty_predicted"), F.round(F.col("q") * 0.8, 2).alias("qty_lower"),
        F.round(F.col("q") * 1.2, 2).alias("qty_upper"), "model_name", F.lit(None).cast("double").alias("accuracy"),
    )


def routed_forecast(history: DataFrame, choice: DataFrame, run_date, horizon: int = 14) -> DataFrame:
    """Each series by its chosen model; the short ones by the mean of their last seven calendar days."""
    routed = history.join(choice.select("sku", "outlet", "model_name"), ["sku", "outlet"])

    def of(name: str) -> DataFrame:
        return routed.where(F.col("model_name") == name).drop("model_name")

    short = recent_mean(dense_panel(of("sma_7d")), ["sku", "outlet"], 7).withColumn("model_name", F.lit("sma_7d"))
    out = flat_rows(short, run_date, horizon)
    for name in ("seasonal_additive", "additive_holiday"):
        out = out.unionByName(forecast_per_series(of(name), run_date, name, horizon))
    return out
