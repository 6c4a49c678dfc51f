import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from larder.operators import accuracy, backtest, forecast as fc, learned, series, series_models
from larder.suite import all_queries

START = dt.date(2024, 1, 1)


def history(spark, points, sku="s", outlet="o"):
    rows = [(sku, outlet, START + dt.timedelta(days=d), float(q)) for d, q in points]
    return spark.createDataFrame(rows, "sku string, outlet string, date date, qty_sold double")


def lit(day):
    return F.lit(str(day)).cast("date")


def test_panel_is_dense_and_features_do_not_see_the_day(spark):
    df = history(spark, [(2, 5), (5, 7), (40, 9)])
    end = START + dt.timedelta(days=45)
    panel = series.dense_panel(df, lit(START), lit(end))
    rows = panel.orderBy("date").collect()
    assert len(rows) == 46 and sum(r.qty_sold for r in rows) == 21 and sum(r.observed for r in rows) == 3
    frame = series.feature_frame(panel, complete_only=False).orderBy("date").collect()
    assert frame[0].roll_mean_7 is None and frame[0].lag_7 is None
    assert frame[5].roll_mean_7 == 5 / 5 and frame[6].roll_mean_7 == 12 / 6
    assert frame[12].lag_7 == 7.0 and frame[0].combo_mean == 7.0
    # Changing a day must not change that day's own features.
    other = series.dense_panel(history(spark, [(2, 5), (5, 7), (40, 900)]), lit(START), lit(end))
    changed = series.feature_frame(other, complete_only=False).orderBy("date").collect()
    assert [r.roll_mean_28 for r in changed[:41]] == [r.roll_mean_28 for r in frame[:41]]


def test_panel_without_bounds_spans_the_series(spark):
    panel = series.dense_panel(history(spark, [(3, 1), (6, 1)]))
    assert [r.qty_sold for r in panel.orderBy("date").collect()] == [1, 0, 0, 1]


def test_accuracy_without_sales_is_null(spark):
    pairs = spark.createDataFrame([("a", 1.0, 0.0), ("b", 300.0, 100.0)], "k string, abs_err double, qty_sold double")
    out = {r.k: r.accuracy for r in accuracy.wmape(pairs, "k").collect()}
    assert out == {"a": None, "b": 0.0}


def test_ewma_matches_the_recursion(spark):
    points = [(0, 3), (1, 5), (4, 8)]
    dense = [3, 5, 0, 0, 8]
    weights = [0.75 ** k for k in range(4, -1, -1)]
    want = sum(w * x for w, x in zip(weights, dense)) / sum(weights)
    got = fc.ewma(history(spark, points), ["sku", "outlet"]).first().level
    assert abs(got - want) < 1e-9


def test_seasonal_model_learns_the_week():
    y = np.tile([1.0, 2, 3, 4, 5, 6, 7], 12)
    ahead, _ = series_models.seasonal_additive(y, 7)
    assert np.allclose(ahead, [1, 2, 3, 4, 5, 6, 7], atol=0.2)


def test_additive_model_learns_trend_and_week():
    days = np.datetime64("2024-02-01") + np.arange(112)
    week = np.array([0, 1, 2, 3, 4, 5, 6])[(np.arange(112) + 3) % 7]
    y = 10 + 0.1 * np.arange(112) + week
    future = days[-1] + np.arange(1, 8)
    ahead, _ = series_models.additive_holiday(days, y, future)
    want = 10 + 0.1 * np.arange(112, 119) + np.array([0, 1, 2, 3, 4, 5, 6])[(np.arange(112, 119) + 3) % 7]
    assert np.abs(ahead - want).max() < 0.8


def test_short_series_fall_back(spark):
    short = history(spark, [(d, 4) for d in range(5)], sku="short")
    long = history(spark, [(d, 1 + d % 7) for d in range(60)], sku="long")
    run = lit(START + dt.timedelta(days=60))
    for model in ("seasonal_additive", "additive_holiday"):
        out = series_models.forecast_per_series(short.unionByName(long), run, model, 7).collect()
        assert {r.sku: r.model_name for r in out} == {"short": "moving_average", "long": model}
        assert {r.qty_predicted for r in out if r.sku == "short"} == {4.0}
        assert len(out) == 14


def test_backtest_trains_on_the_past_only(spark):
    points = [(d, 2) for d in range(100)]
    as_of = lit(START + dt.timedelta(days=105))
    future = [(d, 50) for d in range(100, 106)]
    scored = backtest.moving_average_backtest(history(spark, points + future), as_of, folds=1).collect()
    assert len(scored) == 6 and {r.qty_predicted for r in scored} == {2.0}


def test_recursive_forecast_feeds_itself(spark):
    rows = history(spark, [(d, 10 + d % 7) for d in range(120)]).unionByName(
        history(spark, [(d, 30 + d % 7) for d in range(120)], sku="t")
    )
    cutoff = lit(START + dt.timedelta(days=119))
    out = learned.run(rows, lit(START), cutoff, 9, most_trees=5, max_depth=3)
    got = out.orderBy("sku", "forecast_date").collect()
    assert len(got) == 18
    assert got[0].forecast_date == START + dt.timedelta(days=120)
    # Had later days read zeros instead of predictions, they would sink.
    assert all(5 < r.qty_predicted < 25 for r in got if r.sku == "s")
    assert all(25 < r.qty_predicted < 45 for r in got if r.sku == "t")


def test_learning_from_nothing_gives_no_rows(spark):
    out = learned.run(history(spark, [(1, 1)]), lit(START), lit(START + dt.timedelta(days=60)), 3)
    assert out.count() == 0 and out.columns == ["forecast_date", "sku", "outlet", "qty_predicted", "n_trees"]


def test_short_series_are_forecast_beside_learned_ones(spark):
    rows = history(spark, [(d, 10 + d % 7) for d in range(120)]).unionByName(
        history(spark, [(40, 3), (60, 5), (118, 7)], sku="rare")
    ).unionByName(history(spark, [(119, 4)], sku="new"))
    cutoff = lit(START + dt.timedelta(days=119))
    out = learned.forecast_all(rows, lit(START), cutoff, 3, most_trees=3, max_depth=2).collect()
    assert sorted((r.sku, (r.forecast_date - START).days) for r in out) == [
        (s, d) for s in ("new", "rare", "s") for d in (120, 121, 122)
    ]
    assert {r.qty_predicted for r in out if r.sku == "rare"} == {5.0}
    assert {r.qty_predicted for r in out if r.sku == "new"} == {4.0}
    ahead = learned.production_forecast(rows, lit(START), cutoff, 3, most_trees=3, max_depth=2)
    assert {r.sku: r["count"] for r in ahead.groupBy("sku").count().collect()} == {"new": 3, "rare": 3, "s": 3}
    week = learned.fitted_week(rows, lit(START), cutoff, most_trees=3, max_depth=2).collect()
    assert {(r.sku, r.qty_predicted) for r in week if r.sku != "s"} == {("rare", 4.0), ("new", 0.0)} and len(week) == 21
    assert sum(r.qty_sold for r in week if r.sku != "s") == 11.0
    nothing = learned.forecast_all(history(spark, [(1, 1)]), lit(START), cutoff, 3)
    assert [r.qty_predicted for r in nothing.collect()] == [1.0] * 3


def test_registered_learned_backtest_runs_every_fold(spark, monkeypatch):
    """The folds and their scoring alone; the model itself is tested in test_learned.py."""
    asked = []

    def flat(window, start, cutoff, horizon, trees=None, **params):
        asked.append((trees, params))
        return fc.over_horizon(fc.recent_mean(window.where(F.col("date") <= cutoff), series.KEYS), cutoff, horizon).select(
            "forecast_date", *series.KEYS, F.col("level").alias("qty_predicted")
        )

    monkeypatch.setattr(learned, "run", flat)
    monkeypatch.setattr(learned, "choose", lambda *_, **params: learned.Length(11, 1.0))
    out = all_queries()["E16_rolling_origin_backtest_ml"](spark, "/root/testdata/sf0.01")
    assert sorted(r.fold for r in out.collect()) == list(range(1, 13)) and asked == [(11, {})] * 12


def test_one_true_bend_is_found():
    days = np.datetime64("2025-01-01") + np.arange(200)
    t = np.arange(200)
    y = 50 + 0.1 * t + 0.8 * np.clip(t - 96, 0, None) + 5 * (t % 7 == 2)
    ahead, fitted = series_models.additive_holiday(days, y, days[-1] + np.arange(1, 8))
    slope = np.diff(fitted - 5 * (t % 7 == 2))
    turn = int(np.abs(np.diff(np.convolve(slope, np.ones(7) / 7, "valid"))).argmax())
    assert abs(turn + 4 - 96) <= 6  # bends lie six days apart
    t = np.arange(200, 207)
    assert np.abs(ahead - (50 + 0.1 * t + 0.8 * (t - 96) + 5 * (t % 7 == 2))).max() < 2


def test_slow_failing_and_short_fits_yield_the_recent_mean(monkeypatch):
    days = np.datetime64("2025-01-01") + np.arange(40)
    with pytest.raises(ValueError, match="slow"):
        series_models.additive_holiday(days, np.ones(40), days, seconds=-1)
    frame = pd.DataFrame({"sku": "a", "outlet": "b", "date": days, "qty_sold": np.arange(40.0), "run_date": days[-1]})
    for fail in (ValueError("slow"), np.linalg.LinAlgError("singular")):
        monkeypatch.setattr(series_models, "additive_holiday", lambda *_, e=fail: (_ for _ in ()).throw(e))
        out = series_models._fit(frame, "additive_holiday", 3)
        assert set(out.model_name) == {"moving_average"} and set(out.qty_predicted) == {32.5}
    assert set(series_models._fit(frame[:29], "additive_holiday", 3).model_name) == {"moving_average"}


def test_smoothing_parameters_are_never_worse_than_the_grid():
    rnd = np.random.default_rng(3)
    grid = np.array([(a, g) for a in np.linspace(0.05, 0.95, 10) for g in np.linspace(0.05, 0.95, 10)])
    for _ in range(5):
        y = 20 + np.cumsum(rnd.normal(size=90)) + 4 * (np.arange(90) % 7 == 1) + rnd.normal(size=90)
        coarse = series_models._smoothed(y, grid[:, 0], grid[:, 1], 1)[0]
        _, fitted = series_models.seasonal_additive(y, 7)
        assert ((fitted - y) ** 2).sum() <= ((coarse - y[:, None]) ** 2).sum(axis=0).min()


def test_per_series_backtest_sees_no_test_quantity(spark):
    rows = [(d, 10 + d % 7) for d in range(210)]
    as_of = START + dt.timedelta(days=209)
    full = backtest.per_series_backtest(history(spark, rows), lit(as_of)).collect()
    assert {r.fold for r in full} == set(range(1, 13)) and max(r.abs_err for r in full) < 0.5
    changed = [(d, q if d < 204 else 1000 * d) for d, q in rows]
    last = backtest.per_series_backtest(history(spark, changed), lit(as_of)).where("fold = 12").collect()
    assert {(r.date, r.qty_predicted) for r in last} == {(r.date, r.qty_predicted) for r in full if r.fold == 12}
