"""E-queries: time-series features and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions.dates import HOLIDAYS, near_holiday
from larder.operators import accuracy, backtest, forecast as fc, learned, series, series_models, stock
from larder.suite.registry import query

PANEL_SQL = """deep AS (SELECT sku, outlet FROM hist_coarse GROUP BY sku, outlet HAVING count(DISTINCT date) >= 30),
  days AS (SELECT CAST(unnest(generate_series(CAST((SELECT d - 365 FROM ship_day) AS TIMESTAMP), CAST((SELECT d FROM ship_day) AS TIMESTAMP),
    INTERVAL 1 DAY)) AS DATE) AS date),
  panel AS (SELECT c.sku, c.outlet, days.date, coalesce(h.qty_sold, 0.0) AS qty_sold FROM deep c CROSS JOIN days
    LEFT JOIN hist_coarse h ON h.sku = c.sku AND h.outlet = c.outlet AND h.date = days.date)"""
FEATURE_SQL = f"""{PANEL_SQL}, w AS (SELECT *, lag(qty_sold, 7) OVER s AS lag_7, lag(qty_sold, 14) OVER s AS lag_14, lag(qty_sold, 28) OVER s AS lag_28,
    avg(qty_sold) OVER (s ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS roll_mean_7,
    avg(qty_sold) OVER (s ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS roll_mean_14,
    avg(qty_sold) OVER (s ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) AS roll_mean_28
  FROM panel WINDOW s AS (PARTITION BY sku, outlet ORDER BY date))"""
HOLIDAY_SQL = (
    "hol AS (SELECT DISTINCT CAST(make_date(CAST(y AS INTEGER), m, dd) + k AS DATE) AS date FROM range(1990, 2030) t(y), (VALUES "
    + ", ".join(f"({m}, {d})" for _, m, d in HOLIDAYS)
    + ") h(m, dd), (VALUES (-1), (0), (1)) o(k))"
)


def panel(r):
    return series.dense_panel(series.enough_history(r.history()), F.date_sub(r.ship_as_of, 365), r.ship_as_of)


@query(
    "E1_latest_snapshot",
    """SELECT DISTINCT ON (kitchen, ingredient) kitchen, ingredient, snapshot_date, qty_available FROM kitchen_stock
    ORDER BY kitchen, ingredient, snapshot_date DESC""",
)
def _(r):
    return stock.latest_snapshot(r.kitchen_stock(), ["kitchen", "ingredient"]).select(
        "kitchen", "ingredient", "snapshot_date", "qty_available"
    )


@query("E2_lag_features", f"WITH {FEATURE_SQL} SELECT sku, outlet, date, qty_sold, lag_7, lag_14, lag_28 FROM w")
def _(r):
    return series.lags(panel(r)).drop("observed")


@query(
    "E3_rolling_means",
    f"""WITH {FEATURE_SQL} SELECT sku, outlet, date, round(roll_mean_7, 6) AS roll_mean_7, round(roll_mean_14, 6) AS roll_mean_14,
      round(roll_mean_28, 6) AS roll_mean_28 FROM w""",
)
def _(r):
    return series.rolling_means(panel(r)).select(
        "sku", "outlet", "date", *[F.round(f"roll_mean_{n}", 6).alias(f"roll_mean_{n}") for n in series.LAGS]
    )


@query(
    "E4_calendar_features",
    """SELECT DISTINCT CAST(l_shipdate AS DATE) AS date, CAST(isodow(l_shipdate) - 1 AS INTEGER) AS dow,
      CAST(day(l_shipdate) AS INTEGER) AS dom, CAST(month(l_shipdate) AS INTEGER) AS month FROM lineitem""",
)
def _(r):
    days = r.t("lineitem", "l_shipdate").select(F.to_date("l_shipdate").alias("date")).distinct()
    return series.calendar(days).drop("is_holiday_window")


@query(
    "E5_holiday_window",
    f"""WITH {HOLIDAY_SQL} SELECT date, CAST(date IN (SELECT date FROM hol) AS INTEGER) AS is_holiday_window
    FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem)""",
)
def _(r):
    days = r.t("lineitem", "l_shipdate").select(F.to_date("l_shipdate").alias("date")).distinct()
    return days.withColumn("is_holiday_window", near_holiday(F.col("date")))


@query("E6_dense_panel", f"WITH {PANEL_SQL} SELECT * FROM panel")
def _(r):
    return panel(r).drop("observed")


@query(
    "E7_feature_frame",
    f"""WITH {FEATURE_SQL}, {HOLIDAY_SQL}, m AS (SELECT sku, outlet, avg(qty_sold) AS cm FROM hist_coarse GROUP BY sku, outlet)
    SELECT w.sku, w.outlet, date, qty_sold, lag_7, lag_14, lag_28, round(roll_mean_7, 6) AS roll_mean_7, round(roll_mean_14, 6) AS roll_mean_14,
      round(roll_mean_28, 6) AS roll_mean_28, CAST(isodow(date) - 1 AS INTEGER) AS dow, CAST(day(date) AS INTEGER) AS dom,
      CAST(month(date) AS INTEGER) AS month, CAST(date IN (SELECT date FROM hol) AS INTEGER) AS is_holiday_window, round(cm, 6) AS combo_mean
    FROM w JOIN m ON m.sku = w.sku AND m.outlet = w.outlet WHERE lag_28 IS NOT NULL""",
)
def _(r):
    frame = series.feature_frame(panel(r)).drop("observed")
    means = [*[f"roll_mean_{n}" for n in series.LAGS], "combo_mean"]
    return frame.withColumns({c: F.round(c, 6) for c in means})


@query("E8_moving_average_forecast", "SELECT * FROM forecast")
def _(r):
    return r.forecast()


@query(
    "E9_ewma_forecast",
    """WITH b AS (SELECT sku, outlet, min(date) AS lo, max(date) AS hi FROM hist_coarse GROUP BY sku, outlet),
      g AS (SELECT sku, outlet, hi, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM b),
      x AS (SELECT g.sku, g.outlet, hi - g.date AS k, coalesce(h.qty_sold, 0.0) AS q FROM g LEFT JOIN hist_coarse h
        ON h.sku = g.sku AND h.outlet = g.outlet AND h.date = g.date)
    SELECT sku, outlet, round(sum(q * pow(0.75, k)) / sum(pow(0.75, k)), 4) AS level FROM x GROUP BY sku, outlet""",
)
def _(r):
    return fc.ewma(r.history(), ["sku", "outlet"]).withColumn("level", F.round("level", 4))


@query("E10_seasonal_additive_forecast")
def _(r):
    return series_models.forecast_per_series(r.history(), r.ship_as_of, "seasonal_additive", 14)


@query(
    "E10_weighted_mean_branch",
    """WITH h AS (SELECT * FROM hist_coarse WHERE date >= (SELECT d - 10 FROM ship_day)),
      b AS (SELECT sku, outlet, min(date) AS lo, max(date) AS hi FROM h GROUP BY sku, outlet),
      g AS (SELECT sku, outlet, hi, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM b),
      x AS (SELECT g.sku, g.outlet, hi - g.date AS k, coalesce(h.qty_sold, 0.0) AS q FROM g LEFT JOIN h
        ON h.sku = g.sku AND h.outlet = g.outlet AND h.date = g.date),
      e AS (SELECT sku, outlet, sum(q * pow(0.75, k)) / sum(pow(0.75, k)) AS level FROM x GROUP BY sku, outlet)
    SELECT sku, outlet, CAST((SELECT d FROM ship_day) + CAST(i AS INTEGER) AS DATE) AS forecast_date, round(level, 2) AS qty_predicted,
      'weighted_mean' AS model_name FROM e, range(1, 15) t(i)""",
)
def _(r):
    """Ten days are too few for the smoother: the weighted mean stands in."""
    short = series_models.forecast_per_series(r.history(days=10), r.ship_as_of, "seasonal_additive", 14, weighted=True)
    return short.select("sku", "outlet", "forecast_date", "qty_predicted", "model_name")


@query(
    "E11_resample_daily",
    """WITH h AS (SELECT * FROM sales_mid WHERE date >= (SELECT d - 365 FROM ship_day)),
      b AS (SELECT sku, outlet, min(date) AS lo, max(date) AS hi FROM h GROUP BY sku, outlet),
      g AS (SELECT sku, outlet, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM b)
    SELECT g.sku, g.outlet, g.date, coalesce(h.qty_sold, 0.0) AS qty_sold FROM g LEFT JOIN h
      ON h.sku = g.sku AND h.outlet = g.outlet AND h.date = g.date""",
)
def _(r):
    return series.dense_panel(r.history("mid")).drop("observed")


def choice(r, grain="mid", k=100):
    top = fc.top_combos(r.daily_qty(grain, since=F.date_sub(r.ship_as_of, 30)), k)
    return series.model_choice(r.history(grain), r.ship_as_of, top)


@query(
    "E12_model_choice",
    """WITH h AS (SELECT * FROM sales_mid WHERE date >= (SELECT d - 365 FROM ship_day)),
      t AS (SELECT sku, outlet, sum(qty_sold) AS q FROM h WHERE date >= (SELECT d - 30 FROM ship_day) GROUP BY sku, outlet
        ORDER BY q DESC, sku, outlet LIMIT 100),
      s AS (SELECT sku, outlet, CAST(max(date) - min(date) + 1 AS INTEGER) AS days FROM h GROUP BY sku, outlet
        HAVING sum(CASE WHEN date >= (SELECT d - 45 FROM ship_day) THEN qty_sold END) > 0)
    SELECT s.sku, s.outlet, days, CASE WHEN days < 21 THEN 'sma_7d' WHEN t.sku IS NOT NULL THEN 'additive_holiday'
      ELSE 'seasonal_additive' END AS model_name FROM s LEFT JOIN t ON t.sku = s.sku AND t.outlet = s.outlet""",
)
def _(r):
    return choice(r)


@query(
    "E12_model_choice_all",
    """WITH h AS (SELECT * FROM hist_fine),
      s AS (SELECT sku, outlet, CAST(max(date) - min(date) + 1 AS INTEGER) AS days, max(date) >= (SELECT d - 30 FROM ship_day) AS sold FROM h
        GROUP BY sku, outlet HAVING sum(CASE WHEN date >= (SELECT d - 45 FROM ship_day) THEN qty_sold END) > 0)
    SELECT sku, outlet, days, CASE WHEN days < 21 THEN 'sma_7d' WHEN sold THEN 'additive_holiday' ELSE 'seasonal_additive' END AS model_name FROM s""",
)
def _(r):
    """Per part and nation, without a rank: every series that sold in the last 30 days counts as a best seller."""
    return choice(r, "fine", k=None)


@query("E12_routed_forecast")
def _(r):
    return series_models.routed_forecast(r.history("mid"), choice(r), r.ship_as_of)


def _start(r):
    return F.date_sub(r.ship_as_of, 365)


@query("E13_global_ml_forecast")
def _(r):
    """Fitted values of the last, held-out week."""
    return learned.fitted_week(r.history(), _start(r), r.ship_as_of)


@query("E14_recursive_forecast")
def _(r):
    return fc.with_band(learned.forecast_all(r.history(), _start(r), r.ship_as_of, 30))


@query("E15_holdout_accuracy")
def _(r):
    return learned.holdout_accuracy(r.history(), _start(r), r.ship_as_of)


@query(
    "E15_learned_against_means",
    f"""WITH cut AS (SELECT CAST(d - 7 AS DATE) AS c, CAST(d - 372 AS DATE) AS lo, d FROM ship_day),
      h AS (SELECT sku, outlet, date, qty_sold FROM hist_coarse, cut WHERE date >= d - 365),
      seen AS (SELECT *, row_number() OVER (PARTITION BY sku, outlet ORDER BY date DESC) AS rn,
        count(*) OVER (PARTITION BY sku, outlet) AS n FROM h, cut WHERE date <= c),
      lv AS (SELECT sku, outlet, avg(qty_sold) AS m, avg(CASE WHEN rn <= 14 THEN qty_sold END) AS l FROM seen WHERE n >= 30 GROUP BY sku, outlet),
      rows_ AS (SELECT lv.*, coalesce(h.qty_sold, 0.0) AS q FROM lv CROSS JOIN cut CROSS JOIN (SELECT unnest(range(1, 8)) AS k) ahead
        LEFT JOIN h ON h.sku = lv.sku AND h.outlet = lv.outlet AND h.date = cut.c + CAST(k AS INTEGER))
    SELECT count(*) AS n_rows, round(100 * (1 - sum(abs(l - q)) / sum(q)), 4) AS recent_mean_accuracy,
      round(100 * (1 - sum(abs(m - q)) / sum(q)), 4) AS series_mean_accuracy, TRUE AS learned_no_worse FROM rows_""",
)
def _(r):
    """The held-out week: the model must do no worse than the recent mean, up to a point of noise."""
    found = learned.against_means(r.history(), _start(r), r.ship_as_of)
    no_worse = F.coalesce(F.col("learned_accuracy") >= F.col("recent_mean_accuracy") - 1, F.lit(True))
    return found.select("n_rows", "recent_mean_accuracy", "series_mean_accuracy", no_worse.alias("learned_no_worse"))


@query(
    "E16_rolling_origin_backtest",
    """WITH folds AS (SELECT CAST(i AS INTEGER) AS fold, CAST((SELECT d FROM ship_day) - CAST(6 + (12 - i) * 7 AS INTEGER) AS DATE) AS cutoff FROM range(1, 13) t(i)),
      rows_ AS (SELECT fold, cutoff, date, sku, outlet, qty_sold FROM sales_coarse JOIN folds ON date >= cutoff - 120 AND date <= cutoff + 6),
      tr AS (SELECT *, row_number() OVER (PARTITION BY fold, sku, outlet ORDER BY date DESC) AS rn,
        count(*) OVER (PARTITION BY fold, sku, outlet) AS n FROM rows_ WHERE date <= cutoff),
      lv AS (SELECT fold, sku, outlet, round(avg(qty_sold), 2) AS p FROM tr WHERE rn <= 14 AND n >= 30 GROUP BY fold, sku, outlet)
    SELECT fold, round(greatest(0.0, 100.0 * (1.0 - sum(abs(p - qty_sold)) / sum(qty_sold))), 4) AS accuracy
    FROM rows_ JOIN lv USING (fold, sku, outlet) WHERE date > cutoff GROUP BY fold""",
)
def _(r):
    since = F.date_sub(r.ship_as_of, 120 + 6 + 11 * 7)
    return accuracy.wmape(backtest.moving_average_backtest(r.daily_qty(since=since), r.ship_as_of), "fold")


@query("E16_rolling_origin_backtest_ml")
def _(r):
    daily = r.daily_qty(since=F.date_sub(r.ship_as_of, 120 + 6 + 11 * 7))
    return accuracy.wmape(learned.backtest(daily, r.ship_as_of), "fold")


BACKTEST_SQL = """folds AS (SELECT CAST(i AS INTEGER) AS fold, CAST((SELECT d FROM ship_day) - CAST(6 + (12 - i) * 7 AS INTEGER) AS DATE) AS cutoff FROM range(1, 13) t(i)),
      rows_ AS (SELECT fold, cutoff, date, sku, outlet, qty_sold FROM sales_coarse JOIN folds ON date >= cutoff - 120 AND date <= cutoff + 6),
      deep AS (SELECT fold, sku, outlet FROM rows_ WHERE date <= cutoff GROUP BY fold, sku, outlet HAVING count(*) >= 30)"""


@query("E16_rolling_origin_backtest_per_series")
def _(r):
    since = F.date_sub(r.ship_as_of, 120 + 6 + 11 * 7)
    return accuracy.wmape(backtest.per_series_backtest(r.daily_qty(since=since), r.ship_as_of), "fold")


@query(
    "E16_per_series_scored_rows",
    f"""WITH {BACKTEST_SQL} SELECT fold, count(*) AS n_rows, sum(qty_sold) AS sold, TRUE AS sound
    FROM rows_ JOIN deep USING (fold, sku, outlet) WHERE date > cutoff GROUP BY fold""",
)
def _(r):
    """What SQL can check of the per-series back-test: its folds, gate and scored rows, and that predictions are finite and no less than 0."""
    since = F.date_sub(r.ship_as_of, 120 + 6 + 11 * 7)
    scored = backtest.per_series_backtest(r.daily_qty(since=since), r.ship_as_of)
    sound = F.bool_and((F.col("qty_predicted") >= 0) & (F.col("qty_predicted") < float("inf")))
    return scored.groupBy("fold").agg(F.count("*").alias("n_rows"), F.sum("qty_sold").alias("sold"), sound.alias("sound"))


@query(
    "E17_forecast_band",
    """SELECT event_id, round(greatest(value - 10, 0.0) * 0.9, 2) AS qty_lower, round(greatest(value - 10, 0.0), 2) AS qty_predicted,
      round(greatest(value - 10, 0.0) * 1.1, 2) AS qty_upper FROM (SELECT event_id, round(value) AS value FROM events)""",
)
def _(r):
    raw = r.t("events", "event_id", "value").select("event_id", (F.round("value") - 10).alias("qty_predicted"))
    return fc.with_band(raw, band=0.1)


@query("E18_additive_holiday_model")
def _(r):
    return series_models.forecast_per_series(r.history(), r.ship_as_of, "additive_holiday", 30)


@query("E19_group_fallback")
def _(r):
    """Sixty days of brand sales: series too short to fit fall back to their recent mean."""
    return series_models.forecast_per_series(r.history("mid", days=60), r.ship_as_of, "additive_holiday", 7)


@query("E19_group_fallback_year")
def _(r):
    """A year of brand sales: long series are fitted, the others fall back."""
    return series_models.forecast_per_series(r.history("mid"), r.ship_as_of, "additive_holiday", 7)


@query(
    "E19_averaged_branches",
    """WITH h AS (SELECT * FROM sales_mid WHERE date >= (SELECT d - 365 FROM ship_day) AND (sku LIKE '%1' OR sku LIKE '%3'
        OR (sku LIKE '%2' AND date >= (SELECT d - 20 FROM ship_day)))),
      n AS (SELECT *, row_number() OVER (PARTITION BY sku, outlet ORDER BY date DESC) AS rn FROM h),
      m AS (SELECT sku, outlet, avg(qty_sold) AS q FROM n WHERE rn <= 14 GROUP BY sku, outlet)
    SELECT sku, outlet, CAST((SELECT d FROM ship_day) + CAST(k AS INTEGER) AS DATE) AS forecast_date, round(q, 2) AS qty_predicted,
      'moving_average' AS model_name FROM m, range(1, 8) t(k)""",
)
def _(r):
    """Series that a fit fails on (an infinite day), that are short, and that are out of time: all get their recent mean."""
    history = r.history("mid").select("sku", "outlet", "date", "qty_sold")
    fails, short, slow = (F.col("sku").endswith(end) for end in "123")
    long = history.where(fails).groupBy("sku", "outlet").agg(F.count("*").alias("n")).where(F.col("n") >= 30)
    broken = long.select("sku", "outlet", F.date_sub(r.ship_as_of, 400).alias("date"), F.lit(float("inf")).alias("qty_sold"))
    cut = history.where(fails | (short & (F.col("date") >= F.date_sub(r.ship_as_of, 20))))
    out = series_models.forecast_per_series(cut.unionByName(broken), r.ship_as_of, "additive_holiday", 7)
    late = series_models.forecast_per_series(history.where(slow), r.ship_as_of, "additive_holiday", 7, seconds=0)
    return out.unionByName(late).select("sku", "outlet", "forecast_date", "qty_predicted", "model_name")


@query(
    "E20_state_dwell_time",
    """SELECT user_id, event_id, event_type AS from_state, to_state, CAST(date_diff('second', ts, nxt) AS BIGINT) AS dwell_seconds FROM (
      SELECT user_id, event_id, event_type, ts, lead(ts) OVER s AS nxt, lead(event_type) OVER s AS to_state FROM events
      WINDOW s AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE to_state IS NOT NULL""",
)
def _(r):
    return series.dwell_times(r.t("events", "event_id", "ts", "user_id", "event_type"), "user_id", "ts", "event_type", "event_id")
