"""One global tree ensemble over all series, with recursive multi-day forecasts."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, functions as F

from larder.functions.dates import near_holiday
from larder.operators import accuracy, series
from larder.operators.backtest import FOLD_STEP_DAYS, TEST_DAYS
from larder.operators.forecast import recent_mean, with_band
from larder.operators.skew import salted_join
from larder.session import checkpointed

#: Days on which the number of trees is chosen, and days that nothing has seen.
VALIDATION_DAYS, HELD_OUT_DAYS = 28, 7
TAIL_DAYS = 28
CHECKPOINT_EVERY = 7
#: Weeks are dealt into so many folds; a training row's means come from the other folds.
MEAN_FOLDS = 5
FIRST_TREES, MOST_TREES, PATIENCE = 32, 128, 8
ENCODED = ["sku_mean", "outlet_mean"]
INPUTS = [*series.FEATURES, *ENCODED]
RECENT = [c for c in series.FEATURES if c.startswith(("lag_", "roll_mean_"))]


@dataclass(frozen=True)
class Length:
    """How many trees were best on the validation days, and their mean absolute error there in units sold."""

    trees: int
    error: float


def training_frame(history: DataFrame, start: Column, cutoff: Column, means_to: Column | None = None) -> DataFrame:
    """Features of every series with enough history up to ``cutoff``.

    Series, item and outlet enter as their mean demand up to ``means_to`` (the
    cutoff unless given). Unlike category indexes this needs no list of all
    categories on the driver and no bin per category.
    """
    seen = series.enough_history(history.where(F.col("date") <= cutoff))
    frame = series.feature_frame(series.dense_panel(seen, start, cutoff)).drop("combo_mean")
    means_to = cutoff if means_to is None else means_to
    return _encode(frame, means_to).withColumn("is_validation", F.col("date") > F.date_sub(cutoff, VALIDATION_DAYS))


def _encode(frame: DataFrame, means_to: Column) -> DataFrame:
    """Mean demand on the sold days of the series, the item and the outlet, none of which holds the row it stands beside.

    Rows up to ``means_to`` are dealt into folds by week, and each takes the
    means of the other folds; later rows take those of all. Totals are one row
    per series with an element per fold, so only they are shuffled by item and
    by outlet; the frame stays where its windows put it.
    """
    fold = F.pmod(F.floor(F.datediff("date", F.lit("1970-01-01").cast("date")) / 7), MEAN_FOLDS).cast("int")
    dealt = frame.withColumn("_fold", F.when(F.col("date") <= means_to, fold))
    totals = dealt.groupBy(*series.KEYS).agg(
        *[F.coalesce(F.sum(F.when(F.col("_fold") == f, F.col("qty_sold"))), F.lit(0.0)).alias(f"_q{f}") for f in range(MEAN_FOLDS)],
        *[F.count_if((F.col("_fold") == f) & F.col("observed")).alias(f"_n{f}") for f in range(MEAN_FOLDS)],
    )
    parts = [f"_{x}{f}" for x in "qn" for f in range(MEAN_FOLDS)]
    codes = totals.withColumnsRenamed({c: f"combo{c}" for c in parts})
    for col, name in zip(series.KEYS, ("sku", "outlet")):
        codes = salted_join(codes, totals.groupBy(col).agg(*[F.sum(c).alias(name + c) for c in parts]), [col])

    def others(name: str) -> Column:
        """Total over count of the folds that the row is not in."""
        sums = [
            reduce(lambda a, c: a + c, [F.when(F.col("_fold") == f, 0.0).otherwise(F.col(f"{name}_{x}{f}")) for f in range(MEAN_FOLDS)])
            for x in "qn"
        ]
        return F.when(sums[1] > 0, sums[0] / sums[1])

    joined = dealt.join(codes, series.KEYS)
    item = F.coalesce(others("sku"), F.lit(0.0))
    return joined.select(
        *frame.columns, F.coalesce(others("combo"), item).alias("combo_mean"), item.alias("sku_mean"),
        F.coalesce(others("outlet"), F.lit(0.0)).alias("outlet_mean"),
    )


def _vectors(df: DataFrame) -> DataFrame:
    """Assembled inputs, recent quantities relative to the series' own level."""
    relative = df.withColumns({f"_{c}": F.col(c) / _scale() for c in RECENT}).withColumn("_scale", _scale())
    inputs = [f"_{c}" if c in RECENT else c for c in INPUTS]
    vectors = VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep").transform(relative)
    return vectors.drop(*[f"_{c}" for c in RECENT])


def _scale() -> Column:
    return F.col("combo_mean") + 1


def _boosted(rows: DataFrame, trees: int, max_depth: int, seed: int) -> GBTRegressionModel:
    gbt = GBTRegressor(
        featuresCol="features", labelCol="_target", weightCol="_scale", lossType="absolute", maxIter=trees, maxDepth=max_depth,
        stepSize=0.1, subsamplingRate=0.8, minInstancesPerNode=30, seed=seed, checkpointInterval=10,
    )
    return gbt.fit(rows)


def best_length(frame: DataFrame, most_trees: int = MOST_TREES, max_depth: int = 5, patience: int = PATIENCE, seed: int = 7) -> Length:
    """The ensemble length with the least error on the validation days.

    The ensemble is fitted to the rows before those days without early stopping,
    every prefix of it is scored on them, and its length is doubled until the
    best prefix lies ``patience`` trees back (or at ``most_trees``). One weak
    tree therefore doesn't end the learning.

    The target is relative to the level of the series, as steps of an absolute
    loss all have the same size; weighted by that level, the loss is the
    absolute error in units sold. ``frame`` should be materialised: boosting
    reads it often.
    """
    rows = checkpointed(_vectors(frame).withColumn("_target", F.col("qty_sold") / F.col("_scale")).select("features", "_target", "_scale", "is_validation"))
    train, later = rows.where(~F.col("is_validation")), rows.where("is_validation")
    trees = min(FIRST_TREES, most_trees)
    while True:
        errors = _boosted(train, trees, max_depth, seed).evaluateEachIteration(later, "absolute")
        best = errors.index(min(errors)) + 1
        if trees >= most_trees or best + patience <= trees:
            return Length(best, errors[best - 1])
        trees = min(2 * trees, most_trees)


def fit(frame: DataFrame, trees: int, max_depth: int = 5, seed: int = 7) -> GBTRegressionModel:
    rows = _vectors(frame).withColumn("_target", F.col("qty_sold") / F.col("_scale")).select("features", "_target", "_scale")
    return _boosted(checkpointed(rows), trees, max_depth, seed)


def predict(model: GBTRegressionModel, frame: DataFrame) -> DataFrame:
    scored = model.transform(_vectors(frame)).drop("features")
    quantity = F.greatest(F.col("prediction") * F.col("_scale"), F.lit(0.0))
    return scored.withColumn("qty_predicted", quantity).drop("prediction", "_scale")


def series_state(frame: DataFrame, cutoff: Column) -> DataFrame:
    """One row per series: its last 28 days (oldest first) and its constant features."""
    recent = frame.where(F.col("date") > F.date_sub(cutoff, TAIL_DAYS))
    ordered = F.sort_array(F.collect_list(F.struct("date", "qty_sold")))
    return recent.groupBy(*series.KEYS).agg(
        F.transform(ordered, lambda x: x["qty_sold"]).alias("tail"),
        *[F.max_by(c, "date").alias(c) for c in ("combo_mean", *ENCODED)],
    )


def recursive(model: GBTRegressionModel, state: DataFrame, cutoff: Column, horizon: int) -> DataFrame:
    """Day by day, each prediction feeding the next day's lags and means.

    The whole memory of a series is a 28-element array in its row, so a step is
    a projection: no join, no shuffle, no growing panel. Lineage is cut every
    few steps into the shared checkpoint folder.
    """
    day0 = cutoff
    state = state.withColumns({"preds": F.array().cast("array<double>"), "run_date": day0})
    for k in range(1, horizon + 1):
        tail = F.col("tail")
        day = F.date_add("run_date", k)
        step = state.withColumns(
            {
                **{f"lag_{n}": F.element_at(tail, -n) for n in series.LAGS},
                **{
                    f"roll_mean_{n}": F.aggregate(F.slice(tail, -n, n), F.lit(0.0), lambda a, x: a + x) / n
                    for n in series.LAGS
                },
                "dow": F.weekday(day), "dom": F.dayofmonth(day), "month": F.month(day),
                "is_holiday_window": near_holiday(day),
            }
        )
        scored = predict(model, step)
        q = F.array("qty_predicted")
        state = scored.withColumns(
            {"tail": F.slice(F.concat(tail, q), -TAIL_DAYS, TAIL_DAYS), "preds": F.concat("preds", q)}
        ).select(*state.columns)
        if k % CHECKPOINT_EVERY == 0 and k < horizon:
            state = checkpointed(state)
    days = state.select(*series.KEYS, "run_date", F.posexplode("preds").alias("pos", "qty_predicted"))
    return days.select(F.date_add("run_date", F.col("pos") + 1).alias("forecast_date"), *series.KEYS, "qty_predicted")


def _split(frame: DataFrame) -> tuple[bool, bool]:
    """Whether there are rows to learn from, and rows to choose the length by."""
    held = {r.is_validation for r in frame.groupBy("is_validation").count().collect()}
    return False in held, True in held


def run(history: DataFrame, start: Column, cutoff: Column, horizon: int, trees: int | None = None, **params) -> DataFrame:
    """Train up to ``cutoff`` and forecast the days after it, for the series with enough history.

    The number of trees is chosen on the last four weeks, with means that end
    before them, unless the caller knows it; then the model is fitted to all rows.
    """
    seen = checkpointed(history.where(F.col("date") <= cutoff))
    if trees is None:
        chosen = choose(seen, start, cutoff, **params)
        trees = chosen.trees if chosen else 0
    if not trees:
        # No series is long enough to learn from.
        return seen.limit(0).select(
            F.lit(None).cast("date").alias("forecast_date"), *series.KEYS, F.lit(None).cast("double").alias("qty_predicted"), F.lit(0).alias("n_trees")
        )
    frame = checkpointed(training_frame(seen, start, cutoff))
    model = fit(frame, trees, **{k: v for k, v in params.items() if k in ("max_depth", "seed")})
    return recursive(model, _whole_means(frame, series_state(frame, cutoff)), cutoff, horizon).withColumn("n_trees", F.lit(trees))


def choose(history: DataFrame, start: Column, cutoff: Column, **params) -> Length | None:
    """The length chosen on the last four weeks; none if there is nothing to learn from."""
    frame = checkpointed(training_frame(history, start, cutoff, F.date_sub(cutoff, VALIDATION_DAYS)))
    return best_length(frame, **params) if all(_split(frame)) else None


def _whole_means(frame: DataFrame, state: DataFrame) -> DataFrame:
    """``state`` with the means over all rows of the frame, which the days to forecast are not in."""
    totals = frame.groupBy(*series.KEYS).agg(F.sum("qty_sold").alias("_q"), F.count_if("observed").alias("_n"))
    codes = totals.select(*series.KEYS, F.coalesce(F.try_divide("_q", "_n"), F.lit(0.0)).alias("combo_mean"))
    for col, name in zip(series.KEYS, ENCODED):
        mean = F.coalesce(F.try_divide(F.sum("_q"), F.sum("_n")), F.lit(0.0))
        codes = salted_join(codes, totals.groupBy(col).agg(mean.alias(name)), [col])
    return state.drop("combo_mean", *ENCODED).join(codes, series.KEYS)


def forecast_all(history: DataFrame, start: Column, cutoff: Column, horizon: int, **params) -> DataFrame:
    """Every series times every day of the horizon: the model where it applies, else the recent mean.

    ``run`` leaves out series with little history, or all of them when there
    is nothing to learn from. Those get a flat forecast, so that new and rarely
    sold items do not vanish from demand.
    """
    seen = checkpointed(history.where(F.col("date") <= cutoff).select(*series.KEYS, "date", "qty_sold"))
    learnt = checkpointed(run(seen, start, cutoff, horizon, **params))
    keys = learnt.select(*series.KEYS).distinct()
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"k.{c}")) for c in series.KEYS]
    levels = recent_mean(seen, series.KEYS).alias("l").join(keys.alias("k"), same, "left_anti")
    days = F.explode(F.sequence(F.date_add(cutoff, 1), F.date_add(cutoff, horizon)))
    flat = levels.select(
        days.alias("forecast_date"), *series.KEYS, F.greatest("level", F.lit(0.0)).alias("qty_predicted"), F.lit(0).alias("n_trees")
    )
    return learnt.unionByName(flat)


def fitted_week(history: DataFrame, start: Column, as_of: Column, **params) -> DataFrame:
    """Sold and predicted quantity of every series on each day of the held-out week, and the number of trees.

    No mean, no tree and no choice of their number has seen that week. Series
    that the model leaves out are predicted by their recent mean before that
    week, and by zero when it holds their first sale; their ``n_trees`` is 0.
    """
    seen = checkpointed(history.where(F.col("date") <= as_of).select(*series.KEYS, "date", "qty_sold"))
    held_out = F.date_sub(as_of, HELD_OUT_DAYS)
    columns = [*series.KEYS, "date", "qty_sold", "qty_predicted"]
    chosen = choose(seen.where(F.col("date") <= held_out), start, held_out, **params)
    if chosen is not None:
        frame = checkpointed(training_frame(seen, start, as_of, held_out))
        model = fit(frame.where(F.col("date") <= held_out), chosen.trees)
        short = series.few_days(seen)
        learnt = predict(model, frame.where(F.col("date") > held_out)).select(*columns, F.lit(chosen.trees).alias("n_trees"))
    else:
        short, learnt = seen, None
    levels = recent_mean(short.where(F.col("date") <= held_out), series.KEYS)
    week = series.dense_panel(short, start, as_of).where(F.col("date") > held_out)
    level = F.greatest(F.coalesce("level", F.lit(0.0)), F.lit(0.0))
    flat = week.join(levels, series.KEYS, "left").withColumn("qty_predicted", level).select(*columns, F.lit(0).alias("n_trees"))
    return flat if learnt is None else learnt.unionByName(flat)


def against_means(history: DataFrame, start: Column, as_of: Column, days: int = 7, n: int = 14, **params) -> DataFrame:
    """Accuracy on the last ``days`` days of the model, of the ``n``-day mean and of the series mean, on the same rows.

    Rows are all days of the series of enough history, a day without a sale
    being one of zero sales; nothing has seen them, not even the choice of the
    number of trees.
    """
    cutoff = F.date_sub(as_of, days)
    seen = checkpointed(history.where(F.col("date").between(start, as_of)).select(*series.KEYS, "date", "qty_sold"))
    before, after = seen.where(F.col("date") <= cutoff), seen.where(F.col("date") > cutoff)
    predicted = run(seen, start, cutoff, days, **params)
    scored = accuracy.scored(predicted, after, dense=True)
    means = before.groupBy(*series.KEYS).agg(F.avg("qty_sold").alias("series_mean"))
    levels = recent_mean(before, series.KEYS, n).withColumnRenamed("level", "recent_mean")
    rows = scored.join(means, series.KEYS).join(levels, series.KEYS)
    wrong = {"learned": F.sum("abs_err"), "recent_mean": F.sum(F.abs(F.col("recent_mean") - F.col("qty_sold"))), "series_mean": F.sum(F.abs(F.col("series_mean") - F.col("qty_sold")))}
    totals = rows.agg(F.count("*").alias("n_rows"), F.max("n_trees").alias("n_trees"), F.sum("qty_sold").alias("_sold"), *[e.alias(f"_{k}") for k, e in wrong.items()])
    return totals.select("n_rows", "n_trees", *[F.round(100 * (1 - F.col(f"_{k}") / F.col("_sold")), 4).alias(f"{k}_accuracy") for k in wrong])


def holdout_accuracy(history: DataFrame, start: Column, as_of: Column, days: int = 7, **params) -> DataFrame:
    """Accuracy per series on the last ``days`` days, which the model has not seen."""
    cutoff = F.date_sub(as_of, days)
    predicted = forecast_all(history, start, cutoff, days, **params)
    actual = history.where(F.col("date") > cutoff)
    return accuracy.wmape(accuracy.scored(predicted, actual), *series.KEYS, out="holdout_accuracy")


def production_forecast(history: DataFrame, start: Column, as_of: Column, horizon: int = 30, **params) -> DataFrame:
    """Two passes: score a held-out week, then retrain on everything and forecast, with the score attached."""
    score = holdout_accuracy(history, start, as_of, **params)
    ahead = with_band(forecast_all(history, start, as_of, horizon, **params))
    return ahead.withColumn("model_run_date", as_of).join(score, series.KEYS, "left")


def backtest(daily: DataFrame, as_of: Column, folds: int = 12, lookback: int = 120, threads: int = 4, **params) -> DataFrame:
    """Scored rows of weekly rolling-origin folds; test features come from predictions, never from test actuals.

    The daily series is written once, cut to the folds' days, and reread by each
    fold. The number of trees is chosen once, before the first fold's cutoff, so
    no fold has seen its own test days in any way. Folds are independent jobs,
    ``threads`` of them at a time.
    """
    first = F.date_sub(as_of, TEST_DAYS + (folds - 1) * FOLD_STEP_DAYS + lookback)
    daily = checkpointed(daily.where(F.col("date").between(first, as_of)))

    earliest = F.date_sub(as_of, TEST_DAYS + (folds - 1) * FOLD_STEP_DAYS)
    chosen = choose(daily.where(F.col("date") <= earliest), F.date_sub(earliest, lookback), earliest, **params)
    trees = chosen.trees if chosen else None  # else each fold looks for itself

    def score(fold: int) -> DataFrame:
        cutoff = F.date_sub(as_of, TEST_DAYS + (folds - fold) * FOLD_STEP_DAYS)
        start = F.date_sub(cutoff, lookback)
        window = daily.where(F.col("date").between(start, F.date_add(cutoff, TEST_DAYS)))
        predicted = run(window, start, cutoff, TEST_DAYS, trees=trees, **params)
        return accuracy.scored(predicted, window.where(F.col("date") > cutoff)).withColumn("fold", F.lit(fold))

    with ThreadPoolExecutor(threads) as pool:
        parts = list(pool.map(inheritable_thread_target(daily.sparkSession)(score), range(1, folds + 1)))
    return reduce(DataFrame.unionByName, parts)
