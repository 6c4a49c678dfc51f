"""The planning run: every step reads what the step before has written.

Steps hand over through tables in reliable storage, not through one growing
plan: a lost executor repeats a step's tasks, a failed run resumes from the
last table, and nothing is computed twice. A failing step fails the run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from larder.functions import units
from larder.operators import accuracy, cleaning, forecast as fc, learned, purchasing, recipes as rc
from larder.plans import alerts, procurement, reports, supply, variance
from larder.session import checkpointed
from larder.sources.sinks import path_exists, publish, read_published, report_json

LOOKBACK_DAYS = 365


@dataclass(frozen=True)
class Inputs:
    """Source tables of a run."""

    sales: DataFrame  # date, sku, outlet, qty_sold
    usage: DataFrame  # date, outlet, sku (name), qty_sold
    items: DataFrame
    orders: DataFrame
    alias: DataFrame
    recipes: DataFrame
    skus: DataFrame
    ingredients: DataFrame
    stock: DataFrame
    pos: DataFrame
    receipts: DataFrame
    vendors: DataFrame


@dataclass(frozen=True)
class Feeds:
    """Tables as their sources deliver them: numbers and dates as text, stray blanks, any unit, repeated versions of a row.

    Every feed has the column ``version``; of the versions of a row the highest counts.
    """

    orders: DataFrame  # order_id, created_at (UTC text), status, store_name
    items: DataFrame  # id, order_id, item_name, option_names, quantity
    stock: DataFrame  # snapshot_time, kitchen, location, ingredient, qty_available, unit
    pos: DataFrame  # po_number, ingredient, vendor, qty_ordered, expected_date, status
    receipts: DataFrame  # grn_number, po_number, ingredient, received_date, qty_received
    vendors: DataFrame  # ingredient, vendor_name, lead_time_days, moq, price


VERSION = ["version"]


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Store ``df`` as a new version of a table of the run and read it back."""
    path = f"{folder}/{name}"
    publish(df, path)
    return read_published(df.sparkSession, path)


def clean_feeds(feeds: Feeds) -> dict[str, DataFrame]:
    """The fields of :class:`Inputs` that come from feeds: cleaned, one row per key, stock in g or ml."""
    orders = cleaning.clean_orders(feeds.orders, VERSION).select(
        F.col("order_id").alias("id"), F.to_date("created_at").alias("order_date"), "store_name"
    )
    items = cleaning.clean_items(feeds.items, VERSION).drop("id")  # orders have the other ``id``
    # Aliases tell items without an option by NULL.
    items = items.withColumn("option_names", F.nullif(F.col("option_names"), F.lit("")))
    key = ["snapshot_time", "kitchen", "location", "ingredient"]
    stock = cleaning.clean_stock(cleaning.keep_last(feeds.stock, key, VERSION))
    qty, unit = units.standardise(F.col("qty_available"), F.col("unit"), F.col("ingredient"))
    cleaned = {
        "orders": orders,
        "items": items,
        "stock": stock.withColumns({"qty_available": qty, "unit": unit}),
        "pos": cleaning.clean_open_pos(feeds.pos, VERSION),
        "receipts": cleaning.clean_receipts(cleaning.keep_last(feeds.receipts, ["grn_number"], VERSION)),
        "vendors": cleaning.clean_vendors(feeds.vendors, VERSION),
    }
    return {name: df.drop(*VERSION) for name, df in cleaned.items()}


def load_feeds(feeds: Feeds, folder: str) -> dict[str, DataFrame]:
    """Clean and convert the feeds, store each as a new version of its table, and return the stored tables."""
    return {name: stored(df, folder, f"clean_{name}") for name, df in clean_feeds(feeds).items()}


def run_from_feeds(
    feeds: Feeds, tables: dict[str, DataFrame], folder: str, as_of: Column, order_day: Column, **options
) -> dict[str, DataFrame]:
    """Load the feeds, then run every planning step on what was stored.

    ``tables`` holds the fields of :class:`Inputs` that no feed delivers; aliases
    must be spelled as ``normalise_name`` does.
    """
    return run(Inputs(**load_feeds(feeds, folder), **tables), folder, as_of, order_day, **options)


def forecasts(inputs: Inputs, as_of: Column, model: str, horizon: int, **params) -> DataFrame:
    start = F.date_sub(as_of, LOOKBACK_DAYS)
    history = inputs.sales.where(F.col("date").between(start, as_of)).select("date", "sku", "outlet", "qty_sold")
    if model == "learned":
        return learned.production_forecast(history, start, as_of, horizon, **params)
    return fc.moving_average(history, as_of, ["sku", "outlet"], horizon=horizon).withColumn(
        "holdout_accuracy", F.lit(None).cast("double")
    )


def keep_forecasts(fresh: DataFrame, folder: str) -> DataFrame:
    """Add a run to the forecasts kept by run date; for each series and day the newest run's forecast.

    A repeated run replaces its own partition. The newest run is picked by a
    pre-aggregated maximum, so runs that overlap for weeks add no wide shuffle.
    """
    path = f"{folder}/forecast_history"
    writer = fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("model_run_date").parquet(path)
    kept = fresh.sparkSession.read.schema(fresh.schema).parquet(path)
    keys = ["sku", "outlet", "forecast_date"]
    rest = [c for c in fresh.columns if c not in keys]
    newest = kept.groupBy(*keys).agg(F.max_by(F.struct(*rest), "model_run_date").alias("_f"))
    return newest.select(*keys, "_f.*")


def raise_alerts(new: DataFrame, folder: str) -> DataFrame:
    """Append the alerts whose key is not pending already; a repeated run adds nothing."""
    spark, path = new.sparkSession, f"{folder}/alerts"
    if path_exists(spark, path):
        new = alerts.suppress_known(new, spark.read.parquet(path))
    checkpointed(new).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def run(
    inputs: Inputs, folder: str, as_of: Column, order_day: Column, model: str = "learned", horizon: int = 30, **params
) -> dict[str, DataFrame]:
    """Run all planning steps into ``folder`` and return the published tables.

    ``as_of`` is the last sales day; ``order_day`` the last complete order day.
    Accuracy compares the days up to ``as_of`` with what earlier runs forecast.
    """
    out: dict[str, DataFrame] = {}
    out["fact_forecast"] = stored(forecasts(inputs, as_of, model, horizon, **params), folder, "fact_forecast")
    known = keep_forecasts(out["fact_forecast"], folder)

    recent = F.col("order_date").between(F.date_sub(order_day, variance.WINDOW_DAYS - 1), order_day)
    expected = rc.expected_usage(
        inputs.items, inputs.orders.where(recent), inputs.alias, inputs.recipes, inputs.skus, inputs.ingredients
    )
    used = inputs.usage.where(F.col("date").between(F.date_sub(order_day, variance.WINDOW_DAYS - 1), order_day))
    out["fact_variance"] = stored(variance.report(expected, rc.actual_usage(used)), folder, "fact_variance")

    demand = stored(fc.ingredient_demand(out["fact_forecast"]), folder, "fact_ingredient_demand")
    out["fact_ingredient_demand"] = demand
    out["warehouse_plan"] = stored(
        supply.warehouse_plan(fc.demand_total(demand), inputs.stock), folder, "warehouse_plan"
    )
    recs = stored(procurement.plan(demand, inputs.stock, inputs.pos, inputs.vendors, as_of), folder, "fact_procurement")
    out["fact_procurement"] = recs

    week_ahead = F.col("forecast_date").between(as_of, F.date_add(as_of, 7))
    rules = [
        alerts.kitchen_stockout(
            inputs.stock, inputs.sales.where(F.col("date") >= F.date_sub(as_of, alerts.ACTIVE_DAYS)), inputs.skus
        ),
        alerts.warehouse_low(demand, inputs.stock, inputs.skus, as_of),
        alerts.po_overdue(inputs.pos, as_of),
        alerts.demand_spike(
            inputs.sales.where(F.col("date") >= F.date_sub(as_of, 28)), out["fact_forecast"].where(week_ahead)
        ),
        alerts.no_recipe(
            inputs.items.join(
                inputs.orders.where(F.col("order_date") >= F.date_sub(order_day, 7)).select("id"),
                F.col("order_id") == F.col("id"), "left_semi",
            ),
            inputs.alias,
        ),
        alerts.lead_time(recs),
    ]
    out["alerts"] = raise_alerts(alerts.stamped(alerts.union(rules), as_of), folder)

    cached = {
        "dashboard_summary": (
            reports.dashboard(inputs.sales, known, recs, inputs.pos, out["alerts"], as_of, as_of), [],
        ),
        "reports_accuracy": (accuracy.wmape_weekly(accuracy.scored(known, inputs.sales)), ["week"]),
        "reports_stockouts": (alerts.stockouts_weekly(out["alerts"], F.date_sub(as_of, 90)), ["week"]),
        "reports_wastage": (
            purchasing.receipt_overage(inputs.pos, inputs.receipts, F.date_sub(as_of, 30)), ["ingredient"],
        ),
        "reports_vendor": (purchasing.vendor_delays(inputs.pos, as_of), ["vendor"]),
    }
    payloads = [report_json(df, name, order, as_of) for name, (df, order) in cached.items()]
    out["app_cache"] = stored(alerts.union(payloads), folder, "app_cache")
    return out
