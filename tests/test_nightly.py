import json

from pyspark.sql import functions as F

from larder.plans import nightly
from larder.session import scratch_path
from larder.sources.roles import Roles
from larder.sources.sinks import read_published


def inputs(r):
    return nightly.Inputs(
        sales=r.daily_qty("fine"), usage=r.actual_usage(), items=r.pos_order_items(), orders=r.pos_orders(),
        alias=r.item_alias(), recipes=r.recipe_master(), skus=r.dim_part(), ingredients=r.dim_ingredients(),
        stock=r.kitchen_stock(), pos=r.open_pos(), receipts=r.grn_log(), vendors=r.vendor_master(),
    )


def test_run_publishes_every_table_and_is_repeatable(spark):
    r = Roles(spark, "/root/testdata/sf0.001")
    folder = scratch_path(spark, "nightly")
    out = nightly.run(inputs(r), folder, r.ship_as_of, r.order_as_of, model="moving_average")
    counts = {name: df.count() for name, df in out.items()}
    assert all(counts.values()), counts
    pending = out["alerts"].where("resolved = 0")
    assert pending.select("alert_type", "sku", "outlet", "ingredient").distinct().count() == pending.count()
    for row in out["fact_procurement"].collect():
        assert row.recommended_qty % row.moq == 0
    payload = {row.endpoint: json.loads(row.payload) for row in out["app_cache"].collect()}
    assert payload["dashboard_summary"][0]["active_alerts_count"] == counts["alerts"]
    assert len(payload["reports_wastage"]) <= 20
    again = nightly.run(inputs(r), folder, r.ship_as_of, r.order_as_of, model="moving_average")
    assert {name: df.count() for name, df in again.items()} == counts


def test_accuracy_scores_what_earlier_runs_forecast(spark):
    r = Roles(spark, "/root/testdata/sf0.001")
    folder = scratch_path(spark, "nightly")
    for back in (21, 14, 0, 0):
        out = nightly.run(inputs(r), folder, F.date_sub(r.ship_as_of, back), r.order_as_of, model="moving_average")
    payload = {row.endpoint: json.loads(row.payload) for row in out["app_cache"].collect()}
    assert payload["reports_accuracy"] and all(0 <= week["accuracy"] <= 100 for week in payload["reports_accuracy"])
    assert payload["dashboard_summary"][0]["forecast_accuracy_percent"] is not None
    kept = spark.read.parquet(f"{folder}/forecast_history")
    assert kept.select("model_run_date").distinct().count() == 3
    assert kept.groupBy("model_run_date", "sku", "outlet", "forecast_date").count().where("count > 1").count() == 0


def test_golden_case_from_raw_feeds(spark):
    """One dish of two recipes (100 g + 1 g of an item), sold three times and 90 g used: cleaned, stored and planned."""
    make = spark.createDataFrame
    feeds = nightly.Feeds(
        orders=make(
            [(" 1 ", "2026-07-15 20:00:00", "Delivered", "Khichdi Tales", 1), ("2", "2026-07-15 20:00:00", "cancelled", "Khichdi Tales", 1),
             ("1", "2026-07-15 20:00:00", "completed", " Khichdi Tales", 2), ("", "2026-07-15 20:00:00", "completed", "x", 1)],
            "order_id string, created_at string, status string, store_name string, version int",
        ),
        items=make(
            [("a", "1", "  Palak   KHICHDI", "nan", "2", 1), ("a", "1", "Palak Khichdi", None, " 3 ", 2), ("b", "1", "Palak Khichdi", "", "0", 1),
             ("c", "1", "Palak Khichdi", "", "many", 1), ("d", "2", "Palak Khichdi", "", "9", 1)],
            "id string, order_id string, item_name string, option_names string, quantity string, version int",
        ),
        stock=make(
            [("2026-07-16 21:30:00", "North", "North wh", "Item 9", "0.5", "Kg.", 1), ("2026-07-16 21:30:00", "North", "North wh", "Item 9", "0.2", "Kg.", 2),
             ("2026-07-16 21:30:00", "North", "North wh", "Item 8", "-4", "g", 1)],
            "snapshot_time string, kitchen string, location string, ingredient string, qty_available string, unit string, version int",
        ),
        pos=make(
            [("p1", "Item 9", "V", "40", "2026-07-01", "open", 1), ("p1", "Item 9", "V", "x", "never", "open", 2)],
            "po_number string, ingredient string, vendor string, qty_ordered string, expected_date string, status string, version int",
        ),
        receipts=make(
            [("g1", "p1", "Item 9", "2026-07-02", "41", 1)],
            "grn_number string, po_number string, ingredient string, received_date string, qty_received string, version int",
        ),
        vendors=make(
            [("Item 9", "V", "x", None, "2.5", 1)],
            "ingredient string, vendor_name string, lead_time_days string, moq string, price string, version int",
        ),
    )
    day = "DATE'2026-07-16'"
    tables = {
        "sales": spark.sql(f"SELECT {day} AS date, 'Item 9' AS sku, 'khichdi tales' AS outlet, 90.0D AS qty_sold"),
        "usage": spark.sql(f"SELECT {day} AS date, 'khichdi tales' AS outlet, 'Item Nine' AS sku, 90.0D AS qty_sold"),
        "alias": make(
            [("palak khichdi", None, "Dish A", 1.0, None), ("palak khichdi", None, "Dish B", 1.0, None)],
            "pos_name string, pos_option string, recipe_name string, multiplier double, additive_offset double",
        ),
        "recipes": make(
            [("Dish A", "CODE9", 100.0, "g"), ("Dish B", "CODE9", 1.0, "g")], "dish_name string, ingredient string, qty_per_unit double, unit string"
        ),
        "skus": make([("code9", "Item Nine")], "sku_code string, sku_name string"),
        "ingredients": make([], "sku string, name string"),
    }
    as_of = F.expr(day)
    folder = scratch_path(spark, "nightly")
    out = nightly.run_from_feeds(feeds, tables, folder, as_of, as_of, model="moving_average", horizon=8)
    found = out["fact_variance"].collect()
    assert [(r.ingredient, r.expected_qty, r.actual_qty, r.variance_qty) for r in found] == [("item nine", 303.0, 90.0, -213.0)]
    need = out["fact_procurement"].first()
    # The newer stock row counts, in grams; the order's quantity and the vendor's lead time are unreadable: 0 and 3 days.
    assert (need.warehouse_stock, need.po_qty, need.lead_time_days, need.moq, need.price) == (200.0, 0.0, 3, 1.0, 2.5)
    stock = read_published(spark, f"{folder}/clean_stock").collect()
    assert [(r.ingredient, r.qty_available, r.unit, str(r.snapshot_date)) for r in stock] == [("Item 9", 200.0, "g", "2026-07-16")]
    pos = read_published(spark, f"{folder}/clean_pos").collect()
    assert [(r.qty_ordered, r.expected_date) for r in pos] == [(0.0, None)]


def test_default_model_forecasts_every_series(spark):
    r = Roles(spark, "/root/testdata/sf0.001")
    given = inputs(r)
    given = nightly.Inputs(**{**vars(given), "sales": r.daily_qty("coarse")})
    out = nightly.run(given, scratch_path(spark, "nightly"), r.ship_as_of, r.order_as_of, horizon=3)
    sold = given.sales.where(F.col("date") >= F.date_sub(r.ship_as_of, nightly.LOOKBACK_DAYS))
    forecast = out["fact_forecast"]
    assert forecast.count() == 3 * sold.select("sku", "outlet").distinct().count()
    assert forecast.where("qty_predicted IS NULL OR qty_predicted < 0").count() == 0
