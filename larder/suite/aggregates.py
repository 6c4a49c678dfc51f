"""D-queries: aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import accuracy, forecast as fc, joins, purchasing, recipes, sales
from larder.plans import alerts, procurement, reports, supply, variance
from larder.suite.joins import DEMAND_TOTAL_SQL, EXPECTED_SQL, HORIZON_SQL, LATEST_WH_SQL
from larder.suite.registry import query


D1_SQL = "SELECT date, sku_code, sku, outlet, brand, city, qty_sold, revenue, order_count FROM sales_fine"


@query("D1_daily_sales_rollup", D1_SQL)
def _(r):
    return r.daily_sales("fine")


@query("D1_rollup_by_month", D1_SQL)
def _(r):
    """The same rows from the fact stored by month."""
    return r.by_month().daily_sales("fine")


def _month(r):
    return F.col("o_orderdate") >= F.date_sub(r.order_as_of, 30).cast("timestamp_ntz")


@query(
    "D2_pos_sales_detail",
    """WITH per_order AS (SELECT order_id, item_name, sum(CAST(nullif(replace(quantity, ',', ''), '') AS DECIMAL(18,4))) AS q,
        sum(CAST(nullif(replace(total_price, ',', ''), '') AS DECIMAL(18,4))) AS p FROM pos_items_text GROUP BY ALL)
    SELECT order_date AS date, item_name AS sku, brand_name AS brand, store_name AS outlet, city,
      CAST(sum(q) AS DOUBLE) AS qty_sold, CAST(sum(p) AS DOUBLE) AS revenue, count(*) AS order_count
    FROM pos_orders JOIN per_order ON id = order_id WHERE order_date > (SELECT d - 31 FROM order_day) GROUP BY ALL""",
)
def _(r):
    return sales.pos_detail(r.pos_items_text(_month(r)), r.pos_orders(_month(r)))


def _week(r, grain="fine"):
    return r.daily_sales(grain, since=F.date_sub(r.ship_as_of, 7))


WEEK_SQL = "date >= (SELECT d - 7 FROM ship_day)"


CONSUMPTION_SQL = f"""SELECT sku, brand, outlet, city, sum(qty_sold) AS qty_sold, round(sum(revenue), 2) AS revenue,
      CAST(sum(order_count) AS BIGINT) AS order_count FROM sales_fine WHERE {WEEK_SQL} GROUP BY sku, brand, outlet, city"""


@query("D3_consumption_by_sku_outlet", CONSUMPTION_SQL)
def _(r):
    return sales.consumption(_week(r))


@query("D3_consumption_by_month", CONSUMPTION_SQL)
def _(r):
    """The week read from its months of the stored fact."""
    return sales.consumption(_week(r.by_month()))


@query(
    "D4_sales_summary",
    f"""SELECT round(sum(revenue), 2) AS total_revenue, CAST(sum(order_count) AS BIGINT) AS total_orders, sum(qty_sold) AS total_qty,
      round(sum(revenue) / nullif(sum(order_count), 0), 2) AS avg_order_value, count(DISTINCT sku) AS unique_skus
    FROM sales_fine WHERE {WEEK_SQL}""",
)
def _(r):
    return sales.sales_summary(_week(r))


@query(
    "D4_pos_sales_summary",
    """SELECT round(sum(total_amount), 2) AS total_revenue, count(id) AS total_orders,
      round(sum(total_amount) / nullif(count(id), 0), 2) AS avg_order_value,
      (SELECT count(DISTINCT item_name) FROM pos_order_items JOIN pos_orders ON order_id = id
        WHERE order_date >= (SELECT d - 30 FROM order_day)) AS unique_skus
    FROM pos_orders WHERE order_date >= (SELECT d - 30 FROM order_day)""",
)
def _(r):
    return sales.order_summary(r.pos_orders(_month(r)), r.pos_order_items(_month(r)))


@query(
    "D5_top_k_skus",
    f"""SELECT sku, sum(qty_sold) AS total_qty, round(sum(revenue), 2) AS total_revenue FROM sales_fine WHERE {WEEK_SQL}
    GROUP BY sku ORDER BY total_qty DESC, sku LIMIT 10""",
)
def _(r):
    return sales.top_skus(_week(r))


@query(
    "D5_top_movers",
    """SELECT sku_code AS sku, sum(qty_sold) AS total_qty FROM sales_fine WHERE sku_code IN (SELECT code FROM tracker)
      AND date >= (SELECT d - 2 FROM ship_day) GROUP BY sku_code ORDER BY total_qty DESC, sku_code LIMIT 5""",
)
def _(r):
    return sales.top_movers(r.daily_qty("fine", since=F.date_sub(r.ship_as_of, 2)), r.tracker())


@query(
    "D6_sales_by_brand",
    """SELECT brand_name AS brand, round(sum(total_amount), 2) AS revenue, count(id) AS orders FROM pos_orders
    WHERE order_date >= (SELECT d - 30 FROM order_day) GROUP BY brand_name ORDER BY revenue DESC""",
)
def _(r):
    return sales.by_brand(r.pos_orders(_month(r)))


@query(
    "D7_first_last_attr_agg",
    """SELECT date, p_type AS sku_code, city AS outlet, sum(l_quantity) AS qty, arg_min(p_name, CAST(sku_code AS BIGINT)) AS name
    FROM sales_lines GROUP BY date, p_type, city""",
)
def _(r):
    lines = r.sales_lines().select(
        "date", F.col("p_type").alias("sku_code"), F.col("city").alias("outlet"), F.col("l_quantity").alias("qty"),
        F.col("p_name").alias("name"), F.col("sku_code").cast("bigint").alias("part"),
    )
    return sales.rollup_with_attributes(lines, ["date", "sku_code", "outlet"], "qty", ["name"], F.col("part"))


@query("D8_expected_usage", f"WITH {EXPECTED_SQL} SELECT date, outlet, ingredient, unit, expected_qty FROM expected")
def _(r):
    return variance.usage_of(r)[0]


@query("D9_actual_usage", f"WITH {EXPECTED_SQL} SELECT date, outlet, ingredient, actual_qty FROM actual")
def _(r):
    return variance.usage_of(r)[1]


@query("D10_forecast_horizon_agg", f"WITH {HORIZON_SQL} SELECT * FROM horizon")
def _(r):
    return supply.horizon_total(r.forecast(), F.date_sub(r.ship_as_of, 20), 7)


PICK_SQL = "sku IN ('ECONOMY', 'PROMO') AND outlet IN ('ASIA', 'EUROPE')"


def picked():
    return F.col("sku").isin("ECONOMY", "PROMO") & F.col("outlet").isin("ASIA", "EUROPE")


@query(
    "D11_forecast_by_day",
    f"""SELECT forecast_date, round(sum(qty_predicted), 2) AS qty_predicted, round(sum(qty_lower), 2) AS qty_lower,
      round(sum(qty_upper), 2) AS qty_upper, max(model_run_date) AS model_run_date FROM forecast
    WHERE {PICK_SQL} AND forecast_date >= (SELECT d - 7 FROM ship_day) GROUP BY forecast_date""",
)
def _(r):
    chosen = r.forecast().where(picked() & (F.col("forecast_date") >= F.date_sub(r.ship_as_of, 7)))
    return (
        chosen.groupBy("forecast_date")
        .agg(
            *[F.round(F.sum(c), 2).alias(c) for c in ("qty_predicted", "qty_lower", "qty_upper")],
            F.max("model_run_date").alias("model_run_date"),
        )
        .orderBy("forecast_date")
    )


@query(
    "D12_history_by_day",
    f"""SELECT date, sum(qty_sold) AS qty_sold FROM sales_coarse WHERE {PICK_SQL}
      AND date >= (SELECT d - 30 FROM ship_day) AND date < (SELECT d FROM ship_day) GROUP BY date""",
)
def _(r):
    days = r.daily_qty(since=F.date_sub(r.ship_as_of, 30), until=F.date_sub(r.ship_as_of, 1))
    return days.where(picked()).groupBy("date").agg(F.sum("qty_sold").alias("qty_sold")).orderBy("date")


@query("D13_outlet_array_by_city", "SELECT city, list_sort(list(DISTINCT outlet)) AS outlets FROM dim_outlets GROUP BY city")
def _(r):
    return reports.outlets_by_city(r.dim_outlets())


PO_DAY_SQL = "(SELECT d - 365 FROM order_day)"


@query(
    "D14_conditional_counts",
    f"""SELECT count(*) FILTER (WHERE status <> 'Delivered') AS total_open_pos,
      count(*) FILTER (WHERE status <> 'Delivered' AND expected_date < {PO_DAY_SQL}) AS overdue_pos FROM open_pos""",
)
def _(r):
    return purchasing.order_counts(r.open_pos(), F.date_sub(r.order_as_of, 365))


@query(
    "D15_vendor_delay_top",
    f"""WITH judged AS (SELECT vendor, CAST(coalesce(status <> 'Delivered' AND expected_date < {PO_DAY_SQL}, false) AS INTEGER) AS late FROM open_pos)
    SELECT vendor, count(*) AS total_pos, CAST(sum(late) AS BIGINT) AS overdue_pos, round(avg(late) * 100, 4) AS delay_rate_pct
    FROM judged GROUP BY vendor HAVING total_pos > 4 ORDER BY avg(late) DESC, total_pos DESC, vendor LIMIT 3""",
)
def _(r):
    return purchasing.vendor_delays(r.open_pos(), F.date_sub(r.order_as_of, 365))


@query(
    "D16_vendor_on_time",
    """WITH due AS (SELECT vendor, po_number, expected_date, count(*) AS m FROM open_pos GROUP BY ALL),
      came AS (SELECT po_number, received_date, count(*) AS n FROM grn_log WHERE grn_number <> '' GROUP BY ALL),
      tally AS (SELECT vendor, CAST(sum(m * n) AS BIGINT) AS total_orders,
        CAST(sum(CASE WHEN received_date <= expected_date THEN m * n ELSE 0 END) AS BIGINT) AS on_time
        FROM due JOIN came USING (po_number) GROUP BY vendor),
      rated AS (SELECT *, round(on_time / total_orders * 100, 1) AS on_time_pct FROM tally)
    SELECT *, CASE WHEN on_time_pct < 75 THEN 'poor' WHEN on_time_pct < 90 THEN 'fair' ELSE 'good' END AS band FROM rated""",
)
def _(r):
    return purchasing.vendor_on_time(r.open_pos(), r.grn_log())


@query(
    "D17_receipt_overage",
    """WITH came AS (SELECT po_number, ingredient, sum(qty_received) AS q, count(*) AS n FROM grn_log
        WHERE received_date > (SELECT d - 31 FROM ship_day) GROUP BY ALL),
      asked AS (SELECT po_number, ingredient, sum(qty_ordered) AS o, count(*) AS m FROM open_pos GROUP BY ALL),
      weighed AS (SELECT ingredient, sum(q * m) AS total_received, sum(o * n) AS total_ordered
        FROM came JOIN asked USING (po_number, ingredient) GROUP BY ingredient)
    SELECT *, total_received - total_ordered AS potential_wastage FROM weighed WHERE total_received > total_ordered
    ORDER BY potential_wastage DESC, ingredient LIMIT 20""",
)
def _(r):
    return purchasing.receipt_overage(r.open_pos(), r.grn_log(), F.date_sub(r.ship_as_of, 30))


SCORED_SQL = """scored AS (SELECT f.sku, f.outlet, forecast_date, qty_predicted, qty_sold FROM forecast f
    JOIN sales_coarse s ON f.sku = s.sku AND f.outlet = s.outlet AND f.forecast_date = s.date)"""
WMAPE_SQL = """round(CASE WHEN sum(qty_sold) <> 0 THEN greatest(0.0,
    100.0 * (1.0 - sum(abs(qty_predicted - qty_sold)) / sum(qty_sold))) END, 4)"""


def _scored(r, dense=False):
    return accuracy.scored(r.forecast(), r.daily_qty(since=r.forecast_cut), dense)


@query(
    "D18_wmape_accuracy",
    f"WITH {SCORED_SQL} SELECT {WMAPE_SQL} AS accuracy FROM scored WHERE forecast_date >= (SELECT d - 14 FROM ship_day)",
)
def _(r):
    return accuracy.wmape(_scored(r).where(F.col("forecast_date") >= F.date_sub(r.ship_as_of, 14)))


@query(
    "D18_wmape_accuracy_dense",
    f"""WITH scored AS (SELECT f.sku, f.outlet, qty_predicted, coalesce(qty_sold, 0.0) AS qty_sold FROM forecast f
      LEFT JOIN sales_coarse s ON f.sku = s.sku AND f.outlet = s.outlet AND f.forecast_date = s.date)
    SELECT {WMAPE_SQL} AS accuracy FROM scored""",
)
def _(r):
    return accuracy.wmape(_scored(r, dense=True))


@query(
    "D19_wmape_weekly",
    f"""WITH {SCORED_SQL} SELECT CAST(date_trunc('week', forecast_date) AS DATE) AS week, {WMAPE_SQL} AS accuracy
    FROM scored GROUP BY 1""",
)
def _(r):
    return accuracy.wmape_weekly(_scored(r))


@query("D20_wmape_per_combo", f"WITH {SCORED_SQL} SELECT sku, outlet, {WMAPE_SQL} AS accuracy FROM scored GROUP BY sku, outlet")
def _(r):
    return accuracy.wmape(_scored(r), "sku", "outlet")


@query(
    "D21_mape_masked",
    f"""WITH {SCORED_SQL}, daily AS (SELECT outlet, forecast_date, sum(qty_predicted) AS p, sum(qty_sold) AS a FROM scored GROUP BY 1, 2)
    SELECT outlet, round(greatest(0.0, 100.0 - avg(abs(p - a) / a) FILTER (WHERE a > 0) * 100), 4) AS accuracy,
      round(coalesce(avg(abs(p - a) / a) FILTER (WHERE a <> 0) * 100, 0.0), 4) AS mape FROM daily GROUP BY outlet""",
)
def _(r):
    daily = _scored(r).groupBy("outlet", "forecast_date").agg(F.sum("qty_predicted").alias("p"), F.sum("qty_sold").alias("a"))
    score = accuracy.mape_accuracy(daily, F.col("a"), F.col("p"), "outlet")
    return score.join(accuracy.mape_nonzero(daily, F.col("a"), F.col("p"), "outlet"), "outlet")


@query(
    "D22_stockout_weekly",
    """SELECT CAST(date_trunc('week', created_at) AS DATE) AS week, count(*) AS incidents FROM alert_log
    WHERE alert_type = 'error' AND CAST(created_at AS DATE) >= (SELECT d - 90 FROM event_day) GROUP BY 1""",
)
def _(r):
    return alerts.stockouts_weekly(r.alert_log(), F.date_sub(r.event_as_of, 90), "error")


@query("D23_alerts_by_severity", "SELECT severity, count(*) AS n FROM alert_log WHERE resolved = 0 GROUP BY severity")
def _(r):
    return alerts.by_severity(r.alert_log())


@query(
    "D24_history_depth",
    "SELECT sku, outlet, count(DISTINCT date) AS days, sum(qty_sold) AS total_qty FROM hist_coarse GROUP BY sku, outlet HAVING count(DISTINCT date) >= 30",
)
def _(r):
    return fc.history_depth(r.history())


@query(
    "D25_active_combos",
    "SELECT sku, outlet, sum(qty_sold) AS qty FROM sales_mid WHERE date >= (SELECT d - 45 FROM ship_day) GROUP BY sku, outlet HAVING sum(qty_sold) > 0",
)
def _(r):
    return fc.active_combos(r.daily_qty("mid", since=F.date_sub(r.ship_as_of, 45)))


@query(
    "D26_top_combos",
    """SELECT sku, outlet, sum(qty_sold) AS qty FROM sales_mid WHERE date >= (SELECT d - 30 FROM ship_day)
    GROUP BY sku, outlet ORDER BY qty DESC, sku, outlet LIMIT 100""",
)
def _(r):
    return fc.top_combos(r.daily_qty("mid", since=F.date_sub(r.ship_as_of, 30)))


@query("D27_combo_mean", "SELECT sku, outlet, avg(qty_sold) AS combo_mean FROM hist_coarse GROUP BY sku, outlet")
def _(r):
    return r.history().groupBy("sku", "outlet").agg(F.avg("qty_sold").alias("combo_mean"))


@query(
    "D28_daily_run_rate",
    """SELECT sku_code AS code, round(sum(qty_sold) / 30.0, 4) AS drr FROM sales_fine WHERE date >= (SELECT d - 30 FROM ship_day)
      AND sku_code IN (SELECT code FROM tracker) GROUP BY sku_code""",
)
def _(r):
    return procurement.run_rate(r.daily_qty("fine", since=F.date_sub(r.ship_as_of, 30)), r.tracker())


@query(
    "D29_ingredient_demand",
    """WITH d1 AS (SELECT forecast_date, sku AS ingredient, round(sum(qty_predicted), 2) AS q FROM forecast GROUP BY 1, 2)
    SELECT CAST(forecast_date AS VARCHAR) AS day, ingredient, q AS total_qty_needed FROM d1
    UNION ALL SELECT 'all', ingredient, round(sum(q), 2) FROM d1 GROUP BY ingredient""",
)
def _(r):
    daily = fc.ingredient_demand(r.forecast())
    total = fc.demand_total(daily).withColumn("day", F.lit("all"))
    return daily.select(F.col("forecast_date").cast("string").alias("day"), "ingredient", "total_qty_needed").unionByName(total)


@query(
    "D30_recipe_tracked_share",
    """WITH known AS (SELECT DISTINCT lower(trim(code)) AS known_code FROM tracked_types),
      parts AS (SELECT dish_name, qty_per_unit AS q, known_code IS NOT NULL AS hit
        FROM recipe_master LEFT JOIN known ON known_code = lower(trim(ingredient))),
      totals AS (SELECT dish_name, round(coalesce(sum(q) FILTER (WHERE hit), 0.0), 4) AS tracked_qty, round(sum(q), 4) AS total_qty
        FROM parts GROUP BY dish_name)
    SELECT *, round(tracked_qty / total_qty * 100, 4) AS tracked_pct FROM totals WHERE tracked_qty > 0""",
)
def _(r):
    return recipes.tracked_share(r.recipe_master(), r.tracked_types())


PROCUREMENT_SQL = """need7 AS (SELECT ingredient, unit, round(sum(total_qty_needed), 2) AS total_demand FROM demand
      WHERE forecast_date <= (SELECT d + 7 FROM ship_day) GROUP BY ingredient, unit),
    whp AS (SELECT ingredient, sum(qty_available) AS warehouse_stock FROM (
      SELECT *, rank() OVER (PARTITION BY location, ingredient ORDER BY snapshot_date DESC) AS rk FROM kitchen_stock
      WHERE lower(location) LIKE '%warehouse%' OR lower(location) LIKE '% wh %' OR lower(location) LIKE '%_wh%'
        OR lower(location) LIKE '%hub%' OR lower(location) LIKE '%central%' OR lower(location) LIKE '%commissary%')
      WHERE rk = 1 GROUP BY ingredient),
    opn AS (SELECT ingredient, sum(qty_ordered) AS po_qty FROM open_pos WHERE status = 'open' GROUP BY ingredient),
    p1 AS (SELECT n.ingredient, n.unit, total_demand, coalesce(warehouse_stock, 0.0) AS warehouse_stock, coalesce(po_qty, 0.0) AS po_qty,
      vendor_name, lead_time_days, moq, price FROM need7 n LEFT JOIN whp USING (ingredient) LEFT JOIN opn USING (ingredient)
      LEFT JOIN vendor_master v ON v.ingredient = n.ingredient),
    p2 AS (SELECT *, greatest(total_demand - warehouse_stock, 0.0) AS net_requirement, total_demand / 7 * lead_time_days AS safety_buffer FROM p1),
    p3 AS (SELECT *, net_requirement + safety_buffer - po_qty AS raw FROM p2),
    p4 AS (SELECT *, CASE WHEN raw <= 0 THEN 0.0 ELSE ceil(raw / CASE WHEN moq > 0 THEN moq ELSE 1.0 END) * CASE WHEN moq > 0 THEN moq ELSE 1.0 END END AS rq FROM p3),
    recs AS (SELECT ingredient, unit, round(total_demand, 2) AS total_demand, round(warehouse_stock, 2) AS warehouse_stock,
      round(net_requirement, 2) AS net_requirement, round(safety_buffer, 2) AS safety_buffer, round(po_qty, 2) AS po_qty,
      vendor_name, CAST(lead_time_days AS INTEGER) AS lead_time_days, moq, price, round(rq, 2) AS recommended_qty,
      round(rq * price, 2) AS estimated_cost, CAST((SELECT d FROM ship_day) + CAST(lead_time_days AS INTEGER) AS DATE) AS expected_delivery,
      CASE WHEN warehouse_stock <= 0 AND total_demand > 0 THEN 'URGENT' ELSE 'NORMAL' END AS urgency FROM p4 WHERE rq > 0)"""


def recommendations(r):
    return procurement.plan(r.demand(), r.kitchen_stock(), r.open_pos(), r.vendor_master(), r.ship_as_of)


DASHBOARD_SQL = f"""WITH {PROCUREMENT_SQL}, {SCORED_SQL}
    SELECT (SELECT CAST(sum(qty_sold) AS BIGINT) FROM sales_coarse WHERE date = (SELECT d FROM ship_day)) AS total_orders_today,
      (SELECT count(DISTINCT sku) FROM forecast WHERE forecast_date = (SELECT d - 7 FROM ship_day) AND qty_predicted > 0) AS skus_at_risk,
      (SELECT round(sum(estimated_cost) / 0.33, 2) FROM recs WHERE urgency IN ('URGENT', 'WARNING')) AS revenue_at_risk,
      (SELECT {WMAPE_SQL} FROM scored WHERE forecast_date >= (SELECT d - 21 FROM ship_day)) AS forecast_accuracy_percent,
      (SELECT count(*) FROM open_pos WHERE status <> 'Delivered') AS total_open_pos,
      (SELECT count(*) FROM open_pos WHERE status <> 'Delivered' AND expected_date < (SELECT d - 7 FROM ship_day)) AS overdue_pos,
      (SELECT round(sum(least(total_demand, warehouse_stock)) / sum(total_demand) * 100, 4) FROM recs) AS warehouse_sufficiency_pct,
      (SELECT count(*) FROM alert_log WHERE resolved = 0) AS active_alerts_count,
      (SELECT count(*) FROM alert_log WHERE resolved = 0 AND severity = 'CRITICAL') AS critical_alerts_count"""


def dashboard(r):
    r = r.sharing("forecast", "open_pos")
    return reports.dashboard(
        r.daily_qty(since=r.forecast_cut), r.forecast(), recommendations(r), r.open_pos(), r.alert_log(),
        newest=r.ship_as_of, as_of=F.date_sub(r.ship_as_of, 7),
    )


@query("D31_dashboard_kpis", DASHBOARD_SQL)
def _(r):
    return dashboard(r)


@query("D31_dashboard_by_month", DASHBOARD_SQL)
def _(r):
    """The same figures, sales and both forecasts taken from the fact stored by month."""
    return dashboard(r.by_month())


WAREHOUSE_SQL = f"""{LATEST_WH_SQL}, {DEMAND_TOTAL_SQL},
    w1 AS (SELECT ingredient, total_qty_needed, coalesce(warehouse_stock, 0.0) AS warehouse_stock,
      round(greatest(total_qty_needed - coalesce(warehouse_stock, 0.0), 0.0), 2) AS net_requirement FROM need LEFT JOIN wh USING (ingredient)),
    plan AS (SELECT *, CASE WHEN net_requirement > 0 THEN 'RED' WHEN total_qty_needed > 0
      AND (warehouse_stock - total_qty_needed) / total_qty_needed < 0.1 THEN 'YELLOW' ELSE 'GREEN' END AS status FROM w1)"""


@query("D32_status_counts", f"WITH {WAREHOUSE_SQL} SELECT status, count(*) AS n FROM plan GROUP BY status")
def _(r):
    return supply.status_counts(supply.warehouse_plan(fc.demand_total(r.demand()), r.kitchen_stock()))


@query(
    "D32_vendor_subtotals",
    f"""WITH {PROCUREMENT_SQL} SELECT vendor_name, count(*) AS lines, round(sum(estimated_cost), 2) AS vendor_total,
      bool_or(urgency = 'URGENT') AS has_urgent FROM recs GROUP BY vendor_name""",
)
def _(r):
    return procurement.vendor_groups(recommendations(r))


@query(
    "D33_share_of_total",
    f"""WITH {HORIZON_SQL} SELECT sku, outlet, total_predicted,
      round(total_predicted / (SELECT sum(total_predicted) FROM horizon) * 100, 2) AS percentage FROM horizon""",
)
def _(r):
    return sales.share_of_total(supply.horizon_total(r.forecast(), F.date_sub(r.ship_as_of, 20), 7), "total_predicted")


@query(
    "D34_recipe_demand_total",
    "SELECT ingredient, unit, round(sum(qty_per_unit), 4) AS total_qty_needed FROM recipe_master GROUP BY ingredient, unit",
)
def _(r):
    return recipes.demand_per_ingredient(r.recipe_master())


@query(
    "D35_recipe_explosion",
    """WITH f AS (SELECT CAST((SELECT d FROM ship_day) + CAST(h AS INTEGER) AS DATE) AS forecast_date, sku, outlet, round(a, 2) AS units
        FROM (SELECT sku, outlet, avg(qty_sold) AS a FROM (SELECT sku, outlet, qty_sold, row_number() OVER (
          PARTITION BY sku, outlet ORDER BY date DESC) AS rn FROM sales_mid WHERE date >= (SELECT d - 365 FROM ship_day))
          WHERE rn <= 14 GROUP BY sku, outlet), range(1, 8) r(h))
    SELECT forecast_date, ingredient, unit, round(sum(units * qty_per_unit * 0.9), 2) AS total_qty_needed
    FROM f JOIN recipe_master ON sku = dish_name GROUP BY 1, 2, 3""",
)
def _(r):
    dishes = fc.moving_average(r.history("mid"), r.ship_as_of, ["sku", "outlet"], horizon=7)
    units = dishes.select("forecast_date", F.col("sku").alias("dish_name"), F.col("qty_predicted").alias("units"))
    return recipes.explode_recipes(units, r.recipe_master(), F.lit(0.9))


COUNTED = ["orders", "lineitem", "part", "supplier", "customer", "events"]


@query("D36_table_row_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in COUNTED))
def _(r):
    return sales.row_counts({t: r.t(t) for t in COUNTED})
