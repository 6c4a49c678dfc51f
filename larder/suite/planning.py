"""P-queries: business plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions.numbers import moq_round_up
from larder.operators import forecast as fc, purchasing, recipes
from larder.operators.skew import hot_keys
from larder.plans import alerts, nightly, procurement, reports, supply, variance
from larder.session import scratch_path
from larder.suite.aggregates import PROCUREMENT_SQL, WAREHOUSE_SQL, recommendations
from larder.suite.joins import EXPECTED_SQL, SUPPLY_SQL
from larder.suite.registry import query

VARIANCE_SQL = f"""{EXPECTED_SQL},
  both_ AS (SELECT date, outlet, ingredient, coalesce(expected_qty, 0.0) AS expected_qty, coalesce(actual_qty, 0.0) AS actual_qty,
    coalesce(unit, 'units') AS unit FROM expected FULL JOIN actual USING (date, outlet, ingredient)),
  variance AS (SELECT *, round(actual_qty - expected_qty, 8) AS variance_qty,
    round(CASE WHEN expected_qty > 0 THEN round(actual_qty - expected_qty, 8) / expected_qty * 100 ELSE 100.0 END, 4) AS variance_pct
    FROM both_ WHERE expected_qty > 0 OR actual_qty > 0)"""


def variance_rows(r):
    return variance.report(*variance.usage_of(r))


@query("P1_variance_report", f"WITH {VARIANCE_SQL} SELECT * FROM variance")
def _(r):
    return variance_rows(r)


@query(
    "P2_variance_flag",
    f"""WITH {VARIANCE_SQL},
      settings AS (SELECT DISTINCT lower(p_type) || ' item' AS ing, CAST(10 AS DOUBLE) AS g, CAST(40 AS DOUBLE) AS y FROM part WHERE p_type = 'ECONOMY'),
      mapped AS (SELECT lower(ingredient) AS ingredient FROM recipe_master WHERE ingredient <> 'PROMO' UNION
        SELECT lower(sku_name) FROM dim_sku UNION SELECT lower(name) FROM dim_ingredients WHERE sku <> 'PROMO'),
      t AS (SELECT date, outlet, ingredient, unit, CAST(round(CAST(sum(expected_qty) AS DECIMAL(28, 8)), 2) AS DOUBLE) AS expected_qty, CAST(round(CAST(sum(actual_qty) AS DECIMAL(28, 8)), 2) AS DOUBLE) AS actual_qty,
        CAST(round(CAST(sum(variance_qty) AS DECIMAL(28, 8)), 2) AS DOUBLE) AS variance_qty FROM variance GROUP BY 1, 2, 3, 4),
      p AS (SELECT t.*, CASE WHEN expected_qty > 0 THEN variance_qty / expected_qty * 100 WHEN actual_qty > 0 THEN 100.0 ELSE 0.0 END AS pct,
        expected_qty = 0 AND actual_qty > 0 AND ingredient NOT IN (SELECT ingredient FROM mapped) AS unmapped,
        coalesce(g, 5.0) AS g, coalesce(y, 30.0) AS y FROM t LEFT JOIN settings ON ing = ingredient)
    SELECT date, outlet, ingredient, unit, expected_qty, actual_qty, variance_qty, CASE WHEN NOT unmapped THEN round(pct, 2) END AS variance_pct,
      CASE WHEN unmapped THEN 'unmapped' WHEN abs(pct) <= g THEN 'green' WHEN abs(pct) <= y THEN 'yellow' ELSE 'red' END AS flag FROM p""",
)
def _(r):
    own = r.t("part", "p_type").where(F.col("p_type") == "ECONOMY").select(
        F.concat("p_type", F.lit(" Item")).alias("ingredient"), F.lit(10.0).alias("green_threshold"), F.lit(40.0).alias("yellow_threshold")
    ).distinct()
    fallback = r.t("part", "p_type").agg(
        F.lit("*").alias("ingredient"), F.lit(5.0).alias("green_threshold"), F.lit(30.0).alias("yellow_threshold")
    )
    known = recipes.mapped_ingredients(
        r.recipe_master().where(F.col("ingredient") != "PROMO"), r.dim_sku(), r.dim_ingredients()
    )
    return variance.flagged(variance_rows(r), own.unionByName(fallback), known)


@query(
    "P3_mapped_ingredients",
    """SELECT lower(ingredient) AS ingredient FROM recipe_master UNION SELECT lower(sku_name) FROM dim_sku
      WHERE lower(sku_code) IN (SELECT lower(ingredient) FROM recipe_master) UNION SELECT lower(name) FROM dim_ingredients
      WHERE lower(sku) IN (SELECT lower(ingredient) FROM recipe_master)""",
)
def _(r):
    return recipes.mapped_ingredients(r.recipe_master(), r.dim_sku(), r.dim_ingredients())


@query("P4_warehouse_plan", f"WITH {WAREHOUSE_SQL} SELECT * FROM plan")
def _(r):
    return supply.warehouse_plan(fc.demand_total(r.demand()), r.kitchen_stock())


@query(
    "P5_warehouse_api_view",
    """WITH need AS (SELECT lower(trim(ingredient)) AS ingredient, unit, round(sum(qty_per_unit), 4) AS total_qty_needed FROM recipe_master GROUP BY 1, 2),
      held AS (SELECT lower(trim(ingredient)) AS ingredient, sum(qty_available) AS warehouse_stock FROM (SELECT *, rank() OVER (
        PARTITION BY location, ingredient ORDER BY snapshot_date DESC) AS rk FROM kitchen_stock) WHERE rk = 1 GROUP BY 1),
      j AS (SELECT n.ingredient, unit, total_qty_needed, coalesce(warehouse_stock, 0.0) AS warehouse_stock,
        round(total_qty_needed - coalesce(warehouse_stock, 0.0), 2) AS net_requirement FROM need n LEFT JOIN held USING (ingredient))
    SELECT *, CASE WHEN net_requirement > 0 THEN 'RED' WHEN total_qty_needed > 0
      AND (warehouse_stock - total_qty_needed) / greatest(total_qty_needed, 1.0) < 0.1 THEN 'YELLOW' ELSE 'GREEN' END AS status FROM j""",
)
def _(r):
    return supply.warehouse_view(recipes.demand_per_ingredient(r.recipe_master()), r.kitchen_stock())


@query("P6_procurement_plan", f"WITH {PROCUREMENT_SQL} SELECT * FROM recs")
def _(r):
    return recommendations(r)


@query("P6_plan_by_month", f"WITH {PROCUREMENT_SQL} SELECT * FROM recs")
def _(r):
    """Demand from the year's months of the stored fact."""
    return recommendations(r.by_month())


FED_SQL = "fed_stock AS (SELECT * FROM kitchen_stock WHERE qty_available >= 0)"


def feeds(r):
    """The roles as feeds deliver them: text, kilograms, stray blanks, and an older version of every third row."""

    def delivered(df, wrong, **changes):
        # Both versions come from one pass over the role.
        newest = df.withColumns(changes)
        picked = F.abs(F.hash(*[F.lit("7") if c == wrong else F.col(c) for c in df.columns])) % 3 == 0
        versions = F.when(picked, F.array(F.lit(2), F.lit(1))).otherwise(F.array(F.lit(2)))
        return newest.withColumn("version", F.explode(versions)).withColumn(
            wrong, F.when(F.col("version") == 1, F.lit("7")).otherwise(F.col(wrong))
        )

    def as_text(name):
        return F.concat(F.lit(" "), F.col(name).cast("string"), F.lit("  "))

    stock = r.kitchen_stock().withColumn("snapshot_time", F.concat(F.col("snapshot_date").cast("string"), F.lit(" 21:30:00"))).drop("snapshot_date")
    orders = r.pos_orders().select(
        F.col("id").alias("order_id").cast("string"), F.date_format("created_at_ist", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
        F.lit("Delivered").alias("status"), "store_name",
    )
    items = r.t("lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_quantity").join(
        r.t("part", "p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")
    ).select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"),
        F.col("l_orderkey").cast("string").alias("order_id"), F.upper("p_name").alias("item_name"),
        F.col("l_returnflag").alias("option_names"), F.col("l_quantity").alias("quantity"),
    )
    return nightly.Feeds(
        orders=delivered(orders, "store_name"),
        items=delivered(items, "quantity", quantity=as_text("quantity")),
        stock=delivered(
            stock, "qty_available", unit=F.lit("Kg."), qty_available=(F.col("qty_available") / 1000).cast("string")
        ),
        pos=delivered(r.open_pos(), "vendor", qty_ordered=as_text("qty_ordered"), expected_date=as_text("expected_date")),
        receipts=delivered(r.grn_log(), "ingredient", qty_received=as_text("qty_received"), received_date=as_text("received_date")),
        vendors=delivered(
            r.vendor_master(), "price", lead_time_days=as_text("lead_time_days"), moq=as_text("moq"), price=as_text("price")
        ),
    )


@query("P6_plan_from_feeds", f"WITH {FED_SQL}, {PROCUREMENT_SQL.replace('kitchen_stock', 'fed_stock')} SELECT * FROM recs")
def _(r):
    """Stock, orders and vendors cleaned, converted and stored, then planned from what was stored."""
    folder = scratch_path(r.spark, "loaded")
    cleaned = nightly.clean_feeds(feeds(r))
    stock, pos, vendors = (nightly.stored(cleaned[name], folder, name) for name in ("stock", "pos", "vendors"))
    return procurement.plan(r.demand(), stock, pos, vendors, r.ship_as_of)


@query(
    "P7_moq_round_up",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CASE WHEN l_quantity - 5 <= 0 THEN 0.0
      ELSE ceil((l_quantity - 5) / CASE WHEN l_suppkey % 7 > 0 THEN l_suppkey % 7 ELSE 1 END) * CASE WHEN l_suppkey % 7 > 0 THEN l_suppkey % 7 ELSE 1 END END AS order_qty
    FROM lineitem""",
)
def _(r):
    lines = r.t("lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    qty = moq_round_up(F.col("l_quantity") - 5, (F.col("l_suppkey") % 7).cast("double"))
    return lines.withColumn("order_qty", qty).drop("l_suppkey")


@query(
    "P8_procurement_listing",
    f"WITH {PROCUREMENT_SQL} SELECT ingredient, vendor_name, urgency, recommended_qty FROM recs WHERE urgency = 'URGENT' AND lower(vendor_name) = 'vendor brand#1'",
)
def _(r):
    listed = procurement.listing(recommendations(r), vendor="VENDOR brand#1", urgency="urgent")
    return listed.select("ingredient", "vendor_name", "urgency", "recommended_qty")


@query("P8_procurement_listing_all", f"WITH {PROCUREMENT_SQL} SELECT ingredient, vendor_name, urgency, recommended_qty FROM recs")
def _(r):
    """Every recommendation, without a filter."""
    return procurement.listing(recommendations(r)).select("ingredient", "vendor_name", "urgency", "recommended_qty")


@query(
    "P9_supply_plan",
    f"""WITH {SUPPLY_SQL}, s AS (SELECT *, round(greatest(forecast_3day + safety_stock_qty - stock_qty, 0.0), 2) AS replenishment_needed FROM plan)
    SELECT *, CASE WHEN replenishment_needed <= 0 THEN 'GREEN' WHEN forecast_3day > 0 AND replenishment_needed > 0.5 * forecast_3day
      THEN 'RED' ELSE 'YELLOW' END AS status FROM s""",
)
def _(r):
    return supply.supply_plan(
        supply.supply_base(r.demand(), r.dim_part(), r.kitchen_stock(), r.tracker(), r.ship_as_of)
    )


@query(
    "P10_tracker_refresh",
    """WITH rate AS (SELECT sku_code AS code, round(sum(qty_sold) / 30.0, 4) AS drr FROM sales_fine
        WHERE date >= (SELECT d - 30 FROM ship_day) GROUP BY sku_code),
      held AS (SELECT ingredient AS code, sum(qty_available) AS wh_sih FROM (SELECT *, rank() OVER (
        PARTITION BY location, ingredient ORDER BY snapshot_date DESC) AS rk FROM kitchen_stock
        WHERE lower(location) LIKE '%warehouse%' OR lower(location) LIKE '% wh %' OR lower(location) LIKE '%_wh%') WHERE rk = 1 GROUP BY 1),
      opn AS (SELECT ingredient AS code, sum(qty_ordered) AS open_po FROM open_pos WHERE status = 'open' GROUP BY 1),
      j AS (SELECT t.code, ingredient, CAST(t.lead_time_days AS DOUBLE) AS lead_time_days, coalesce(rate.drr, 0.0) AS drr,
        coalesce(wh_sih, 0.0) AS wh_sih, coalesce(open_po, 0.0) AS open_po
        FROM tracker t LEFT JOIN rate USING (code) LEFT JOIN held USING (code) LEFT JOIN opn USING (code)),
      k AS (SELECT *, round(greatest(drr * 7 - wh_sih, 0.0) + drr * lead_time_days - open_po, 4) AS raw FROM j)
    SELECT code, ingredient, lead_time_days, drr, wh_sih, open_po, CASE WHEN raw <= 0 THEN 0.0 ELSE ceil(raw) END AS neworder FROM k""",
)
def _(r):
    rates = procurement.run_rate(r.daily_qty("fine", since=F.date_sub(r.ship_as_of, 30)), r.tracker())
    return procurement.refresh_tracker(r.tracker(), rates, r.kitchen_stock(), r.open_pos())


# -- alerts ------------------------------------------------------------------

STOCKOUT_SQL = """a1 AS (SELECT 'KITCHEN_STOCKOUT' AS alert_type, 'CRITICAL' AS severity,
    'CRITICAL: ' || kitchen || ' has run out of ' || sku_name AS message, sku_name AS sku, kitchen AS outlet, sku_name AS ingredient
  FROM (SELECT *, row_number() OVER (PARTITION BY kitchen, ingredient ORDER BY snapshot_date DESC) AS rn FROM kitchen_stock) s
    JOIN dim_part ON ingredient = sku_code WHERE rn = 1 AND qty_available <= 0 AND (lower(kitchen), ingredient) IN (
      SELECT (lower(outlet), sku_code) FROM sales_fine WHERE date >= (SELECT d - 14 FROM ship_day)))"""
LOW_SQL = """held2 AS (SELECT ingredient, sum(qty_available) AS stock FROM (SELECT *, rank() OVER (PARTITION BY location, ingredient ORDER BY snapshot_date DESC) AS rk
    FROM kitchen_stock WHERE lower(location) LIKE '%warehouse%' OR lower(location) LIKE '%_wh%') WHERE rk = 1 GROUP BY ingredient),
  need3 AS (SELECT ingredient, round(sum(total_qty_needed), 2) AS need FROM demand WHERE forecast_date <= (SELECT d + 3 FROM ship_day) GROUP BY ingredient),
  a2 AS (SELECT 'WH_CRITICAL_LOW' AS alert_type, 'CRITICAL' AS severity, 'CRITICAL: ' || sku_name || ' in the warehouse: '
    || CAST(CAST(round(stock) AS BIGINT) AS VARCHAR) || ' held, ' || CAST(CAST(round(need) AS BIGINT) AS VARCHAR) || ' wanted in three days' AS message,
    '' AS sku, '' AS outlet, sku_name AS ingredient FROM need3 JOIN held2 USING (ingredient) JOIN dim_part ON ingredient = sku_code WHERE stock < 0.1 * need)"""
OVERDUE_SQL = """a3 AS (SELECT 'PO_OVERDUE' AS alert_type, 'CRITICAL' AS severity, 'CRITICAL: order ' || po_number || ' is late: ' || ingredient
    || ' was due on ' || CAST(expected_date AS VARCHAR) AS message, '' AS sku, po_number AS outlet, ingredient
  FROM open_pos WHERE expected_date < (SELECT d - 300 FROM ship_day) AND status = 'open')"""
SPIKE_SQL = """base AS (SELECT sku, outlet, avg(qty_sold) AS b FROM sales_coarse WHERE date >= (SELECT d - 28 FROM ship_day) GROUP BY sku, outlet),
  ahead AS (SELECT sku, outlet, avg(qty_predicted) AS f FROM forecast WHERE forecast_date >= (SELECT d - 20 FROM ship_day)
    AND forecast_date <= (SELECT d - 13 FROM ship_day) GROUP BY sku, outlet),
  a5 AS (SELECT 'DEMAND_SPIKE' AS alert_type, 'WARNING' AS severity, 'WARNING: ' || sku || ' at ' || outlet || ': forecast '
    || CAST(CAST(round((f / b - 1) * 100) AS BIGINT) AS VARCHAR) || '% over the recent mean' AS message, sku, outlet, '' AS ingredient
  FROM base JOIN ahead USING (sku, outlet) WHERE f > 1.5 * b)"""
NO_RECIPE_SQL = """a6 AS (SELECT 'NO_RECIPE' AS alert_type, 'WARNING' AS severity, 'WARNING: ' || item_name ||
    ' sells without a recipe; forecast and variance leave its ingredients out' AS message,
    item_name AS sku, '' AS outlet, '' AS ingredient FROM (SELECT DISTINCT item_name FROM pos_order_items JOIN pos_orders ON order_id = id
      WHERE order_date >= (SELECT d - 7 FROM order_day)) WHERE item_name NOT IN (SELECT pos_name FROM item_alias))"""
LEAD_SQL = """a9 AS (SELECT 'LEAD_TIME_ALERT' AS alert_type, 'INFO' AS severity, 'INFO: order ' || ingredient || ' today: ' || vendor_name
    || ' delivers in ' || CAST(lead_time_days AS VARCHAR) || ' days' AS message, '' AS sku, vendor_name AS outlet, ingredient
  FROM recs WHERE urgency = 'URGENT')"""


def stockout(r):
    sold = r.daily_qty("fine", since=F.date_sub(r.ship_as_of, 14))
    return alerts.kitchen_stockout(r.kitchen_stock(), sold, r.dim_part())


def low(r):
    return alerts.warehouse_low(r.demand(), r.kitchen_stock(), r.dim_part(), r.ship_as_of)


def overdue(r):
    return alerts.po_overdue(r.open_pos(), F.date_sub(r.ship_as_of, 300))


def spike(r):
    coming = r.forecast().where(F.col("forecast_date").between(F.date_sub(r.ship_as_of, 20), F.date_sub(r.ship_as_of, 13)))
    return alerts.demand_spike(r.daily_qty(since=F.date_sub(r.ship_as_of, 28)), coming)


def no_recipe(r):
    recent = F.col("o_orderdate") >= F.date_sub(r.order_as_of, 7).cast("timestamp_ntz")
    return alerts.no_recipe(r.pos_order_items(recent), r.item_alias())


def lead(r):
    return alerts.lead_time(recommendations(r))


@query("P11_alert_kitchen_stockout", f"WITH {STOCKOUT_SQL} SELECT * FROM a1")
def _(r):
    return stockout(r)


@query("P12_alert_warehouse_low", f"WITH {LOW_SQL} SELECT * FROM a2")
def _(r):
    return low(r)


@query("P13_alert_po_overdue", f"WITH {OVERDUE_SQL} SELECT * FROM a3")
def _(r):
    return overdue(r)


@query("P14_alert_demand_spike", f"WITH {SPIKE_SQL} SELECT * FROM a5")
def _(r):
    return spike(r)


@query("P15_alert_no_recipe", f"WITH {NO_RECIPE_SQL} SELECT * FROM a6")
def _(r):
    return no_recipe(r)


@query("P16_alert_lead_time", f"WITH {PROCUREMENT_SQL}, {LEAD_SQL} SELECT * FROM a9")
def _(r):
    return lead(r)


ALERTS_SQL = f"""WITH {PROCUREMENT_SQL}, {STOCKOUT_SQL}, {LOW_SQL}, {OVERDUE_SQL}, {SPIKE_SQL}, {NO_RECIPE_SQL}, {LEAD_SQL}
    SELECT *, (SELECT d FROM ship_day) AS created_at, 0 AS resolved FROM (
      SELECT * FROM a1 UNION ALL SELECT * FROM a2 UNION ALL SELECT * FROM a3 UNION ALL SELECT * FROM a5
      UNION ALL SELECT * FROM a6 UNION ALL SELECT * FROM a9)"""


def all_alerts(r):
    r = r.sharing("demand", "kitchen_stock", "open_pos")
    rules = [rule(r) for rule in (stockout, low, overdue, spike, no_recipe, lead)]
    return alerts.stamped(alerts.union(rules), r.ship_as_of).drop("alert_id", "resolved_at")


@query("P17_alert_union", ALERTS_SQL)
def _(r):
    return all_alerts(r)


@query("P17_alerts_by_month", ALERTS_SQL)
def _(r):
    """The same alerts, each rule's days read from their months of the stored fact."""
    return all_alerts(r.by_month())


KNOWN_SQL = "SELECT alert_type, sku, outlet, ingredient FROM alert_log WHERE resolved = 0 AND CAST(created_at AS DATE) < (SELECT d - 20 FROM event_day)"


@query(
    "P18_alert_dedup",
    f"""SELECT alert_id, alert_type, sku, outlet, ingredient FROM alert_log WHERE CAST(created_at AS DATE) >= (SELECT d - 5 FROM event_day)
      AND (alert_type, sku, outlet, ingredient) NOT IN (SELECT (alert_type, sku, outlet, ingredient) FROM ({KNOWN_SQL}))""",
)
def _(r):
    log = r.alert_log()
    fresh = log.where(F.to_date("created_at") >= F.date_sub(r.event_as_of, 5))
    known = log.where(F.to_date("created_at") < F.date_sub(r.event_as_of, 20))
    return alerts.suppress_known(fresh, known).select("alert_id", "alert_type", "sku", "outlet", "ingredient")


@query(
    "P18_alert_dedup_all",
    """WITH known AS (SELECT DISTINCT alert_type, sku, outlet, ingredient FROM alert_log WHERE resolved = 0 AND CAST(created_at AS DATE) < (SELECT d - 5 FROM event_day))
    SELECT alert_id, alert_type, sku, outlet, ingredient FROM alert_log WHERE CAST(created_at AS DATE) >= (SELECT d - 5 FROM event_day)
      AND (alert_type, sku, outlet, ingredient) NOT IN (SELECT (alert_type, sku, outlet, ingredient) FROM known)""",
)
def _(r):
    """The last days' alerts against every earlier one."""
    log = r.alert_log()
    fresh = F.to_date("created_at") >= F.date_sub(r.event_as_of, 5)
    new = alerts.suppress_known(log.where(fresh), log.where(~fresh))
    return new.select("alert_id", "alert_type", "sku", "outlet", "ingredient")


@query(
    "P19_alert_listing",
    """SELECT alert_id, alert_type, severity, outlet, created_at FROM alert_log WHERE resolved = 0
    ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'WARNING' THEN 1 ELSE 2 END, created_at DESC, alert_id""",
)
def _(r):
    return alerts.listing(r.alert_log()).select("alert_id", "alert_type", "severity", "outlet", "created_at")


@query(
    "P20_alert_resolve",
    """SELECT alert_id, alert_type, CASE WHEN e.user_id IS NOT NULL THEN 1 ELSE resolved END AS resolved,
      CASE WHEN e.user_id IS NOT NULL THEN e.ts + INTERVAL 1 HOUR END AS resolved_at
    FROM alert_log LEFT JOIN (SELECT event_id, user_id, ts FROM events WHERE value > 10) e ON alert_id = CAST(event_id AS VARCHAR)""",
)
def _(r):
    edits = r.t("events", "event_id", "ts", "value").where(F.col("value") > 10).select(
        F.col("event_id").cast("string").alias("alert_id"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("resolved_at")
    )
    return alerts.resolve(r.alert_log(), edits).select("alert_id", "alert_type", "resolved", "resolved_at")


@query(
    "P21_mark_ordered",
    """SELECT po_number, ingredient, qty_ordered, CASE WHEN status = 'open' AND ingredient IN (
      SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_size > 25) THEN 'ordered' ELSE status END AS status FROM open_pos""",
)
def _(r):
    chosen = r.t("part", "p_partkey", "p_size").where(F.col("p_size") > 25).select(
        F.col("p_partkey").cast("string").alias("ingredient")
    )
    hot = hot_keys(r.t("lineitem", "l_partkey").select(F.col("l_partkey").cast("string").alias("_i")), ["_i"])
    return purchasing.mark_ordered(r.open_pos(), chosen, hot).select("po_number", "ingredient", "qty_ordered", "status")


@query("P22_recent_alerts", "SELECT alert_id, alert_type, severity, created_at FROM alert_log ORDER BY created_at DESC, alert_id LIMIT 10")
def _(r):
    return alerts.recent(r.alert_log()).select("alert_id", "alert_type", "severity", "created_at")


@query(
    "P23_recipe_listing",
    """WITH rc AS (SELECT dish_name, lower(ingredient) || ' ITEM' AS ingredient, qty_per_unit, unit FROM recipe_master)
    SELECT dish_name, ingredient, qty_per_unit AS qty_per_portion, unit, CAST(1.0 AS DOUBLE) AS yield_factor, sku_code, sku_name,
      sku_code IS NOT NULL AS is_tracked FROM rc LEFT JOIN dim_sku ON lower(ingredient) = lower(sku_name)
    ORDER BY dish_name, ingredient, sku_code""",
)
def _(r):
    named = r.recipe_master().withColumn("ingredient", F.concat(F.lower("ingredient"), F.lit(" ITEM")))
    return recipes.listing(named, r.dim_sku())


@query(
    "P24_exact_alias_match",
    """SELECT item_name AS pos_name, CAST(NULL AS VARCHAR) AS pos_option, item_name AS recipe_name, CAST(1.0 AS DOUBLE) AS multiplier,
      'high' AS confidence FROM (SELECT DISTINCT item_name FROM pos_order_items WHERE item_name IN (SELECT p_name FROM part WHERE p_type = 'PROMO'))""",
)
def _(r):
    dishes = r.t("part", "p_name", "p_type").where(F.col("p_type") == "PROMO").select(F.col("p_name").alias("dish_name"))
    return recipes.exact_alias_match(r.pos_order_items(), dishes)


@query(
    "P24_exact_alias_match_all",
    """SELECT item_name AS pos_name, CAST(NULL AS VARCHAR) AS pos_option, item_name AS recipe_name, CAST(1.0 AS DOUBLE) AS multiplier,
      'high' AS confidence FROM (SELECT DISTINCT item_name FROM pos_order_items WHERE item_name IN (SELECT p_name FROM part))""",
)
def _(r):
    """All item names against the names of the whole recipe book."""
    return recipes.exact_alias_match(r.pos_order_items(), r.t("part", "p_name").select(F.col("p_name").alias("dish_name")))


def dims(r):
    feed = r.sales_lines().select(
        "sku_code", F.col("p_name").alias("sku"), F.col("store_name").alias("outlet"), "city", "date", "l_orderkey"
    )
    return reports.build_dimensions(feed, ["date", "l_orderkey"])


@query(
    "P25_dim_build",
    """SELECT 'ingredient' AS kind, sku_code AS code, p_name AS name FROM (SELECT DISTINCT sku_code, p_name FROM sales_lines)
    UNION ALL SELECT 'outlet', store_name, city FROM (SELECT DISTINCT store_name, city FROM sales_lines)
    UNION ALL SELECT 'mapping', store_name, sku_code FROM (SELECT DISTINCT store_name, sku_code FROM sales_lines)""",
)
def _(r):
    d = dims(r)
    return (
        d["dim_ingredients"].select(F.lit("ingredient").alias("kind"), F.col("sku_code").alias("code"), F.col("sku").alias("name"))
        .union(d["dim_outlets"].select(F.lit("outlet"), "outlet", "city"))
        .union(d["mapping"].select(F.lit("mapping"), "outlet", "sku_code"))
    )


@query(
    "P26_late_version_pick",
    """WITH v AS (SELECT user_id, ts AS plan_date, event_id AS version, CAST(ts + INTERVAL 330 MINUTE AS DATE) AS entry_date FROM events)
    SELECT user_id, version, entry_date FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY plan_date DESC, version DESC) AS rn
      FROM v WHERE entry_date < (SELECT d - 3 FROM event_day)) WHERE rn = 1""",
)
def _(r):
    versions = r.t("events", "user_id", "ts", "event_id").toDF("user_id", "plan_date", "version")
    picked = reports.latest_version_before(versions, ["user_id"], F.date_sub(r.event_as_of, 3))
    return picked.select("user_id", "version", "entry_date")


@query(
    "P26_version_loaded_once",
    """SELECT user_id AS version, min(CAST(ts AS DATE)) AS first_date, max(CAST(ts AS DATE)) AS last_date, count(*) AS dates
    FROM events GROUP BY user_id""",
)
def _(r):
    rows = r.t("events", "user_id", "ts").select(F.col("user_id").alias("version"), F.to_date("ts").alias("entry_date"))
    return reports.load_once(rows)


@query(
    "P28_alias_outlet_rename",
    """SELECT alert_id, coalesce(c_name, outlet) AS outlet, CASE WHEN c_name IS NOT NULL THEN replace(message, outlet, c_name) ELSE message END AS message
    FROM alert_log LEFT JOIN (SELECT CAST(c_custkey AS VARCHAR) AS i, c_name FROM customer WHERE c_mktsegment <> 'MACHINERY') ON outlet = i""",
)
def _(r):
    names = r.t("customer", "c_custkey", "c_name", "c_mktsegment").where(F.col("c_mktsegment") != "MACHINERY").select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name")
    )
    return alerts.rename_outlets(r.alert_log(), names, "outlet", "message").select("alert_id", "outlet", "message")
