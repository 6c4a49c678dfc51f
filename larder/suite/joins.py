"""C-queries: joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import accuracy, joins, purchasing, recipes, sales, stock
from larder.operators.forecast import demand_total
from larder.operators.skew import hot_keys
from larder.plans import supply, variance
from larder.suite.registry import query


@query(
    "C1_order_item_join",
    """SELECT order_id, item_name, option_names, quantity, store_name, brand_name, city, order_date
    FROM pos_order_items JOIN pos_orders ON order_id = id""",
)
def _(r):
    orders = r.pos_orders().select("id", "store_name", "brand_name", "city", "order_date")
    return sales.order_item_join(r.pos_order_items().drop("total_price"), orders).drop("id")


@query(
    "C2_alias_join",
    """SELECT item_name, option_names, pos_option, recipe_name, multiplier, sum(quantity) AS quantity
    FROM pos_order_items JOIN item_alias ON pos_name = item_name AND (pos_option = option_names OR pos_option IS NULL)
    GROUP BY ALL""",
)
def _(r):
    sold = r.pos_order_items().groupBy("item_name", "option_names").agg(F.sum("quantity").alias("quantity"))
    return recipes.alias_join(sold, r.item_alias()).select(
        "item_name", "option_names", "pos_option", "recipe_name", "multiplier", "quantity"
    )


@query(
    "C3_recipe_join",
    """SELECT pos_name, pos_option, recipe_name, ingredient, multiplier * qty_per_unit AS qty, unit
    FROM item_alias JOIN recipe_master ON recipe_name = dish_name""",
)
def _(r):
    return recipes.recipe_join(r.item_alias(), r.recipe_master()).select(
        "pos_name", "pos_option", "recipe_name", "ingredient",
        (F.col("multiplier") * F.col("qty_per_unit")).alias("qty"), "unit",
    )


@query(
    "C4_catalog_resolve",
    """SELECT dish_name, ingredient, coalesce(sku_name, name, ingredient) AS ingredient_name
    FROM recipe_master LEFT JOIN dim_sku s ON lower(s.sku_code) = lower(ingredient)
      LEFT JOIN dim_ingredients i ON lower(i.sku) = lower(ingredient)""",
)
def _(r):
    return recipes.resolve_names(r.recipe_master(), "ingredient", r.dim_sku(), r.dim_ingredients()).select(
        "dish_name", "ingredient", "ingredient_name"
    )


EXPECTED_SQL = """code_names AS (SELECT lower(sku_code) AS code, sku_name AS name, 1 AS source FROM dim_sku
    UNION ALL SELECT lower(sku), name, 2 FROM dim_ingredients),
  catalog_names AS (SELECT code, arg_min(name, source) AS name FROM code_names GROUP BY code),
  dish_units AS (SELECT order_date AS day, lower(trim(store_name)) AS place, item_name, option_names, sum(quantity) AS units, count(*) AS lines
    FROM pos_orders JOIN pos_order_items ON id = order_id WHERE order_date > (SELECT d - 7 FROM order_day) GROUP BY ALL),
  recipe_totals AS (SELECT day, place, recipe_name, sum(units * multiplier) AS portions, sum(lines * coalesce(additive_offset, 0)) AS extra
    FROM dish_units JOIN item_alias ON item_name = pos_name WHERE coalesce(pos_option = option_names, pos_option IS NULL) GROUP BY ALL),
  ingredient_use AS (SELECT day, place, lower(trim(coalesce(name, ingredient))) AS used, unit, portions * qty_per_unit + extra AS qty
    FROM recipe_totals JOIN recipe_master ON recipe_name = dish_name LEFT JOIN catalog_names ON code = lower(ingredient)),
  expected AS (SELECT day AS date, place AS outlet, used AS ingredient, max(unit) AS unit, round(sum(qty), 8) AS expected_qty
    FROM ingredient_use GROUP BY ALL),
  actual AS (SELECT date, lower(trim(outlet)) AS outlet, lower(trim(sku)) AS ingredient, sum(qty_sold) AS actual_qty
    FROM actual_usage WHERE date > (SELECT d - 7 FROM order_day) GROUP BY 1, 2, 3)"""


@query(
    "C5_expected_actual_full_outer",
    f"WITH {EXPECTED_SQL} SELECT date, outlet, ingredient, expected_qty, actual_qty FROM expected FULL JOIN actual USING (date, outlet, ingredient)",
)
def _(r):
    return variance.expected_and_actual(*variance.usage_of(r)).select(
        "date", "outlet", "ingredient", "expected_qty", "actual_qty"
    )


LATEST_WH_SQL = """wh AS (SELECT ingredient, sum(qty_available) AS warehouse_stock FROM (
    SELECT *, rank() OVER (PARTITION BY location, ingredient ORDER BY snapshot_date DESC) AS rk FROM kitchen_stock
    WHERE contains(location, ' wh')) WHERE rk = 1 GROUP BY ingredient)"""
DEMAND_TOTAL_SQL = "need AS (SELECT ingredient, round(sum(total_qty_needed), 2) AS total_qty_needed FROM demand GROUP BY ingredient)"


@query(
    "C6_demand_left_stock",
    f"""WITH {LATEST_WH_SQL}, {DEMAND_TOTAL_SQL}
    SELECT ingredient, total_qty_needed, coalesce(warehouse_stock, 0.0) AS warehouse_stock FROM need LEFT JOIN wh USING (ingredient)""",
)
def _(r):
    return joins.left_or_zero(
        demand_total(r.demand()), stock.warehouse_stock(r.kitchen_stock()), "ingredient", ["warehouse_stock"]
    )


@query(
    "C7_vendor_left",
    """SELECT k.ingredient, coalesce(vendor_name, 'Unknown Vendor') AS vendor_name, CAST(coalesce(lead_time_days, 7) AS INTEGER) AS lead_time_days,
      coalesce(moq, 1.0) AS moq, coalesce(price, 0.0) AS price
    FROM (SELECT DISTINCT ingredient FROM kitchen_stock) k
      LEFT JOIN (SELECT * FROM vendor_master WHERE moq > 5) v ON v.ingredient = k.ingredient""",
)
def _(r):
    known = r.vendor_master().where(F.col("moq") > 5)
    return joins.vendor_left(r.kitchen_stock().select("ingredient").distinct(), known)


@query(
    "C7_vendor_left_all",
    """SELECT k.ingredient, coalesce(vendor_name, 'Unknown Vendor') AS vendor_name, CAST(coalesce(lead_time_days, 7) AS INTEGER) AS lead_time_days,
      coalesce(moq, 1.0) AS moq, coalesce(price, 0.0) AS price
    FROM (SELECT DISTINCT ingredient FROM kitchen_stock) k LEFT JOIN vendor_master v ON v.ingredient = k.ingredient""",
)
def _(r):
    return joins.vendor_left(r.kitchen_stock().select("ingredient").distinct(), r.vendor_master())


@query(
    "C8_tracked_semi",
    "SELECT sku_code, date, outlet, qty_sold FROM sales_fine WHERE sku_code IN (SELECT code FROM tracker) AND date >= (SELECT d - 30 FROM ship_day)",
)
def _(r):
    recent = r.daily_sales("fine", since=F.date_sub(r.ship_as_of, 30))
    hot = hot_keys(r.t("lineitem", "l_partkey").select(F.col("l_partkey").cast("string").alias("sku_code")), ["sku_code"])
    return joins.tracked_only(recent, "sku_code", r.tracker(), hot).select("sku_code", "date", "outlet", "qty_sold")


@query(
    "C9_not_exists_anti",
    """SELECT dish_name, ingredient FROM recipe_master rm
    WHERE NOT EXISTS (SELECT 1 FROM item_alias am WHERE am.recipe_name = rm.dish_name)""",
)
def _(r):
    return recipes.without_alias(r.recipe_master(), r.item_alias()).select("dish_name", "ingredient")


@query(
    "C10_tuple_in_latest",
    """SELECT kitchen, ingredient, snapshot_date, qty_available FROM kitchen_stock
    WHERE (kitchen, ingredient, snapshot_date) IN (
      SELECT (kitchen, ingredient, max(snapshot_date)) FROM kitchen_stock GROUP BY kitchen, ingredient)""",
)
def _(r):
    return stock.latest_ties(r.kitchen_stock(), ["kitchen", "ingredient"]).select(
        "kitchen", "ingredient", "snapshot_date", "qty_available"
    )


@query(
    "C11_forecast_actual_join",
    """SELECT f.sku, f.outlet, forecast_date, qty_predicted, qty_sold, round(abs(qty_predicted - qty_sold), 2) AS abs_err
    FROM forecast f JOIN sales_coarse s ON f.sku = s.sku AND f.outlet = s.outlet AND f.forecast_date = s.date""",
)
def _(r):
    pairs = accuracy.scored(r.forecast(), r.daily_qty(since=r.forecast_cut))
    return pairs.select(
        "sku", "outlet", "forecast_date", "qty_predicted", "qty_sold", F.round("abs_err", 2).alias("abs_err")
    )


@query(
    "C12_active_pair_join",
    """SELECT kitchen, ingredient, snapshot_date, qty_available FROM (SELECT *, row_number() OVER (
        PARTITION BY kitchen, ingredient ORDER BY snapshot_date DESC) AS rn FROM kitchen_stock)
    WHERE rn = 1 AND (lower(kitchen), ingredient) IN (SELECT (lower(outlet), sku_code) FROM sales_fine
      WHERE date >= (SELECT d - 14 FROM ship_day))""",
)
def _(r):
    sold = r.daily_qty("fine", since=F.date_sub(r.ship_as_of, 14))
    newest = stock.latest_snapshot(r.kitchen_stock(), ["kitchen", "ingredient"])
    return joins.active_pairs(newest, sold).select("kitchen", "ingredient", "snapshot_date", "qty_available")


HORIZON_SQL = """horizon AS (SELECT sku, outlet, round(sum(qty_predicted), 2) AS total_predicted FROM forecast
    WHERE forecast_date >= (SELECT d - 20 FROM ship_day) AND forecast_date <= (SELECT d - 14 FROM ship_day) GROUP BY sku, outlet)"""


@query(
    "C13_dim_preserving_left",
    f"""WITH {HORIZON_SQL}, dims AS (SELECT sku_code, sku_name FROM dim_sku UNION ALL SELECT sku || '-NEW', name FROM dim_ingredients)
    SELECT sku_code, sku_name AS sku, coalesce(outlet, 'Network-Wide') AS outlet, coalesce(total_predicted, 0.0) AS total_predicted
    FROM dims LEFT JOIN horizon h ON sku_code = h.sku ORDER BY total_predicted DESC, sku_code, outlet""",
)
def _(r):
    new = r.dim_ingredients().select(F.concat("sku", F.lit("-NEW")).alias("sku_code"), F.col("name").alias("sku_name"))
    dims = r.dim_sku().unionByName(new)
    return joins.with_network_label(dims, supply.horizon_total(r.forecast(), F.date_sub(r.ship_as_of, 20), 7))


@query(
    "C14_po_grn_inner_multi",
    """SELECT grn_number, po_number, ingredient, vendor, qty_ordered, qty_received, received_date, expected_date
    FROM grn_log JOIN open_pos USING (po_number, ingredient)""",
)
def _(r):
    return purchasing.order_receipts(r.open_pos(), r.grn_log()).drop("status")


@query(
    "C15_po_grn_left_filtered",
    """SELECT p.po_number, vendor, count(*) AS pairs FROM open_pos p LEFT JOIN grn_log g ON p.po_number = g.po_number
    WHERE g.grn_number <> '' GROUP BY p.po_number, vendor""",
)
def _(r):
    return purchasing.pairs_per_order(r.open_pos(), r.grn_log())


@query(
    "C16_calendar_cross",
    """SELECT sku, outlet, CAST(g AS DATE) AS date FROM (SELECT DISTINCT sku, outlet FROM hist_coarse),
      (SELECT unnest(generate_series(CAST((SELECT d - 30 FROM ship_day) AS TIMESTAMP), CAST((SELECT d FROM ship_day) AS TIMESTAMP), INTERVAL 1 DAY)) AS g)""",
)
def _(r):
    combos = r.history().select("sku", "outlet").distinct()
    return joins.on_calendar(combos, F.date_sub(r.ship_as_of, 30), r.ship_as_of)


SUPPLY_SQL = """coming AS (SELECT ingredient AS item, outlet AS place, round(sum(total_qty_needed), 2) AS qty FROM demand
      WHERE forecast_date < (SELECT d + 4 FROM ship_day) GROUP BY ALL),
    newest AS (SELECT kitchen AS at_kitchen, ingredient AS item, max(snapshot_date) AS day FROM kitchen_stock GROUP BY ALL),
    on_hand AS (SELECT item, sum(qty_available) AS held FROM kitchen_stock
      JOIN newest ON kitchen = at_kitchen AND ingredient = item AND snapshot_date = day GROUP BY item),
    plan AS (SELECT sku_code, sku_name AS sku, place AS kitchen, qty AS forecast_3day,
      CASE WHEN place = 'ALL' THEN coalesce(held, 0.0) ELSE 0.0 END AS stock_qty,
      coalesce(drr * lead_time_days, 0.0) AS safety_stock_qty
      FROM dim_part JOIN coming ON coming.item = sku_code LEFT JOIN on_hand ON on_hand.item = sku_code
      LEFT JOIN tracker ON lower(tracker.ingredient) = lower(sku_name))"""


@query("C17_multi_cte_plan", f"WITH {SUPPLY_SQL} SELECT * FROM plan")
def _(r):
    return supply.supply_base(r.demand(), r.dim_part(), r.kitchen_stock(), r.tracker(), r.ship_as_of)


@query(
    "C18_update_from_values",
    """SELECT code, ingredient, lead_time_days, coalesce(v.q, drr) AS drr FROM tracker LEFT JOIN (
      SELECT sku_code, round(sum(qty_sold) / 30.0, 4) AS q FROM sales_fine WHERE date >= (SELECT d - 30 FROM ship_day)
      GROUP BY sku_code) v ON code = sku_code""",
)
def _(r):
    recent = r.daily_qty("fine", since=F.date_sub(r.ship_as_of, 30))
    rates = recent.groupBy(F.col("sku").alias("code")).agg(F.round(F.sum("qty_sold") / 30.0, 4).alias("drr"))
    return joins.update_from(r.tracker(), rates, "code", ["drr"])


@query(
    "C19_outlet_city_lookup",
    """SELECT outlet, mapped_city, sum(qty) AS qty FROM (SELECT outlet, qty_sold AS qty FROM sales_fine
      UNION ALL SELECT 'Network-Wide', 1.0) LEFT JOIN (SELECT outlet AS o, city AS mapped_city FROM dim_outlets) ON outlet = o
    GROUP BY outlet, mapped_city""",
)
def _(r):
    per_outlet = r.daily_qty("fine").groupBy("outlet").agg(F.sum("qty_sold").alias("qty"))
    network = r.t("region", "r_name").agg(F.lit("Network-Wide").alias("outlet"), F.lit(1.0).alias("qty"))
    return joins.with_city(per_outlet.unionByName(network), r.dim_outlets())
