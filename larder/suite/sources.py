"""A-queries: sources and sinks.

File feeds are first written by Spark from the supplied rows into the shared
scratch folder, so the reader's work grows with the tables.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from larder.session import scratch_path
from larder.sources import facts, files, sinks
from larder.sources.tables import finite_only, read_table
from larder.suite.registry import query


@query(
    "A1_scan_table",
    """SELECT l_orderkey, l_partkey, l_quantity, CASE WHEN l_discount = 0 THEN NULL ELSE l_extendedprice END AS price
    FROM lineitem WHERE l_quantity > 45""",
)
def _(r):
    scan = read_table(
        r.spark, r.folder, "lineitem",
        ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount"], F.col("l_quantity") > 45,
    )
    price = F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.col("l_extendedprice"))
    return finite_only(scan.select("l_orderkey", "l_partkey", "l_quantity", price.alias("price")))


def _write_text(df, label):
    path = scratch_path(df.sparkSession, label)
    df.write.text(path)
    return path


@query(
    "A2_read_csv_bom",
    """SELECT CAST(l_shipdate AS DATE) AS date, p_name AS sku, 'Kitchen ' || CAST(l_suppkey AS VARCHAR) AS outlet, l_quantity AS qty_sold
    FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'A'""",
)
def _(r):
    lines = r.t("lineitem", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", "l_returnflag").join(
        r.t("part", "p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")
    )
    surplus = F.when(F.col("l_returnflag") == "A", F.lit(",surplus")).otherwise(F.lit(""))
    path = scratch_path(r.spark, "csv")
    fields = {
        "planDate": F.date_format("l_shipdate", "dd-MM-yyyy"),
        "ingredientName": F.col("p_name"),
        "kitchenName": F.concat(F.lit("Kitchen "), F.col("l_suppkey").cast("string")),
        "plannedDemand": F.col("l_quantity").cast("string"),
        "remark": F.lit("x"),
    }
    # Three layouts in one folder: a column order, another one, and one with a column more.
    orders = [
        ["planDate", "ingredientName", "kitchenName", "plannedDemand"],
        ["plannedDemand", "planDate", "ingredientName", "kitchenName"],
        ["remark", "ingredientName", "planDate", "kitchenName", "plannedDemand"],
    ]
    for n, names in enumerate(orders):
        # The last column carries an unquoted extra field on some lines: those are malformed.
        cells = [fields[c] if c != names[-1] else F.concat(fields[c], surplus) for c in names]
        marked = [files.BOM + names[0], *names[1:]]
        lines.where(F.col("l_suppkey") % 3 == n).select(*[c.alias(name) for c, name in zip(cells, marked)]).write.mode(
            "append"
        ).option("header", True).option("quote", "\u0000").csv(path)
    return files.read_consumption(r.spark, f"{path}/*.csv")


@query(
    "A3_read_csv_positional",
    """SELECT p_name AS dish_name, p_type AS ingredient, CASE WHEN p_size > 25 THEN CAST(p_size AS DOUBLE) ELSE 0.0 END AS qty_per_unit,
      'g' AS unit FROM part WHERE p_brand <> 'Brand#1'""",
)
def _(r):
    filled = {
        "Item_Name": F.col("p_name"),
        "Code": F.when(F.col("p_brand") == "Brand#1", F.lit("")).otherwise(F.col("p_type")),
        "Ingredient Quantity": F.when(F.col("p_size") > 25, F.col("p_size").cast("string")).otherwise(F.lit("n/a")),
        "Unit": F.lit("g"),
    }
    export = r.t("part", "p_name", "p_type", "p_size", "p_brand").select(
        *[filled.get(n, F.lit("x")).alias(f"h{i}") for i, n in enumerate(files.RECIPE_EXPORT_COLUMNS)],
        F.lit("").alias("trailing"),
    )
    path = scratch_path(r.spark, "positional")
    export.write.option("header", True).csv(path)
    return files.recipe_rows(files.read_csv_positional(r.spark, path))


@query(
    "A4_read_json_records",
    """SELECT p_brand AS kitchen, p_name AS ingredient, CAST(p_size AS DOUBLE) AS qty_available, 'kg' AS unit FROM part
    UNION ALL SELECT p_brand, p_type, p_retailprice, 'kg' FROM part""",
)
def _(r):
    def rec(name, qty):
        return F.struct(
            F.col("p_brand").alias("outlet"), F.col(name).alias("productName"),
            F.col(qty).cast("double").alias("currentStock"), F.lit("kg").alias("unit"),
        )

    records = F.array(rec("p_name", "p_size"), rec("p_type", "p_retailprice"))
    wrapper = F.col("p_size") > 25
    payload = F.to_json(
        F.struct(F.when(wrapper, records).alias("data"), F.when(~wrapper, records).alias("results"), F.lit(2).alias("count"))
    )
    path = _write_text(r.t("part").select(payload.alias("value")), "json")
    return files.stock_records(files.read_json_records(r.spark, path))


@query(
    "A6_flatten_recipes",
    """WITH src AS (SELECT p_brand, p_name, p_type, p_size, CAST(p_size - 10 AS DOUBLE) AS b FROM part),
      src2 AS (SELECT *, CASE WHEN b = 0 THEN 1.0 ELSE b END AS batch FROM src)
    SELECT p_name AS dish_name, CASE WHEN p_type = 'SMALL' THEN 'flour' ELSE p_type END AS ingredient,
      round(CASE WHEN batch > 0 THEN p_size * 7.0 / batch ELSE p_size * 7.0 END, 6) AS qty_per_unit, 'ml' AS unit FROM src2
    UNION ALL SELECT p_name, CASE WHEN p_type = 'SMALL' THEN p_brand ELSE p_type END,
      round(CASE WHEN batch > 0 THEN 13.0 / batch ELSE 13.0 END, 6), 'kg' FROM src2""",
)
def _(r):
    def ing(title, qty, base, unit):
        return F.struct(
            F.struct(title.alias("productTitle"), F.lit(base).alias("baseUnit"), F.lit(90.0).alias("yieldPercentage")).alias("product"),
            qty.alias("quantity"),
            F.struct(F.lit(unit).cast("string").alias("unit")).alias("ingredientUnit"),
        )

    code = F.when(F.col("p_type") == "SMALL", F.lit("")).otherwise(F.col("p_type"))
    payload = F.to_json(
        F.struct(
            F.array("p_name").alias("name"), F.array(code).alias("recipeId"),
            (F.col("p_size") - 10).cast("double").alias("batchSize"),
            F.array(
                ing(F.lit("flour"), F.col("p_size") * 7.0, "g", "ml"), ing(F.col("p_brand"), F.lit(13.0), "kg", None)
            ).alias("ingredients"),
        )
    )
    return files.read_recipes(r.spark, _write_text(r.t("part").select(payload.alias("value")), "recipes"))


@query(
    "A7_flatten_stock_json",
    """SELECT (SELECT d FROM ship_day) AS snapshot_date, s_name AS kitchen, 'SKU' || CAST(s_nationkey AS VARCHAR) AS ingredient,
      s_acctbal AS qty_available, 'g' AS unit FROM supplier
    UNION ALL SELECT (SELECT d FROM ship_day), s_name, 'id' || CAST(s_suppkey AS VARCHAR), 5.0, 'piece' FROM supplier""",
)
def _(r):
    def item(product, current, stock):
        return F.struct(product.alias("product"), current.alias("currentStock"), stock.alias("stock"))

    text, num = F.lit(None).cast("string"), F.lit(None).cast("double")

    def product(code, pid, base):
        return F.struct(code.alias("skuProductCode"), pid.alias("_id"), base.alias("baseUnit"))

    coded = product(F.concat(F.lit("SKU"), F.col("s_nationkey").cast("string")), text, F.lit("g"))
    bare = product(text, F.concat(F.lit("id"), F.col("s_suppkey").cast("string")), text)
    missing = F.when(F.lit(False), coded)
    payload = F.to_json(
        F.struct(
            F.col("s_name").alias("name"),
            F.array(item(coded, F.col("s_acctbal"), num), item(bare, num, F.lit(5.0)), item(missing, F.lit(1.0), num)).alias("items"),
        )
    )
    return files.read_stock(r.spark, _write_text(r.t("supplier").select(payload.alias("value")), "stock"), r.ship_as_of)


STOCK_KEY = ["snapshot_date", "kitchen", "ingredient"]


def stock_halves(r):
    """Stored stock and a newer overlapping batch with corrected quantities."""
    stock = r.kitchen_stock().drop("location")
    stored = stock.where(F.col("snapshot_date") <= F.date_sub(r.ship_as_of, 300))
    batch = stock.where(F.col("snapshot_date") > F.date_sub(r.ship_as_of, 600)).withColumn(
        "qty_available", F.col("qty_available") + 1
    )
    return stored, batch


HALVES_SQL = """stored AS (SELECT snapshot_date, kitchen, ingredient, qty_available, unit FROM kitchen_stock
      WHERE snapshot_date <= (SELECT d - 300 FROM ship_day)),
    batch AS (SELECT snapshot_date, kitchen, ingredient, qty_available + 1 AS qty_available, unit FROM kitchen_stock
      WHERE snapshot_date > (SELECT d - 600 FROM ship_day))"""


UPDATED_SQL = f"""WITH {HALVES_SQL} SELECT * FROM batch UNION ALL SELECT s.* FROM stored s ANTI JOIN batch b
    ON s.snapshot_date = b.snapshot_date AND s.kitchen = b.kitchen AND s.ingredient = b.ingredient"""
IGNORED_SQL = f"""WITH {HALVES_SQL} SELECT * FROM stored UNION ALL SELECT b.* FROM batch b ANTI JOIN stored s
    ON s.snapshot_date = b.snapshot_date AND s.kitchen = b.kitchen AND s.ingredient = b.ingredient"""


@query("A8_upsert_update", UPDATED_SQL)
def _(r):
    return sinks.upsert(*stock_halves(r), STOCK_KEY)


@query("A9_upsert_ignore", IGNORED_SQL)
def _(r):
    return sinks.insert_new(*stock_halves(r), STOCK_KEY)


def monthly_halves(r):
    """``stock_halves`` with the month of the snapshot, by which the table is stored."""
    return [half.withColumn("month", F.trunc("snapshot_date", "month")) for half in stock_halves(r)]


@query("A8_upsert_update_stored", UPDATED_SQL)
def _(r):
    """The stored table by month, and a batch that rewrites the months it names."""
    path, key = scratch_path(r.spark, "stock"), ["month", *STOCK_KEY]
    for half in monthly_halves(r):
        sinks.upsert_path(half, path, key, "month")
    return r.spark.read.parquet(path).drop("month")


@query("A9_upsert_ignore_stored", IGNORED_SQL)
def _(r):
    """The stored table by month, and a batch, delivered twice, that adds the keys which it lacks."""
    path, key = scratch_path(r.spark, "stock"), ["month", *STOCK_KEY]
    stored, batch = monthly_halves(r)
    for half in (stored, batch, batch):
        sinks.insert_new_path(half, path, key, "month", ["qty_available"])
    return r.spark.read.parquet(path).drop("month")


@query(
    "A10_upsert_conditional",
    """WITH old AS (SELECT CAST(p_partkey AS VARCHAR) AS sku_code, p_name AS sku_name, p_type <> 'SMALL' AS is_tracked
        FROM part WHERE p_size <= 40),
      new AS (SELECT CAST(p_partkey AS VARCHAR) AS sku_code, upper(p_name) AS sku_name, FALSE AS is_tracked FROM part WHERE p_size > 10)
    SELECT coalesce(o.sku_code, n.sku_code) AS sku_code,
      CASE WHEN o.sku_code IS NOT NULL AND (n.sku_code IS NULL OR o.is_tracked) THEN o.sku_name ELSE n.sku_name END AS sku_name,
      CASE WHEN o.sku_code IS NOT NULL AND (n.sku_code IS NULL OR o.is_tracked) THEN o.is_tracked ELSE n.is_tracked END AS is_tracked
    FROM old o FULL JOIN new n ON o.sku_code = n.sku_code""",
)
def _(r):
    parts = r.t("part", "p_partkey", "p_name", "p_type", "p_size")
    code = F.col("p_partkey").cast("string").alias("sku_code")
    old = parts.where(F.col("p_size") <= 40).select(
        code, F.col("p_name").alias("sku_name"), (F.col("p_type") != "SMALL").alias("is_tracked")
    )
    new = parts.where(F.col("p_size") > 10).select(code, F.upper("p_name").alias("sku_name"), F.lit(False).alias("is_tracked"))
    return sinks.upsert_unless(old, new, ["sku_code"], locked="is_tracked")


REPLACED_SQL = """SELECT date, sku, outlet, CASE WHEN date >= (SELECT d - 6 FROM ship_day) THEN qty_sold * 2 ELSE qty_sold END AS qty_sold
    FROM sales_coarse WHERE date < (SELECT d - 6 FROM ship_day) OR sku <> 'SMALL'"""


@query("A11_replace_window", REPLACED_SQL)
def _(r):
    start, end = F.date_sub(r.ship_as_of, 6), r.ship_as_of
    stored = r.daily_qty()
    recomputed = r.daily_qty(since=start).where(F.col("sku") != "SMALL").withColumn("qty_sold", F.col("qty_sold") * 2)
    return sinks.replace_window(stored, recomputed, "date", start, end)


@query("A11_replace_window_stored", REPLACED_SQL)
def _(r):
    """The fact stored by month; the last week is computed again and replaces its days, twice."""
    path, stored = scratch_path(r.spark, "fact"), r.daily_qty()
    facts.store_fact(stored, path)
    newest = r.spark.range(1).select(r.ship_as_of).first()[0]
    recomputed = r.daily_qty(since=F.date_sub(r.ship_as_of, 6)).where(F.col("sku") != "SMALL")
    for _ in range(2):
        doubled = recomputed.withColumn("qty_sold", F.col("qty_sold") * 2)
        facts.refresh_fact(doubled, path, newest - dt.timedelta(days=6), newest)
    return facts.read_fact(r.spark, path, stored.schema)


@query("A12_replace_table", "SELECT dish_name, ingredient, qty_per_unit * 2 AS qty_per_unit, unit FROM recipe_master")
def _(r):
    path = scratch_path(r.spark, "published")
    sinks.publish(r.recipe_master(), path)
    doubled = sinks.read_published(r.spark, path).withColumn("qty_per_unit", F.col("qty_per_unit") * 2)
    sinks.publish(doubled, path)
    return sinks.read_published(r.spark, path)


@query(
    "A13_replace_key_group",
    """WITH edits AS (SELECT lower(p_brand) AS dish_name, 'salt ' || CAST(p_size AS VARCHAR) AS ingredient,
        CAST(count(*) AS DOUBLE) AS qty_per_unit, 'kg' AS unit FROM part WHERE p_brand LIKE '%1' GROUP BY p_brand, p_size)
    SELECT * FROM edits UNION ALL SELECT dish_name, ingredient, qty_per_unit, unit FROM recipe_master
    WHERE lower(dish_name) NOT IN (SELECT dish_name FROM edits)""",
)
def _(r):
    edits = (
        r.t("part", "p_brand", "p_size").where(F.col("p_brand").like("%1"))
        .groupBy(
            F.concat(F.lit(" "), F.upper("p_brand"), F.lit(" ")).alias("dish_name"),
            F.concat(F.lit("Salt "), F.col("p_size").cast("string")).alias("ingredient"),
        )
        .agg(F.count("*").cast("double").alias("qty_per_unit"))
        .withColumn("unit", F.lit("kg"))
    )
    return sinks.replace_group(r.recipe_master(), edits, "dish_name", ["dish_name", "ingredient"])


@query(
    "A14_append_matching_columns",
    """SELECT s_suppkey, s_name, s_acctbal FROM supplier
    UNION ALL SELECT c_custkey, c_name, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END FROM customer""",
)
def _(r):
    path = sinks.round_trip(r.t("supplier", "s_suppkey", "s_name", "s_acctbal"), "append")
    balance = F.when(F.col("c_acctbal") < 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal"))
    source = r.t("customer", "c_custkey", "c_name", "c_acctbal", "c_mktsegment").select(
        F.col("c_custkey").alias("s_suppkey"), F.col("c_name").alias("s_name"), balance.alias("s_acctbal"), "c_mktsegment"
    )
    sinks.append_path(source, path)
    return r.spark.read.parquet(path)


@query(
    "A15_schema_evolve_append",
    """SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS status, CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS priority,
      CASE WHEN o_orderstatus <> 'F' THEN CAST(o_custkey AS VARCHAR) END AS total, CASE WHEN o_orderstatus = 'P' THEN o_orderstatus || '!' END AS note FROM orders""",
)
def _(r):
    """Three appended batches, each with columns that the table has not seen."""
    orders = r.t("orders", "o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey")
    key, status = F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("status")
    priority, total = F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("total")
    note = F.concat("o_orderstatus", F.lit("!")).alias("note")
    path = scratch_path(r.spark, "evolving")
    for value, columns in (("F", [key, status]), ("O", [key, status, priority, total]), ("P", [note, total, status, priority, key])):
        sinks.append_evolving(orders.where(F.col("o_orderstatus") == value).select(*columns), path)
    return sinks.read_evolving(r.spark, path)


@query(
    "A16_json_cache_sink",
    """SELECT 'sales_by_brand' AS endpoint, CAST(to_json(list({'brand': brand, 'orders': orders} ORDER BY brand)) AS VARCHAR) AS payload,
      (SELECT d FROM order_day) AS generated_at
    FROM (SELECT brand_name AS brand, count(*) AS orders FROM pos_orders GROUP BY brand_name)""",
)
def _(r):
    report = r.pos_orders().groupBy(F.col("brand_name").alias("brand")).agg(F.count("*").alias("orders"))
    cached = sinks.report_json(report, "sales_by_brand", ["brand"], r.order_as_of)
    path = sinks.round_trip(cached, "cache")
    return r.spark.read.parquet(path)


@query("A17_tabular_export", "SELECT p_brand, CAST(count(*) AS VARCHAR) AS parts, max(p_name) AS last_name FROM part GROUP BY p_brand")
def _(r):
    ranked = r.t("part", "p_brand", "p_name").groupBy("p_brand").agg(
        F.count("*").alias("parts"), F.max("p_name").alias("last_name")
    )
    path = scratch_path(r.spark, "export")
    sinks.export_csv(ranked, path)
    return r.spark.read.option("header", True).csv(path)
