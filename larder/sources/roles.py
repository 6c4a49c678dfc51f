"""The planning tables ("roles") as views over the supplied star schema.

Each role exists twice with the same meaning: as a DataFrame method of
:class:`Roles` and as a SQL common table expression in :data:`ROLE_SQL`, which
the oracle queries share. No join is hinted: nation and region are fixed-size,
everything else grows, and Spark's size-checked threshold decides.
"""

from __future__ import annotations

import copy
import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from larder.functions.dates import latest
from larder.operators import forecast as fc
from larder.session import scratch_path
from larder.sources import facts
from larder.sources.tables import read_table

FORECAST_CUT_DAYS = 30
LINES_PER_TASK = 250_000
DEMAND_HORIZON = 8


class Roles:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._tables: dict[str, DataFrame] = {}
        self._fact: tuple[str, T.StructType] | None = None

    def t(self, name: str, *columns: str) -> DataFrame:
        # One file listing and footer read per table, however often a plan scans it.
        if name not in self._tables:
            self._tables[name] = read_table(self.spark, self.folder, name)
        table = self._tables[name]
        return table.select(*columns) if columns else table

    @cached_property
    def _line_parts(self) -> int | None:
        """Partitions for a shuffle of all order lines; None where they are few enough for any choice.

        Spark sizes its shuffle partitions by their compressed bytes. Lines are
        short and compress well, so its tasks would sort and hash millions of them.
        """
        lines = self.t("lineitem").count()
        if lines <= LINES_PER_TASK:
            return None
        return max(-(-lines // LINES_PER_TASK), self.spark.sparkContext.defaultParallelism)

    def _dealt(self, df: DataFrame, key: str) -> DataFrame:
        """A table as long as the lines in partitions of ``key`` that hold a bounded number of them."""
        return df if self._line_parts is None else df.repartition(self._line_parts, key)

    def sharing(self, *names: str) -> Roles:
        """The same roles, those named written once to the shared scratch folder and read by every use."""
        shared = copy.copy(self)
        for name in names:
            path = scratch_path(self.spark, f"role-{name}")
            role = getattr(self, name)()
            role.write.parquet(path)
            stored = self.spark.read.schema(role.schema).parquet(path)
            setattr(shared, name, lambda stored=stored: stored)
        return shared

    def by_month(self) -> Roles:
        """The same roles, with the daily fact stored once by month and windows of days read through its partitions.

        Quantities at every grain and the fine rows come from the fact, as does
        the planning date; the other grains' revenue and order counts, which
        don't add up from it, stay derived from the lines.
        """
        path, fact = scratch_path(self.spark, "daily-fact"), self.daily_fact()
        facts.store_fact(fact, path)
        shared = copy.copy(self)
        shared._fact = path, fact.schema
        shared.__dict__["ship_as_of"] = latest(facts.read_fact(self.spark, path, fact.schema), "date")
        shared.__dict__.pop("forecast_cut", None)
        return shared

    # -- planning dates, each from one narrow scan ---------------------------
    @cached_property
    def ship_as_of(self) -> Column:
        return latest(self.t("lineitem", "l_shipdate"), "l_shipdate")

    @cached_property
    def order_as_of(self) -> Column:
        return latest(self.t("orders", "o_orderdate"), "o_orderdate")

    @cached_property
    def event_as_of(self) -> Column:
        return latest(self.t("events", "ts"), "ts")

    @cached_property
    def forecast_cut(self) -> Column:
        return F.date_sub(self.ship_as_of, FORECAST_CUT_DAYS)

    # -- orders and sales ----------------------------------------------------
    def places(self) -> DataFrame:
        return (
            self.t("nation")
            .join(self.t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select("n_nationkey", F.col("n_name").alias("store_name"), F.col("r_name").alias("city"))
        )

    def pos_orders(self, where: Column | None = None) -> DataFrame:
        orders = self.t("orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus")
        if where is not None:
            orders = orders.where(where)
        customers = self.t("customer", "c_custkey", "c_nationkey", "c_mktsegment").join(
            self.places(), F.col("c_nationkey") == F.col("n_nationkey")
        )
        return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
            F.col("o_orderkey").alias("id"),
            F.col("o_orderdate").alias("created_at_ist"),
            F.to_date("o_orderdate").alias("order_date"),
            "store_name",
            F.col("c_mktsegment").alias("brand_name"),
            "city",
            F.col("o_totalprice").alias("total_amount"),
            F.col("o_orderstatus").alias("order_status"),
        )

    def pos_order_items(self, recent: Column | None = None) -> DataFrame:
        """Order items; with a condition on the order, lines of other orders are dropped before the item lookup."""
        lines = self.t("lineitem", "l_orderkey", "l_partkey", "l_returnflag", "l_quantity", "l_extendedprice")
        if recent is not None:
            keys = self.t("orders", "o_orderkey", "o_orderdate").where(recent).select("o_orderkey")
            lines = lines.join(keys, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
        parts = self.t("part", "p_partkey", "p_name")
        return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
            F.col("l_orderkey").alias("order_id"),
            F.col("p_name").alias("item_name"),
            F.col("l_returnflag").alias("option_names"),
            F.col("l_quantity").alias("quantity"),
            F.col("l_extendedprice").alias("total_price"),
        )

    def pos_items_text(self, recent: Column | None = None) -> DataFrame:
        """Order items as the feed delivers them: numbers as text with thousands separators."""
        return self.pos_order_items(recent).select(
            "order_id",
            "item_name",
            F.format_number("quantity", 2).alias("quantity"),
            F.format_number("total_price", 2).alias("total_price"),
        )

    def _sold_lines(self, since: Column | None, until: Column | None) -> DataFrame:
        """Order lines with their place. Date bounds apply to the scanned column."""
        lines = self.t("lineitem", "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate")
        if since is not None:
            lines = lines.where(F.col("l_shipdate") >= since.cast("timestamp_ntz"))
        if until is not None:
            lines = lines.where(F.col("l_shipdate") < F.date_add(until, 1).cast("timestamp_ntz"))
        if since is None and until is None:
            lines = self._dealt(lines, "l_orderkey")
        places = self.pos_orders().select("id", "store_name", "city", "brand_name", "order_date")
        return lines.join(places, F.col("l_orderkey") == F.col("id")).select(
            F.to_date("l_shipdate").alias("date"), "l_orderkey", "l_partkey",
            F.col("l_partkey").cast("string").alias("sku_code"),
            "store_name", "city", "brand_name", "order_date", "l_quantity", "l_extendedprice",
        )

    def sales_lines(self, since: Column | None = None, until: Column | None = None) -> DataFrame:
        """Sold lines with product and place."""
        parts = self.t("part", "p_partkey", "p_name", "p_type", "p_brand")
        return self._sold_lines(since, until).join(parts, F.col("l_partkey") == F.col("p_partkey")).drop("l_partkey", "p_partkey")

    def daily_fact(self, since: Column | None = None, until: Column | None = None) -> DataFrame:
        """Sales by day, part, nation and brand, codes only.

        Lines are first reduced to one row per order, for which the join with
        the orders has already placed them, so orders are counted without a
        distinct; names are joined to the sums, not to the lines.
        """
        if self._fact is not None:
            return facts.read_fact(self.spark, *self._fact, since, until)
        keys = ["date", "sku_code", F.col("store_name").alias("outlet"), F.col("brand_name").alias("brand")]
        per_order = self._sold_lines(since, until).groupBy("l_orderkey", *keys).agg(
            F.sum("l_quantity").alias("qty"), F.sum("l_extendedprice").alias("price")
        )
        return per_order.groupBy("date", "sku_code", "outlet", "brand").agg(
            F.sum("qty").alias("qty_sold"), F.round(F.sum("price"), 2).alias("revenue"), F.count("*").alias("order_count")
        )

    def daily_sales(self, grain: str = "coarse", since: Column | None = None, until: Column | None = None) -> DataFrame:
        """Sales by day. coarse: type x region, mid: brand x region, fine: part x nation."""
        if grain == "fine":
            parts = self.t("part", "p_partkey", "p_name").select(
                F.col("p_partkey").cast("string").alias("sku_code"), F.col("p_name").alias("sku")
            )
            places = self.places().select(F.col("store_name").alias("outlet"), "city")
            named = self.daily_fact(since, until).join(parts, "sku_code").join(places, "outlet")
            return named.select("date", "sku_code", "sku", "outlet", "brand", "city", "qty_sold", "revenue", "order_count")
        sku = {"coarse": "p_type", "mid": "p_brand"}[grain]
        return self.sales_lines(since, until).groupBy("date", F.col(sku).alias("sku"), F.col("city").alias("outlet")).agg(
            F.sum("l_quantity").alias("qty_sold"),
            F.round(F.sum("l_extendedprice"), 2).alias("revenue"),
            F.countDistinct("l_orderkey").alias("order_count"),
        )

    def daily_qty(self, grain: str = "coarse", since: Column | None = None, until: Column | None = None) -> DataFrame:
        """The quantity column alone: no distinct count to carry through the shuffle.

        At the fine grain the item is the line's own part key, so the part
        table, and the shuffle to reach it, is left out.
        """
        if self._fact is not None:
            lines = self.daily_fact(since, until).select(
                "date", "sku_code", F.col("outlet").alias("store_name"), F.col("qty_sold").alias("l_quantity")
            )
            if grain != "fine":
                parts = self.t("part", "p_partkey", "p_type", "p_brand").withColumn("sku_code", F.col("p_partkey").cast("string"))
                lines = lines.join(parts, "sku_code").join(self.places(), "store_name")
        else:
            lines = self._sold_lines(since, until) if grain == "fine" else self.sales_lines(since, until)
        sku = {"coarse": "p_type", "mid": "p_brand", "fine": "sku_code"}[grain]
        outlet = "store_name" if grain == "fine" else "city"
        return lines.groupBy("date", F.col(sku).alias("sku"), F.col(outlet).alias("outlet")).agg(
            F.sum("l_quantity").alias("qty_sold")
        )

    def history(self, grain: str = "coarse", days: int = 365, until: Column | None = None) -> DataFrame:
        """Daily quantities of the last ``days`` days up to the planning date."""
        end = self.ship_as_of if until is None else until
        return self.daily_qty(grain, since=F.date_sub(end, days), until=end)

    # -- recipes and catalogs ------------------------------------------------
    def recipe_master(self) -> DataFrame:
        return (
            self.t("part", "p_brand", "p_type", "p_size")
            .groupBy(F.col("p_brand").alias("dish_name"), F.col("p_type").alias("ingredient"))
            .agg(F.round(F.avg("p_size"), 6).alias("qty_per_unit"))
            .withColumn("unit", F.lit("g"))
        )

    def item_alias(self) -> DataFrame:
        base = (
            self.t("part", "p_name", "p_brand")
            .where(~F.col("p_name").startswith("s"))
            .groupBy(F.col("p_name").alias("pos_name"))
            .agg(F.min("p_brand").alias("recipe_name"))
        )
        rows = F.when(
            F.col("pos_name").startswith("b"),
            F.array(
                F.struct(F.lit(None).cast("string").alias("pos_option"), F.lit(1.0).alias("multiplier")),
                F.struct(F.lit("R").alias("pos_option"), F.lit(0.5).alias("multiplier")),
            ),
        ).otherwise(
            F.array(F.struct(F.lit(None).cast("string").alias("pos_option"), F.lit(1.0).alias("multiplier")))
        )
        return base.select("pos_name", "recipe_name", F.explode(rows).alias("a")).select(
            "pos_name", "a.pos_option", "recipe_name", "a.multiplier", F.lit(0.0).alias("additive_offset")
        )

    def _types(self) -> DataFrame:
        return self.t("part", "p_type").distinct()

    def dim_sku(self) -> DataFrame:
        return self._types().where(F.col("p_type") < "M").select(
            F.col("p_type").alias("sku_code"), F.concat(F.lower("p_type"), F.lit(" item")).alias("sku_name")
        )

    def dim_ingredients(self) -> DataFrame:
        return self._types().where(F.col("p_type") >= "M").select(
            F.col("p_type").alias("sku"), F.concat(F.lower("p_type"), F.lit(" item")).alias("name")
        )

    def dim_part(self) -> DataFrame:
        return self.t("part", "p_partkey", "p_name").select(
            F.col("p_partkey").cast("string").alias("sku_code"),
            F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("sku_name"),
        )

    def dim_outlets(self) -> DataFrame:
        return self.places().select(F.col("store_name").alias("outlet"), "city")

    def actual_usage(self, where: Column | None = None) -> DataFrame:
        """Consumption as the stock system reports it: by name, not by code."""
        orders = self.pos_orders(where).select("id", "order_date", "store_name")
        lines = self.t("lineitem", "l_orderkey", "l_partkey", "l_quantity").join(
            orders, F.col("l_orderkey") == F.col("id")
        )
        return (
            lines.join(self.t("part", "p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
            .groupBy(
                F.col("order_date").alias("date"),
                F.col("store_name").alias("outlet"),
                F.concat(F.lower("p_type"), F.lit(" item")).alias("sku"),
            )
            .agg(F.sum("l_quantity").alias("qty_sold"))
        )

    # -- stock, purchasing ---------------------------------------------------
    def kitchen_stock(self) -> DataFrame:
        places = self.t("nation").select(
            "n_nationkey",
            F.col("n_name").alias("kitchen"),
            F.concat(
                "n_name", F.when(F.col("n_nationkey") % 2 == 0, F.lit(" wh")).otherwise(F.lit(" kitchen"))
            ).alias("location"),
        )
        # Suppliers and places are joined one by one: Spark takes a join of both for too large to broadcast, and would shuffle the lines.
        return (
            self.t("lineitem", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
            .join(self.t("supplier", "s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
            .join(places, F.col("s_nationkey") == F.col("n_nationkey"))
            .groupBy(
                F.to_date("l_shipdate").alias("snapshot_date"),
                "kitchen",
                "location",
                F.col("l_partkey").cast("string").alias("ingredient"),
            )
            .agg((F.max("l_quantity") - 10).alias("qty_available"))
            .withColumn("unit", F.lit("g"))
        )

    def open_pos(self) -> DataFrame:
        lines = self.t("lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_linestatus").join(
            self.t("supplier", "s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey")
        ).select(F.col("l_orderkey").cast("string").alias("po_number"), "l_partkey", "s_name", "l_quantity", "l_linestatus")
        # Lines meet their order and, in reports, their receipts by this number: one shuffle serves all.
        per_line = self._dealt(lines, "po_number").groupBy("po_number", "l_partkey").agg(
            F.min("s_name").alias("vendor"),
            F.sum("l_quantity").alias("qty_ordered"),
            F.min("l_linestatus").alias("line_status"),
        )
        orders = self.t("orders", "o_orderkey", "o_orderdate").select(F.col("o_orderkey").cast("string").alias("po_number"), "o_orderdate")
        return per_line.join(orders, "po_number").select(
            "po_number",
            F.col("l_partkey").cast("string").alias("ingredient"),
            "vendor",
            "qty_ordered",
            F.date_add(F.to_date("o_orderdate"), 30).alias("expected_date"),
            F.when(F.col("line_status") == "O", F.lit("open")).otherwise(F.lit("Delivered")).alias("status"),
        )

    def grn_log(self) -> DataFrame:
        received = (
            self.t("lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_shipdate", "l_linestatus")
            .where(F.col("l_linestatus") == "F")
            .select(
                F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("grn_number"),
                F.col("l_orderkey").cast("string").alias("po_number"),
                F.col("l_partkey").cast("string").alias("ingredient"),
                F.to_date("l_shipdate").alias("received_date"),
                (F.col("l_quantity") + F.col("l_orderkey") % 7 - 2).alias("qty_received"),
            )
        )
        return self._dealt(received, "po_number")

    def vendor_master(self) -> DataFrame:
        return self.t("part", "p_partkey", "p_size", "p_retailprice", "p_brand").select(
            F.col("p_partkey").cast("string").alias("ingredient"),
            F.concat(F.lit("Vendor "), "p_brand").alias("vendor_name"),
            (F.col("p_size") % 14 + 1).alias("lead_time_days"),
            F.col("p_size").cast("double").alias("moq"),
            F.col("p_retailprice").alias("price"),
        )

    def tracker(self) -> DataFrame:
        """Tracked parts: every type but SMALL."""
        return self.t("part", "p_partkey", "p_name", "p_type", "p_size").where(F.col("p_type") != "SMALL").select(
            F.col("p_partkey").cast("string").alias("code"),
            F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("ingredient"),
            (F.col("p_size") % 10 / 2.0).alias("drr"),
            (F.col("p_size") % 14 + 1).alias("lead_time_days"),
        )

    def tracked_types(self) -> DataFrame:
        return self._types().where(F.col("p_type") != "SMALL").select(F.col("p_type").alias("code"))

    # -- forecasts -----------------------------------------------------------
    def forecast(self) -> DataFrame:
        """Moving average run 30 days before the newest sale, so actuals exist to score it."""
        cut = self.forecast_cut
        return fc.moving_average(self.history(until=cut), cut, keys=["sku", "outlet"])

    def forecast_fine(self) -> DataFrame:
        """Per part and nation from the planning date on."""
        return fc.moving_average(
            self.history("fine"), self.ship_as_of, keys=["sku", "outlet"], horizon=DEMAND_HORIZON
        )

    def demand(self) -> DataFrame:
        return fc.ingredient_demand(self.forecast_fine())

    # -- events --------------------------------------------------------------
    def feed(self) -> DataFrame:
        """Versioned change feed: sign -1 retracts."""
        return self.t("events", "event_id", "ts", "user_id", "event_type", "value").select(
            F.when(F.col("event_type") == "error", F.lit("-1")).otherwise(F.lit("1")).alias("sign"),
            "user_id", "event_type", "ts", "event_id", "value",
        )

    def alert_log(self) -> DataFrame:
        kind = F.col("event_type")
        return self.t("events", "event_id", "ts", "user_id", "event_type").select(
            F.col("event_id").cast("string").alias("alert_id"),
            kind.alias("alert_type"),
            F.when(kind == "error", "CRITICAL").when(kind == "purchase", "WARNING").otherwise("INFO").alias("severity"),
            F.concat(kind, F.lit(" at "), F.col("user_id").cast("string")).alias("message"),
            F.lit("").alias("sku"),
            F.col("user_id").cast("string").alias("outlet"),
            F.lit("").alias("ingredient"),
            F.col("ts").alias("created_at"),
            (F.col("event_id") % 2).cast("int").alias("resolved"),
        )


_MA = """SELECT sku, outlet, avg(qty_sold) AS a FROM (
    SELECT sku, outlet, qty_sold, row_number() OVER (PARTITION BY sku, outlet ORDER BY date DESC) AS rn
    FROM {source}) WHERE rn <= 14 GROUP BY sku, outlet"""

ROLE_SQL: dict[str, str] = {
    "ship_day": "SELECT max(CAST(l_shipdate AS DATE)) AS d FROM lineitem",
    "order_day": "SELECT max(CAST(o_orderdate AS DATE)) AS d FROM orders",
    "event_day": "SELECT max(CAST(ts AS DATE)) AS d FROM events",
    "places": """SELECT n_nationkey, n_name AS store_name, r_name AS city
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "pos_orders": """SELECT o_orderkey AS id, o_orderdate AS created_at_ist, CAST(o_orderdate AS DATE) AS order_date,
        store_name, c_mktsegment AS brand_name, city, o_totalprice AS total_amount, o_orderstatus AS order_status
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN places ON c_nationkey = n_nationkey""",
    "pos_order_items": """SELECT l_orderkey AS order_id, p_name AS item_name, l_returnflag AS option_names,
        l_quantity AS quantity, l_extendedprice AS total_price FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "pos_items_text": """SELECT order_id, item_name, format('{:,.2f}', quantity) AS quantity,
        format('{:,.2f}', total_price) AS total_price FROM pos_order_items""",
    "sales_lines": """SELECT CAST(l_shipdate AS DATE) AS date, l_orderkey, CAST(p_partkey AS VARCHAR) AS sku_code,
        p_name, p_type, p_brand, store_name, city, brand_name, order_date, l_quantity, l_extendedprice
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN pos_orders ON l_orderkey = id""",
    "sales_coarse": """SELECT date, p_type AS sku, city AS outlet, sum(l_quantity) AS qty_sold,
        round(sum(l_extendedprice), 2) AS revenue, count(DISTINCT l_orderkey) AS order_count
        FROM sales_lines GROUP BY date, p_type, city""",
    "sales_mid": """SELECT date, p_brand AS sku, city AS outlet, sum(l_quantity) AS qty_sold
        FROM sales_lines GROUP BY date, p_brand, city""",
    "sales_fine": """SELECT date, sku_code, p_name AS sku, store_name AS outlet, brand_name AS brand, city,
        sum(l_quantity) AS qty_sold, round(sum(l_extendedprice), 2) AS revenue, count(DISTINCT l_orderkey) AS order_count
        FROM sales_lines GROUP BY date, sku_code, p_name, store_name, brand_name, city""",
    "hist_coarse": """SELECT date, sku, outlet, qty_sold FROM sales_coarse
        WHERE date >= (SELECT d - 365 FROM ship_day)""",
    "hist_cut": """SELECT date, sku, outlet, qty_sold FROM sales_coarse
        WHERE date >= (SELECT d - 395 FROM ship_day) AND date <= (SELECT d - 30 FROM ship_day)""",
    "hist_fine": """SELECT date, sku_code AS sku, store_name AS outlet, sum(l_quantity) AS qty_sold FROM sales_lines
        WHERE date >= (SELECT d - 365 FROM ship_day) GROUP BY date, sku_code, store_name""",
    "recipe_master": """SELECT p_brand AS dish_name, p_type AS ingredient, round(avg(p_size), 6) AS qty_per_unit, 'g' AS unit
        FROM part GROUP BY p_brand, p_type""",
    "alias_base": """SELECT p_name AS pos_name, min(p_brand) AS recipe_name FROM part
        WHERE NOT starts_with(p_name, 's') GROUP BY p_name""",
    "item_alias": """SELECT pos_name, CAST(NULL AS VARCHAR) AS pos_option, recipe_name, CAST(1.0 AS DOUBLE) AS multiplier,
        CAST(0.0 AS DOUBLE) AS additive_offset FROM alias_base
        UNION ALL SELECT pos_name, 'R', recipe_name, 0.5, 0.0 FROM alias_base WHERE starts_with(pos_name, 'b')""",
    "dim_sku": "SELECT DISTINCT p_type AS sku_code, lower(p_type) || ' item' AS sku_name FROM part WHERE p_type < 'M'",
    "dim_ingredients": "SELECT DISTINCT p_type AS sku, lower(p_type) || ' item' AS name FROM part WHERE p_type >= 'M'",
    "dim_part": """SELECT CAST(p_partkey AS VARCHAR) AS sku_code, p_name || ' ' || CAST(p_partkey AS VARCHAR) AS sku_name
        FROM part""",
    "dim_outlets": "SELECT store_name AS outlet, city FROM places",
    "actual_usage": """SELECT order_date AS date, store_name AS outlet, lower(p_type) || ' item' AS sku,
        sum(l_quantity) AS qty_sold FROM sales_lines GROUP BY order_date, store_name, p_type""",
    "kitchen_stock": """SELECT CAST(l_shipdate AS DATE) AS snapshot_date, n_name AS kitchen,
        n_name || CASE WHEN n_nationkey % 2 = 0 THEN ' wh' ELSE ' kitchen' END AS location,
        CAST(l_partkey AS VARCHAR) AS ingredient, max(l_quantity) - 10 AS qty_available, 'g' AS unit
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
        GROUP BY 1, 2, 3, 4""",
    "open_pos": """SELECT CAST(l_orderkey AS VARCHAR) AS po_number, CAST(l_partkey AS VARCHAR) AS ingredient,
        min(s_name) AS vendor, sum(l_quantity) AS qty_ordered, CAST(min(o_orderdate) AS DATE) + 30 AS expected_date,
        CASE WHEN min(l_linestatus) = 'O' THEN 'open' ELSE 'Delivered' END AS status
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey
        GROUP BY l_orderkey, l_partkey""",
    "grn_log": """SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS grn_number,
        CAST(l_orderkey AS VARCHAR) AS po_number, CAST(l_partkey AS VARCHAR) AS ingredient,
        CAST(l_shipdate AS DATE) AS received_date, l_quantity + l_orderkey % 7 - 2 AS qty_received
        FROM lineitem WHERE l_linestatus = 'F'""",
    "vendor_master": """SELECT CAST(p_partkey AS VARCHAR) AS ingredient, 'Vendor ' || p_brand AS vendor_name,
        p_size % 14 + 1 AS lead_time_days, CAST(p_size AS DOUBLE) AS moq, p_retailprice AS price FROM part""",
    "tracker": """SELECT CAST(p_partkey AS VARCHAR) AS code, p_name || ' ' || CAST(p_partkey AS VARCHAR) AS ingredient,
        CAST(p_size % 10 AS DOUBLE) / 2 AS drr, p_size % 14 + 1 AS lead_time_days FROM part WHERE p_type <> 'SMALL'""",
    "tracked_types": "SELECT DISTINCT p_type AS code FROM part WHERE p_type <> 'SMALL'",
    "forecast": f"""SELECT CAST((SELECT d - 30 FROM ship_day) + CAST(h AS INTEGER) AS DATE) AS forecast_date, sku, outlet,
        round(a, 2) AS qty_predicted, round(a * 0.8, 2) AS qty_lower, round(a * 1.2, 2) AS qty_upper,
        (SELECT d - 30 FROM ship_day) AS model_run_date
        FROM ({_MA.format(source='hist_cut')}), range(1, 31) r(h)""",
    "forecast_fine": f"""SELECT CAST((SELECT d FROM ship_day) + CAST(h AS INTEGER) AS DATE) AS forecast_date, sku, outlet,
        round(a, 2) AS qty_predicted FROM ({_MA.format(source='hist_fine')}), range(1, 9) r(h)""",
    "demand": """SELECT forecast_date, 'ALL' AS outlet, sku AS ingredient, 'unit' AS unit,
        round(sum(qty_predicted), 2) AS total_qty_needed FROM forecast_fine GROUP BY forecast_date, sku""",
    "feed": """SELECT CASE WHEN event_type = 'error' THEN '-1' ELSE '1' END AS sign, user_id, event_type, ts, event_id, value
        FROM events""",
    "alert_log": """SELECT CAST(event_id AS VARCHAR) AS alert_id, event_type AS alert_type,
        CASE event_type WHEN 'error' THEN 'CRITICAL' WHEN 'purchase' THEN 'WARNING' ELSE 'INFO' END AS severity,
        event_type || ' at ' || CAST(user_id AS VARCHAR) AS message, '' AS sku, CAST(user_id AS VARCHAR) AS outlet,
        '' AS ingredient, ts AS created_at, CAST(event_id % 2 AS INTEGER) AS resolved FROM events""",
}


def _needs(text: str) -> list[str]:
    return [name for name in ROLE_SQL if re.search(rf"\b{name}\b", text)]


def with_roles(sql: str) -> str:
    """Prefix ``sql`` with the role expressions it mentions, dependencies first."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in ordered:
            return
        for inner in _needs(ROLE_SQL[name]):
            if inner != name:
                add(inner)
        ordered.append(name)

    for name in _needs(sql):
        add(name)
    body = sql.strip()
    if not ordered:
        return body
    ctes = ",\n".join(f"{name} AS ({ROLE_SQL[name]})" for name in ordered)
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
