"""B-queries: cleaning, deduplication, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import dates, locations, numbers, text, units
from larder.operators import cleaning as cl
from larder.suite.registry import query

# Dirty variants derived from the supplied rows, in both dialects.
RAW_PARTS_SQL = """SELECT p_partkey, '  ' || p_name || ' ' AS name,
    CASE p_type WHEN 'SMALL' THEN 'nan' WHEN 'PROMO' THEN NULL WHEN 'LARGE' THEN ' None' ELSE p_type END AS kind,
    CASE p_type WHEN 'SMALL' THEN 'abc' WHEN 'PROMO' THEN NULL ELSE CAST(p_size AS VARCHAR) END AS size_text
    FROM part"""


def raw_parts(r):
    kind = F.col("p_type")
    return r.t("part", "p_partkey", "p_name", "p_type", "p_size").select(
        "p_partkey",
        F.concat(F.lit("  "), "p_name", F.lit(" ")).alias("name"),
        F.when(kind == "SMALL", "nan").when(kind == "PROMO", F.lit(None)).when(kind == "LARGE", " None")
        .otherwise(kind).alias("kind"),
        F.when(kind == "SMALL", "abc").when(kind == "PROMO", F.lit(None))
        .otherwise(F.col("p_size").cast("string")).alias("size_text"),
    )


@query(
    "B1_strip_strings",
    f"""WITH raw AS ({RAW_PARTS_SQL})
    SELECT p_partkey, trim(name) AS name,
      CASE WHEN kind IS NULL OR trim(kind) IN ('nan','None','NaN') THEN '' ELSE trim(kind) END AS kind,
      CASE WHEN size_text IS NULL THEN '' ELSE size_text END AS size_text FROM raw""",
)
def _(r):
    return text.strip_strings(raw_parts(r))


@query(
    "B2_normalise_name",
    r"""SELECT p_partkey, regexp_replace(lower(trim('  ' || upper(p_name) || '   ' || p_brand || ' ')), '\s+', ' ', 'g') AS name
    FROM part""",
)
def _(r):
    messy = F.concat(F.lit("  "), F.upper("p_name"), F.lit("   "), F.col("p_brand"), F.lit(" "))
    return r.t("part", "p_partkey", "p_name", "p_brand").select(
        "p_partkey", text.normalise_name(messy).alias("name")
    )


@query(
    "B4_to_local_time",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL
      ELSE strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S') END AS local_time FROM events""",
)
def _(r):
    as_text = F.when(F.col("event_type") == "error", "not a time").otherwise(F.col("ts").cast("string"))
    local = dates.to_local(as_text)
    return r.t("events", "event_id", "event_type", "ts").select(
        "event_id", F.date_format(local, "yyyy-MM-dd HH:mm:ss").alias("local_time")
    )


STATUS_SQL = "CASE o_orderstatus WHEN 'F' THEN 'Delivered' WHEN 'O' THEN 'pending' ELSE 'SUCCESS' END"


@query(
    "B5_filter_completed_orders",
    f"""SELECT o_orderkey, {STATUS_SQL} AS status FROM orders
    WHERE lower({STATUS_SQL}) IN ('completed','delivered','complete','fulfilled','done','success')""",
)
def _(r):
    status = F.when(F.col("o_orderstatus") == "F", "Delivered").when(F.col("o_orderstatus") == "O", "pending").otherwise("SUCCESS")
    return cl.completed_orders(r.t("orders", "o_orderkey", "o_orderstatus").select("o_orderkey", status.alias("status")))


QTY_TEXT_SQL = "CASE l_returnflag WHEN 'A' THEN 'abc' WHEN 'R' THEN CAST(l_quantity - 25 AS VARCHAR) ELSE CAST(l_quantity AS VARCHAR) END"


def _qty_text():
    flag = F.col("l_returnflag")
    return (
        F.when(flag == "A", "abc")
        .when(flag == "R", (F.col("l_quantity") - 25).cast("string"))
        .otherwise(F.col("l_quantity").cast("string"))
    )


@query(
    "B6_filter_positive_qty",
    f"""SELECT l_orderkey, l_partkey, l_linenumber, coalesce(TRY_CAST({QTY_TEXT_SQL} AS DOUBLE), 0) AS quantity
    FROM lineitem WHERE coalesce(TRY_CAST({QTY_TEXT_SQL} AS DOUBLE), 0) > 0""",
)
def _(r):
    lines = r.t("lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_quantity")
    return cl.positive_quantity(
        lines.select("l_orderkey", "l_partkey", "l_linenumber", _qty_text().alias("quantity")), "quantity"
    )


@query(
    "B7_coerce_numeric_default",
    f"""WITH raw AS ({RAW_PARTS_SQL})
    SELECT p_partkey, coalesce(TRY_CAST(size_text AS DOUBLE), 7.0) AS lead_time_days,
      coalesce(TRY_CAST(size_text AS DOUBLE), 1.0) AS moq, coalesce(TRY_CAST(kind AS DOUBLE), 0.0) AS price FROM raw""",
)
def _(r):
    return raw_parts(r).select(
        "p_partkey",
        numbers.coerce(F.col("size_text"), 7).alias("lead_time_days"),
        numbers.coerce(F.col("size_text"), 1).alias("moq"),
        numbers.coerce(F.col("kind"), 0).alias("price"),
    )


@query(
    "B8_parse_formatted_number",
    """SELECT order_id, item_name,
      CAST(TRY_CAST(nullif(replace(quantity, ',', ''), '') AS DECIMAL(18,4)) AS DOUBLE) AS quantity,
      CAST(TRY_CAST(nullif(replace(total_price, ',', ''), '') AS DECIMAL(18,4)) AS DOUBLE) AS total_price
    FROM pos_items_text""",
)
def _(r):
    return r.pos_items_text().select(
        "order_id", "item_name",
        numbers.parse_formatted(F.col("quantity")).cast("double").alias("quantity"),
        numbers.parse_formatted(F.col("total_price")).cast("double").alias("total_price"),
    )


@query(
    "B9_clip_range",
    f"""WITH raw AS ({RAW_PARTS_SQL})
    SELECT p_partkey, greatest(least(coalesce(TRY_CAST(size_text AS DOUBLE) / 40 - 0.1, 1.0), 1.0), 0.01) AS yield_factor
    FROM raw""",
)
def _(r):
    factor = F.coalesce(F.col("size_text").try_cast("double") / 40 - 0.1, F.lit(1.0))
    return raw_parts(r).select("p_partkey", numbers.clip(factor, 0.01, 1.0).alias("yield_factor"))


@query("B10_drop_tombstones", "SELECT sign, user_id, event_type, event_id FROM feed WHERE sign = '1'")
def _(r):
    return cl.drop_tombstones(r.feed()).select("sign", "user_id", "event_type", "event_id")


@query("B11_drop_exact_duplicates", "SELECT DISTINCT sign, user_id, event_type, CAST(ts AS DATE) AS day FROM feed")
def _(r):
    return r.feed().select("sign", "user_id", "event_type", F.to_date("ts").alias("day")).distinct()


@query(
    "B12_dedup_keep_last",
    """SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (
      PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM feed WHERE sign = '1') WHERE rn = 1""",
)
def _(r):
    return cl.clean_feed(r.feed(), ["user_id", "event_type"], ["ts", "event_id"]).select(
        "user_id", "event_type", "event_id", "value"
    )


@query(
    "B12_dedup_order_lines",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM (
      SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC,
        l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) AS rn FROM lineitem) WHERE rn = 1""",
)
def _(r):
    cols = ["l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    return cl.keep_last(r.t("lineitem", *cols), cols[:2], cols[2:]).drop("l_shipdate")


@query(
    "B13_dedup_keep_first",
    """SELECT sku, partkey, brand FROM (SELECT p_name AS sku, p_partkey AS partkey, p_brand AS brand,
      row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rn FROM part) WHERE rn = 1""",
)
def _(r):
    parts = r.t("part", "p_name", "p_partkey", "p_brand").toDF("sku", "partkey", "brand")
    return cl.keep_first(parts, ["sku"], ["partkey"])


@query(
    "B14_reject_blank_key",
    """SELECT * FROM (SELECT CASE o_orderstatus WHEN 'P' THEN '  ' ELSE CAST(o_orderkey AS VARCHAR) END AS order_id,
      o_totalprice FROM orders) WHERE trim(order_id) <> ''""",
)
def _(r):
    key = F.when(F.col("o_orderstatus") == "P", "  ").otherwise(F.col("o_orderkey").cast("string"))
    orders = r.t("orders", "o_orderkey", "o_orderstatus", "o_totalprice").select(key.alias("order_id"), "o_totalprice")
    return cl.reject_blank_key(orders, "order_id")


@query(
    "B15_derive_vendor_id",
    """SELECT s_suppkey, s_name, 'V-' || substr(upper(regexp_replace(s_name, '[^A-Za-z0-9]', '', 'g')), 1, 10) AS vendor_id
    FROM supplier""",
)
def _(r):
    return r.t("supplier", "s_suppkey", "s_name").withColumn("vendor_id", text.vendor_code(F.col("s_name")))


@query(
    "B16_unmapped_skus",
    "SELECT DISTINCT item_name AS sku FROM pos_order_items WHERE item_name NOT IN (SELECT pos_name FROM item_alias)",
)
def _(r):
    return cl.unmapped(r.pos_order_items(), "item_name", r.item_alias(), "pos_name")


@query(
    "B17_date_parse_fallback",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN DATE '1999-12-31' ELSE CAST(o_orderdate AS DATE) END AS date
    FROM orders""",
)
def _(r):
    as_text = F.when(F.col("o_orderstatus") == "P", F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise(
        F.date_format("o_orderdate", "dd-MM-yyyy")
    )
    fallback = F.lit("1999-12-31").cast("date")
    return r.t("orders", "o_orderkey", "o_orderdate", "o_orderstatus").select(
        "o_orderkey", dates.parse_day_first(as_text, fallback).alias("date")
    )


@query(
    "B18_clamp_window",
    """SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_shipdate AS DATE) AS date FROM lineitem
    WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_shipdate <= TIMESTAMP '1998-06-30'""",
)
def _(r):
    lines = r.t("lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    window = F.col("l_shipdate").between(
        F.lit("1998-01-01").cast("timestamp_ntz"), F.lit("1998-06-30").cast("timestamp_ntz")
    )
    return lines.where(window).withColumn("date", F.to_date("l_shipdate")).drop("l_shipdate")


@query(
    "B20_range_sanity",
    """SELECT event_id, CAST(trunc(abs(value - 50)) AS INTEGER) AS sold, CAST(round(value) AS INTEGER) AS stock FROM events""",
)
def _(r):
    return r.t("events", "event_id", "value").select(
        "event_id", F.abs(F.col("value") - 50).cast("int").alias("sold"), F.round("value").cast("int").alias("stock")
    )


@query(
    "B21_dynamic_filter",
    """SELECT id, store_name, brand_name, city FROM pos_orders WHERE order_date >= DATE '1997-01-01'
      AND order_date <= DATE '1998-12-31' AND lower(brand_name) = 'machinery' AND contains(lower(store_name), '_1')""",
)
def _(r):
    return cl.filters(
        r.pos_orders(), "order_date", F.lit("1997-01-01").cast("date"), F.lit("1998-12-31").cast("date"),
        equal={"brand_name": "Machinery", "city": None}, containing={"store_name": "_1"},
    ).select("id", "store_name", "brand_name", "city")


@query(
    "B22_default_window",
    """SELECT o_orderkey, o_totalprice FROM orders
    WHERE o_orderdate >= (SELECT CAST(d - 30 AS TIMESTAMP) FROM order_day)""",
)
def _(r):
    since = F.date_sub(r.order_as_of, 30).cast("timestamp_ntz")
    return r.t("orders", "o_orderkey", "o_totalprice", "o_orderdate").where(F.col("o_orderdate") >= since).drop("o_orderdate")


@query(
    "B23_warehouse_predicate",
    """SELECT DISTINCT location,
      contains(lower(location), 'warehouse') OR contains(lower(location), ' wh') OR contains(lower(location), 'wh ')
        OR contains(lower(location), '_wh') OR contains(lower(location), 'hub') OR contains(lower(location), 'central')
        OR contains(lower(location), 'cluster store') OR contains(lower(location), 'cluster kitchen')
        OR contains(lower(location), 'store/wh') AS plan,
      lower(location) LIKE '%warehouse%' OR lower(location) LIKE '% wh %' OR lower(location) LIKE '%_wh%'
        OR lower(location) LIKE '%hub%' OR lower(location) LIKE '%central%' OR lower(location) LIKE '%commissary%' AS procurement,
      lower(location) LIKE '%warehouse%' OR lower(location) LIKE '%_wh%' AS alerts
    FROM kitchen_stock""",
)
def _(r):
    places = r.kitchen_stock().select("location").distinct()
    return places.select(
        "location",
        *[locations.is_warehouse(F.col("location"), v).alias(v) for v in ("plan", "procurement", "alerts")],
    )


@query(
    "B24_quarantine_ids",
    """SELECT outlet, count(*) AS n FROM (SELECT CASE WHEN event_type = 'error' THEN substr(md5(CAST(user_id AS VARCHAR)), 1, 24)
      ELSE CAST(user_id AS VARCHAR) END AS outlet FROM events) WHERE regexp_full_match(outlet, '[0-9a-f]{24}') GROUP BY outlet""",
)
def _(r):
    who = F.col("user_id").cast("string")
    outlet = F.when(F.col("event_type") == "error", F.substring(F.md5(who), 1, 24)).otherwise(who)
    return (
        r.t("events", "user_id", "event_type").select(outlet.alias("outlet"))
        .where(text.is_raw_id(F.col("outlet"))).groupBy("outlet").agg(F.count("*").alias("n"))
    )


def _in_list(factors):
    return "CASE u " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in factors.items()) + " END"


@query(
    "B25_uom_standardise",
    f"""WITH raw AS (SELECT p_partkey, CASE WHEN p_size = 50 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS qty,
        CASE p_type WHEN 'ECONOMY' THEN 'KG' WHEN 'SMALL' THEN 'Tsp.' WHEN 'PROMO' THEN 'bag' WHEN 'LARGE' THEN ' L '
          WHEN 'MEDIUM' THEN NULL ELSE 'lb' END AS unit,
        p_name || CASE WHEN p_brand LIKE '%1' THEN ' Sauce' ELSE '' END AS ingredient FROM part),
      keyed AS (SELECT *, coalesce(regexp_replace(lower(trim(unit)), '\\.+$', ''), '') AS u FROM raw),
      f AS (SELECT *, {_in_list(units.GRAMS)} AS g, {_in_list(units.MILLILITRES)} AS ml,
        regexp_matches(lower(ingredient), '{"|".join(units.LIQUID_WORDS)}') AS liquid FROM keyed)
    SELECT p_partkey,
      CASE WHEN qty IS NULL THEN 0.0 WHEN g IS NOT NULL THEN round(qty * CAST(g AS DOUBLE), 4)
        WHEN ml IS NOT NULL THEN round(qty * CAST(ml AS DOUBLE), 4) ELSE qty END AS qty,
      CASE WHEN qty IS NULL OR g IS NOT NULL THEN 'g' WHEN ml IS NOT NULL OR liquid THEN 'ml' WHEN u = '' THEN 'g' ELSE u END AS unit
    FROM f""",
)
def _(r):
    kind = F.col("p_type")
    unit = (
        F.when(kind == "ECONOMY", "KG").when(kind == "SMALL", "Tsp.").when(kind == "PROMO", "bag")
        .when(kind == "LARGE", " L ").when(kind == "MEDIUM", F.lit(None)).otherwise("lb")
    )
    name = F.concat("p_name", F.when(F.col("p_brand").endswith("1"), F.lit(" Sauce")).otherwise(F.lit("")))
    qty = F.when(F.col("p_size") != 50, F.col("p_size").cast("double"))
    value, standard = units.standardise(F.col("qty"), F.col("unit"), F.col("ingredient"))
    return (
        r.t("part", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
        .select("p_partkey", qty.alias("qty"), unit.alias("unit"), name.alias("ingredient"))
        .select("p_partkey", value.alias("qty"), standard.alias("unit"))
    )


@query(
    "B26_missing_dates",
    """WITH present AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem WHERE l_quantity >= 50)
    SELECT CAST(g AS DATE) AS date FROM (SELECT unnest(generate_series(
      CAST(min(date) AS TIMESTAMP), CAST(max(date) AS TIMESTAMP), INTERVAL 1 DAY)) AS g FROM present)
    WHERE CAST(g AS DATE) NOT IN (SELECT date FROM present)""",
)
def _(r):
    return cl.missing_dates(r.t("lineitem", "l_shipdate", "l_quantity").where(F.col("l_quantity") >= 50), "l_shipdate")


@query(
    "B26_missing_dates_all",
    """WITH present AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem)
    SELECT CAST(g AS DATE) AS date FROM (SELECT unnest(generate_series(
      CAST(min(date) AS TIMESTAMP), CAST(max(date) AS TIMESTAMP), INTERVAL 1 DAY)) AS g FROM present)
    WHERE CAST(g AS DATE) NOT IN (SELECT date FROM present)""",
)
def _(r):
    """Days without any line; none in a complete history."""
    return cl.missing_dates(r.t("lineitem", "l_shipdate"), "l_shipdate")


@query(
    "B12_clean_open_pos",
    """SELECT po_number, ingredient, vendor, CASE WHEN CAST(po_number AS BIGINT) % 5 = 0 THEN 0.0 ELSE qty_ordered END AS qty_ordered,
      CASE WHEN CAST(po_number AS BIGINT) % 3 > 0 THEN expected_date END AS expected_date, status FROM open_pos""",
)
def _(r):
    """Open orders as text, delivered twice: the newer version wins, bad numbers count as 0 and bad dates as missing."""
    return cl.clean_open_pos(pos_feed(r), ["version"]).drop("version")


def pos_feed(r):
    number = F.col("po_number").cast("bigint")
    newest = r.open_pos().withColumns(
        {
            "qty_ordered": F.when(number % 5 == 0, "n/a").otherwise(F.concat(F.lit(" "), F.col("qty_ordered").cast("string"))),
            "expected_date": F.when(number % 3 == 0, "soon").otherwise(F.col("expected_date").cast("string")),
            "vendor": F.concat(F.lit("  "), F.col("vendor"), F.lit(" ")), "version": F.lit(2),
        }
    )
    older = newest.withColumns({"version": F.lit(1), "status": F.lit("draft")})
    return older.unionByName(newest)


@query(
    "B17_clean_receipts",
    """SELECT grn_number, po_number, ingredient, CASE WHEN CAST(po_number AS BIGINT) % 4 > 0 THEN received_date END AS received_date,
      CASE WHEN CAST(po_number AS BIGINT) % 5 = 0 THEN 0.0 ELSE qty_received END AS qty_received FROM grn_log""",
)
def _(r):
    number = F.col("po_number").cast("bigint")
    raw = r.grn_log().withColumns(
        {
            "ingredient": F.concat("ingredient", F.lit(" ")),
            "received_date": F.when(number % 4 > 0, F.col("received_date").cast("string")).otherwise("?"),
            "qty_received": F.when(number % 5 > 0, F.col("qty_received").cast("string")).otherwise("-"),
        }
    )
    return cl.clean_receipts(raw)
