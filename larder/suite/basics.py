"""G-, H- and S-queries: ordering, set operations, scalar functions."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from larder.functions import text
from larder.operators import sales
from larder.plans.supply import rank_of
from larder.suite.registry import query


@query(
    "G1_custom_rank_order",
    """SELECT o_orderkey, o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END AS rank
    FROM orders ORDER BY rank, o_orderkey""",
)
def _(r):
    ranked = r.t("orders", "o_orderkey", "o_orderpriority").withColumn(
        "rank", rank_of(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"])
    )
    return ranked.orderBy("rank", "o_orderkey")


@query(
    "G2_nulls_last_desc",
    """SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS balance FROM customer
    ORDER BY balance DESC NULLS LAST, c_custkey""",
)
def _(r):
    balance = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))
    return (
        r.t("customer", "c_custkey", "c_acctbal").select("c_custkey", balance.alias("balance"))
        .orderBy(F.col("balance").desc_nulls_last(), "c_custkey")
    )


@query("G3_limit_top", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def _(r):
    return r.t("orders", "o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(20)


@query(
    "G4_sort_by_expressions",
    """SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice / l_quantity, 4) AS unit_price FROM lineitem
    ORDER BY l_extendedprice / l_quantity DESC, l_orderkey, l_linenumber, l_partkey LIMIT 100""",
)
def _(r):
    price = F.try_divide("l_extendedprice", "l_quantity")
    return (
        r.t("lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
        .orderBy(price.desc(), "l_orderkey", "l_linenumber", "l_partkey").limit(100)
        .select("l_orderkey", "l_linenumber", "l_partkey", F.round(price, 4).alias("unit_price"))
    )


@query(
    "G5_head_tail_per_group",
    """SELECT city, id, created, part FROM (SELECT city, id, order_date AS created, 'tail' AS part,
        row_number() OVER (PARTITION BY city ORDER BY order_date DESC, id DESC) AS rn FROM pos_orders) WHERE rn <= 14
    UNION ALL SELECT city, id, created, part FROM (SELECT city, id, order_date AS created, 'head' AS part,
        row_number() OVER (PARTITION BY city ORDER BY order_date, id) AS rn FROM pos_orders) WHERE rn <= 7""",
)
def _(r):
    orders = r.pos_orders().select("city", "id", F.col("order_date").alias("created"))

    def edge(part, n, *order):
        rank = F.row_number().over(W.partitionBy("city").orderBy(*order))
        return orders.withColumn("rn", rank).where(F.col("rn") <= n).drop("rn").withColumn("part", F.lit(part))

    tail = edge("tail", 14, F.col("created").desc(), F.col("id").desc())
    return tail.unionByName(edge("head", 7, "created", "id"))


@query("H1_union_distinct", "SELECT n_name AS name FROM nation UNION SELECT p_brand FROM part UNION SELECT p_type FROM part")
def _(r):
    parts = r.t("part", "p_brand", "p_type")
    return r.t("nation").select(F.col("n_name").alias("name")).union(parts.select("p_brand")).union(parts.select("p_type")).distinct()


@query("H2_union_all", "SELECT c_nationkey AS nationkey, c_acctbal AS balance FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier")
def _(r):
    customers = r.t("customer").select(F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("balance"))
    return customers.unionByName(r.t("supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nationkey")))


@query("H3_set_difference", "SELECT p_partkey AS partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 40")
def _(r):
    sold = r.t("lineitem", "l_partkey", "l_quantity").where(F.col("l_quantity") > 40).select(F.col("l_partkey").alias("partkey"))
    return r.t("part").select(F.col("p_partkey").alias("partkey")).subtract(sold)


@query(
    "H4_set_intersection",
    "SELECT outlet FROM dim_outlets WHERE city IN ('ASIA', 'EUROPE') INTERSECT SELECT DISTINCT store_name FROM pos_orders WHERE total_amount > 400000",
)
def _(r):
    chosen = r.pos_orders().where(F.col("total_amount") > 400000).select(F.col("store_name").alias("outlet"))
    return r.dim_outlets().where(F.col("city").isin("ASIA", "EUROPE")).select("outlet").intersect(chosen)


@query(
    "S1_string_functions",
    """SELECT p_partkey, lower(p_name) AS low, trim('  ' || p_brand || ' ') AS trimmed, replace(p_brand, '#', '-') AS dashed,
      p_name LIKE '%ring%' AS is_ring, p_brand || '/' || p_type AS joined, substr(p_type, 1, 3) AS head,
      regexp_replace(p_name, '[aeiou]', '', 'g') AS consonants, trim(split_part(p_name || ' - ' || p_brand, ' - ', 1)) AS first_part,
      CAST(length(p_name) AS INTEGER) AS len, left(p_name, 5) AS left5, contains(lower(p_name), 'bolt') AS has_bolt,
      format('{:,.1f}', p_retailprice) AS formatted FROM part""",
)
def _(r):
    name = F.col("p_name")
    return r.t("part").select(
        "p_partkey", F.lower(name).alias("low"), F.trim(F.concat(F.lit("  "), "p_brand", F.lit(" "))).alias("trimmed"),
        F.replace("p_brand", F.lit("#"), F.lit("-")).alias("dashed"), name.like("%ring%").alias("is_ring"),
        F.concat("p_brand", F.lit("/"), "p_type").alias("joined"), F.substring("p_type", 1, 3).alias("head"),
        F.regexp_replace(name, "[aeiou]", "").alias("consonants"),
        text.first_part(F.concat(name, F.lit(" - "), "p_brand")).alias("first_part"), F.length(name).alias("len"),
        F.left(name, F.lit(5)).alias("left5"), text.contains_ignore_case(name, "BOLT").alias("has_bolt"),
        F.format_number("p_retailprice", 1).alias("formatted"),
    )


@query(
    "S2_date_functions",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(o_orderdate AS DATE) - 7 AS week_ago,
      CAST(date_trunc('week', o_orderdate) AS DATE) AS week, CAST(day(o_orderdate) AS INTEGER) AS dom, CAST(month(o_orderdate) AS INTEGER) AS month,
      CAST(isodow(o_orderdate) - 1 AS INTEGER) AS dow, strftime(o_orderdate, '%d-%m-%Y') AS text,
      strftime(o_orderdate + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S') AS local_time,
      CAST(DATE '2002-01-01' - CAST(o_orderdate AS DATE) AS INTEGER) AS age, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start,
      CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS DATE) AS month_end FROM orders""",
)
def _(r):
    day = F.to_date("o_orderdate")
    return r.t("orders", "o_orderkey", "o_orderdate").select(
        "o_orderkey", day.alias("day"), F.date_sub(day, 7).alias("week_ago"),
        F.date_trunc("week", "o_orderdate").cast("date").alias("week"), F.dayofmonth(day).alias("dom"), F.month(day).alias("month"),
        F.weekday(day).alias("dow"), F.date_format("o_orderdate", "dd-MM-yyyy").alias("text"),
        F.date_format(F.convert_timezone(F.lit("UTC"), F.lit("Asia/Kolkata"), F.col("o_orderdate")), "yyyy-MM-dd HH:mm:ss").alias("local_time"),
        F.datediff(F.lit("2002-01-01").cast("date"), day).alias("age"), F.trunc(day, "month").alias("month_start"),
        F.add_months(F.trunc(day, "month"), 1).alias("month_end"),
    )


@query(
    "S3_math_functions",
    """SELECT l_orderkey, l_linenumber, l_partkey, abs(l_quantity - 25) AS dist, ceil(l_quantity / 7) * 7 AS up, round(l_extendedprice / 7, 2) AS r2,
      round(l_extendedprice / 7, 4) AS r4, least(l_quantity, 30.0) AS capped, greatest(l_quantity - 20, 0.0) AS floored,
      round(pow(0.75, l_linenumber), 6) AS weight FROM lineitem""",
)
def _(r):
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return r.t("lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.abs(q - 25).alias("dist"), (F.ceil(q / 7) * 7).cast("double").alias("up"),
        F.round(p / 7, 2).alias("r2"), F.round(p / 7, 4).alias("r4"), F.least(q, F.lit(30.0)).alias("capped"),
        F.greatest(q - 20, F.lit(0.0)).alias("floored"), F.round(F.pow(F.lit(0.75), "l_linenumber"), 6).alias("weight"),
    )


@query(
    "S4_conditional_functions",
    """SELECT event_id, CASE WHEN value > 50 THEN 'high' WHEN value > 10 THEN 'mid' ELSE 'low' END AS band,
      coalesce(nullif(event_type, 'view'), 'none') AS kind, nullif(user_id, 8) AS other FROM events""",
)
def _(r):
    value = F.col("value")
    return r.t("events", "event_id", "value", "event_type", "user_id").select(
        "event_id", F.when(value > 50, "high").when(value > 10, "mid").otherwise("low").alias("band"),
        F.coalesce(F.nullif("event_type", F.lit("view")), F.lit("none")).alias("kind"),
        F.nullif("user_id", F.lit(8)).alias("other"),
    )


@query(
    "S5_array_json_functions",
    """SELECT user_id, list_sort(list(DISTINCT event_type)) AS kinds, CAST(sum(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS BIGINT) AS k_sum,
      CAST(sum(coalesce(CAST(json_extract_string(props, '$.missing') AS INTEGER), -1)) AS BIGINT) AS absent FROM events GROUP BY user_id""",
)
def _(r):
    props = F.from_json("props", "k int, missing int")
    parsed = r.t("events", "user_id", "event_type", "props").select("user_id", "event_type", props.alias("p"))
    return parsed.groupBy("user_id").agg(
        F.sort_array(F.collect_set("event_type")).alias("kinds"), F.sum("p.k").alias("k_sum"),
        F.sum(F.coalesce("p.missing", F.lit(-1))).alias("absent"),
    )


@query(
    "S6_type_casts",
    """SELECT o_orderkey, CAST(TRY_CAST(CAST(o_totalprice AS VARCHAR) AS DECIMAL(18,4)) AS DOUBLE) AS amount, TRY_CAST(o_orderpriority AS INTEGER) AS bad,
      CAST(o_orderkey AS VARCHAR) AS text, TRY_CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS level FROM orders""",
)
def _(r):
    return r.t("orders", "o_orderkey", "o_totalprice", "o_orderpriority").select(
        "o_orderkey", F.col("o_totalprice").cast("string").try_cast("decimal(18,4)").cast("double").alias("amount"),
        F.col("o_orderpriority").try_cast("int").alias("bad"), F.col("o_orderkey").cast("string").alias("text"),
        F.substring("o_orderpriority", 1, 1).try_cast("int").alias("level"),
    )
