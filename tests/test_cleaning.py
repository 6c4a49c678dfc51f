from larder.functions import locations, numbers, text, units
from larder.operators import cleaning as cl
from pyspark.sql import functions as F


def values(df, col):
    return [r[col] for r in df.collect()]


def test_formatted_numbers(spark):
    df = spark.createDataFrame([(1, "1,234.50"), (2, ""), (3, "abc"), (4, None)], "i int, x string")
    out = values(df.select("i", numbers.parse_formatted(F.col("x")).cast("double").alias("v")).orderBy("i"), "v")
    assert out == [1234.5, None, None, None]


def test_moq_edges(spark):
    df = spark.createDataFrame([(1, 0.0, 5.0), (2, -1.0, 5.0), (3, 10.0, 0.0), (4, 10.0, 3.0), (5, 9.0, 3.0)], "i int, q double, m double")
    out = values(df.select("i", numbers.moq_round_up(F.col("q"), F.col("m")).alias("v")).orderBy("i"), "v")
    assert out == [0, 0, 10, 12, 9]


def test_like_wildcard_and_literal_words(spark):
    df = spark.createDataFrame([(1, "x wh"), (2, "xwh"), (3, "wh x"), (4, "x_wh")], "i int, n string")
    like = values(df.select("i", locations.is_warehouse(F.col("n"), "alerts").alias("v")).orderBy("i"), "v")
    plan = values(df.select("i", locations.is_warehouse(F.col("n"), "plan").alias("v")).orderBy("i"), "v")
    # In LIKE the underscore stands for any one character, so "xwh" matches too.
    assert like == [True, True, False, True]
    assert plan == [True, False, True, True]


def test_units(spark):
    rows = [(1, 2.0, "kg", "flour"), (2, 1.0, "Tsp.", "salt"), (3, 3.0, "bag", "rice"), (4, 4.0, None, "soy sauce"), (5, None, "kg", "x"), (6, 5.0, None, "nut")]
    df = spark.createDataFrame(rows, "i int, q double, u string, n string")
    value, unit = units.standardise(F.col("q"), F.col("u"), F.col("n"))
    out = [tuple(r) for r in df.select("i", value.alias("v"), unit.alias("u")).orderBy("i").collect()]
    assert out == [(1, 2000.0, "g"), (2, 4.929, "ml"), (3, 3.0, "bag"), (4, 4.0, "ml"), (5, 0.0, "g"), (6, 5.0, "g")]


def test_keep_last_breaks_ties_and_keeps_null_keys(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 5), ("a", 2, 7), (None, 1, 1), (None, 3, 2)], "k string, t int, v int")
    out = {r.k: r.v for r in cl.keep_last(df, ["k"], ["t", "v"]).collect()}
    assert out == {"a": 7, None: 2}


def test_strip_strings_turns_missing_into_blank(spark):
    df = spark.createDataFrame([(" a ", 1), ("NaN", 2), (None, 3)], "s string, i int")
    assert values(text.strip_strings(df).orderBy("i"), "s") == ["a", "", ""]


def test_clean_orders(spark):
    rows = [("1", "Delivered", "2024-01-01 00:00:00", 1), ("1", "done", "2024-01-02 00:00:00", 2), ("2", "void", "2024-01-01 00:00:00", 1), (" ", "done", "x", 1)]
    df = spark.createDataFrame(rows, "order_id string, status string, created_at string, v int")
    out = cl.clean_orders(df, ["v"]).select("order_id", "v", F.date_format("created_at", "HH:mm").alias("t")).collect()
    assert [tuple(r) for r in out] == [("1", 2, "05:30")]


def test_clean_masters(spark):
    menu = spark.createDataFrame([("1", " Egg  Roll ", "x", "9")], "id string, name string, active string, price string")
    assert tuple(cl.clean_menu(menu, ["name"]).select("name", "active", "price").first()) == ("egg roll", 0, 9.0)
    recipe = spark.createDataFrame([("D", "I", "2", "1.7"), ("D", "J", "0", "1")], "dish_name string, ingredient string, qty_per_portion string, yield_factor string")
    assert [tuple(r) for r in cl.clean_recipes(recipe, ["qty_per_portion"]).select("ingredient", "yield_factor").collect()] == [("i", 1.0)]
    vendor = spark.createDataFrame([("A & B Foods Ltd", "x", "bad", None, "1")], "vendor_name string, ingredient string, lead_time_days string, moq string, price string")
    assert tuple(cl.clean_vendors(vendor, ["ingredient"]).select("vendor_id", "lead_time_days", "moq").first()) == ("V-ABFOODSLTD", 3, 1.0)
    stock = spark.createDataFrame([("k", "0", "2024-01-05 10:00:00"), ("k", "-1", "2024-01-05 10:00:00")], "kitchen string, qty_available string, snapshot_time string")
    assert [str(r.snapshot_date) for r in cl.clean_stock(stock).collect()] == ["2024-01-05"]
    items = spark.createDataFrame([("1", " A  b", "2"), ("1", "A b", "3"), ("2", "c", "zero")], "id string, item_name string, quantity string")
    assert [tuple(r) for r in cl.clean_items(items, ["quantity"]).select("id", "item_name", "quantity").collect()] == [("1", "a b", 3.0)]


def test_missing_dates_of_an_empty_feed(spark):
    df = spark.createDataFrame([], "d date")
    assert cl.missing_dates(df, "d").count() == 0
