import datetime as dt

from pyspark.sql import functions as F

from larder.operators import purchasing, recipes
from larder.plans import alerts, variance

DAY = dt.date(2026, 7, 16)


def frames(spark, sold=3.0, actual=90.0, option=None, alias=None):
    items = spark.createDataFrame([(1, "Palak Khichdi", option, sold)], "order_id int, item_name string, option_names string, quantity double")
    orders = spark.createDataFrame([(1, DAY, " Khichdi Tales ")], "id int, order_date date, store_name string")
    alias = spark.createDataFrame(
        alias or [("Palak Khichdi", None, "Dish A", 1.0, None), ("Palak Khichdi", None, "Dish B", 1.0, None)],
        "pos_name string, pos_option string, recipe_name string, multiplier double, additive_offset double",
    )
    recipe = spark.createDataFrame(
        [("Dish A", "CODE9", 100.0, "g"), ("Dish B", "CODE9", 1.0, "g")],
        "dish_name string, ingredient string, qty_per_unit double, unit string",
    )
    # The same code twice: must not fan out.
    skus = spark.createDataFrame([("code9", "Fake Item"), ("CODE9", "Fake Item")], "sku_code string, sku_name string")
    ingredients = spark.createDataFrame([], "sku string, name string")
    sales = spark.createDataFrame([(DAY, "khichdi tales", "FAKE item", actual)], "date date, outlet string, sku string, qty_sold double")
    return recipes.expected_usage(items, orders, alias, recipe, skus, ingredients), recipes.actual_usage(sales)


def test_golden_two_recipes_of_one_ingredient(spark):
    rows = variance.report(*frames(spark)).collect()
    assert len(rows) == 1
    assert (rows[0].expected_qty, rows[0].actual_qty, rows[0].variance_qty) == (303.0, 90.0, -213.0)
    shown = variance.report(*frames(spark), display=True).first()
    assert (shown.outlet, shown.ingredient) == ("Khichdi Tales", "Fake Item")


def test_exact_and_general_alias_both_match(spark):
    alias = [("Palak Khichdi", None, "Dish A", 1.0, 0.0), ("Palak Khichdi", "Large", "Dish A", 0.5, 2.0)]
    large = variance.report(*frames(spark, option="Large", alias=alias)).first().expected_qty
    none = variance.report(*frames(spark, option=None, alias=alias)).first().expected_qty
    assert (large, none) == (3 * 100 + 3 * 50 + 2, 300.0)


def test_percent_of_nothing(spark):
    e = spark.createDataFrame([(DAY, "o", "both", "g", 5.0), (DAY, "o", "zero", "g", 0.0)], "date date, outlet string, ingredient string, unit string, expected_qty double")
    a = spark.createDataFrame([(DAY, "o", "extra", 5.0), (DAY, "o", "zero", 0.0)], "date date, outlet string, ingredient string, actual_qty double")
    out = {r.ingredient: (r.variance_pct, r.unit) for r in variance.report(e, a).collect()}
    assert out == {"both": (-100.0, "g"), "extra": (100.0, "units")}
    settings = spark.createDataFrame([], "ingredient string, green_threshold double, yellow_threshold double")
    known = spark.createDataFrame([("both",)], "ingredient string")
    flags = {r.ingredient: (r.flag, r.variance_pct) for r in variance.flagged(variance.report(e, a), settings, known).collect()}
    assert flags == {"both": ("red", -100.0), "extra": ("unmapped", None)}


def test_alert_dedup_and_resolution(spark):
    log = spark.createDataFrame(
        [("1", "A", "s", "o", None, 0), ("2", "B", "s", "o", "", 1)],
        "alert_id string, alert_type string, sku string, outlet string, ingredient string, resolved int",
    )
    new = spark.createDataFrame([("A", "s", "o", None), ("B", "s", "o", ""), ("A", "s", "o", "x")], "alert_type string, sku string, outlet string, ingredient string")
    left = {tuple(r) for r in alerts.suppress_known(new, log).collect()}
    assert left == {("B", "s", "o", ""), ("A", "s", "o", "x")}
    edits = spark.createDataFrame([("1", dt.datetime(2024, 1, 1))], "alert_id string, resolved_at timestamp_ntz")
    done = {r.alert_id: r.resolved for r in alerts.resolve(log, edits).collect()}
    assert done == {"1": 1, "2": 1}


def test_alert_ids_are_stable_and_unique(spark):
    pos = spark.createDataFrame([("P1", "i", dt.date(2024, 1, 1), "open"), ("P2", "i", dt.date(2024, 1, 1), "open")], "po_number string, ingredient string, expected_date date, status string")
    day = F.lit("2024-02-01").cast("date")
    first, again = (alerts.stamped(alerts.po_overdue(pos, day), day) for _ in range(2))
    ids = {r.alert_id for r in first.collect()}
    assert len(ids) == 2 and ids == {r.alert_id for r in again.collect()}


def test_zero_base_is_a_spike(spark):
    sales = spark.createDataFrame([("s", "o", 0.0)], "sku string, outlet string, qty_sold double")
    ahead = spark.createDataFrame([("s", "o", 2.0)], "sku string, outlet string, qty_predicted double")
    assert "inf" in alerts.demand_spike(sales, ahead).first().message


def brute_on_time(pos, grn):
    out = {}
    for po, vendor, expected in pos:
        for g, number, received in grn:
            if g == po and number:
                total, ok = out.get(vendor, (0, 0))
                out[vendor] = (total + 1, ok + bool(expected and received and received <= expected))
    return out


def test_on_time_pairs_are_counted_like_a_join(spark):
    day = lambda n: dt.date(2024, 1, n)
    pos = [("P", "v", day(5)), ("P", "v", day(5)), ("P", "w", None), ("P", "v", day(2)), ("Q", "v", day(1)), ("R", "z", day(1))]
    grn = [("P", "g1", day(2)), ("P", "g2", day(5)), ("P", "g3", day(6)), ("P", "g4", None), ("P", "", day(1)), ("Q", "g5", day(1))]
    p = spark.createDataFrame(pos, "po_number string, vendor string, expected_date date")
    g = spark.createDataFrame(grn, "po_number string, grn_number string, received_date date")
    got = {r.vendor: (r.total_orders, r.on_time) for r in purchasing.vendor_on_time(p, g).collect()}
    assert got == brute_on_time(pos, grn)
    pairs = {r.vendor: 0 for r in p.collect()}
    for r in purchasing.pairs_per_order(p, g).collect():
        pairs[r.vendor] += r.pairs
    assert {v: n for v, n in pairs.items() if n} == {v: t for v, (t, _) in brute_on_time(pos, grn).items()}


def test_overage_equals_the_joined_sums(spark):
    pos = spark.createDataFrame([("P", "i", 4.0), ("P", "i", 1.0), ("Q", "i", 2.0)], "po_number string, ingredient string, qty_ordered double")
    grn = spark.createDataFrame([("P", "i", 9.0, DAY), ("P", "i", 3.0, DAY), ("Q", "i", 2.0, DAY)], "po_number string, ingredient string, qty_received double, received_date date")
    row = purchasing.receipt_overage(pos, grn, F.lit("2026-01-01").cast("date")).first()
    joined = grn.join(pos, ["po_number", "ingredient"]).agg(F.sum("qty_received"), F.sum("qty_ordered")).first()
    assert (row.total_received, row.total_ordered) == tuple(joined)
