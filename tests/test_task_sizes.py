"""Shuffles of all order lines hold a bounded number of them per task, and feeds read their role once."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from larder.operators import purchasing
from larder.plans import alerts
from larder.session import scratch_path
from larder.sources import roles
from larder.sources.roles import Roles
from larder.suite import planning

LINES, BOUND = 3000, 100


@pytest.fixture(scope="module")
def folder(spark):
    at, day = scratch_path(spark, "tables"), dt.datetime(2024, 1, 1)
    nation, region = [(0, "N0", 0), (1, "N1", 0)], [(0, "R0")]
    tables = {
        "nation": (nation, "n_nationkey int, n_name string, n_regionkey int"),
        "region": (region, "r_regionkey int, r_name string"),
        "customer": ([(i, i % 2, "seg") for i in range(5)], "c_custkey long, c_nationkey int, c_mktsegment string"),
        "supplier": ([(i, f"S{i}", i % 2) for i in range(4)], "s_suppkey long, s_name string, s_nationkey int"),
        "part": ([(i, f"p{i}", "B", "T", 3, 1.0) for i in range(20)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        "orders": (
            [(i, i % 5, "O", 1.0, day + dt.timedelta(days=i % 40)) for i in range(600)] + [(None, 1, "O", 1.0, day)],
            "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz",
        ),
        "lineitem": (
            [
                (i % 600 if i % 97 else None, i * 7 % 20 if i % 89 else None, i % 4, i % 5, i % 3 / 8, float(i % 11), "R", "OF"[i % 2], day + dt.timedelta(days=i % 60))
                for i in range(LINES)
            ],
            "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
        ),
    }
    for name, (rows_, schema) in tables.items():
        spark.createDataFrame(rows_, schema).coalesce(1).write.parquet(f"{at}/{name}.parquet")
    return at


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def figures(r):
    since = F.lit(dt.date(2024, 2, 1))
    return {
        "fact": rows(r.daily_fact()), "pos": rows(r.open_pos()), "receipts": rows(r.grn_log()),
        "overage": rows(purchasing.receipt_overage(r.open_pos(), r.grn_log(), since)),
        "on time": rows(purchasing.vendor_on_time(r.open_pos(), r.grn_log())),
        "pairs": rows(purchasing.pairs_per_order(r.open_pos(), r.grn_log())),
    }


def test_partitions_of_lines_are_bounded_and_change_no_row(spark, folder, monkeypatch):
    whole = figures(Roles(spark, folder))
    assert all(whole.values())
    monkeypatch.setattr(roles, "LINES_PER_TASK", BOUND, raising=False)
    assert figures(Roles(spark, folder)) == whole
    for role in ("open_pos", "grn_log"):
        sizes = getattr(Roles(spark, folder), role)().groupBy(F.spark_partition_id().alias("p")).count()
        assert max(r["count"] for r in sizes.collect()) <= 3 * BOUND


def test_overage_needs_both_sides_and_multiplies_counts(spark):
    pos = spark.createDataFrame([("1", "a", 2.0), ("1", "a", 3.0), ("2", "a", 1.0), (None, "a", 1.0), ("4", None, 1.0)], "po_number string, ingredient string, qty_ordered double")
    day = dt.date(2024, 1, 1)
    receipts = spark.createDataFrame(
        [("1", "a", day, 9.0), ("1", "a", day, None), ("3", "a", day, 50.0), (None, "a", day, 50.0), ("4", None, day, 50.0)],
        "po_number string, ingredient string, received_date date, qty_received double",
    )
    out = purchasing.receipt_overage(pos, receipts, F.lit(day))
    assert rows(out) == [("a", 18.0, 10.0, 8.0)]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_versions_of_a_feed_come_from_one_pass(spark, folder):
    fed = planning.feeds(Roles(spark, folder))
    for feed in (fed.pos, fed.stock, fed.items):
        assert "Union" not in feed._jdf.queryExecution().optimizedPlan().toString()
        assert {r.version for r in feed.select("version").distinct().collect()} == {1, 2}
    assert {r.vendor for r in fed.pos.where("version = 1").select("vendor").distinct().collect()} == {"7"}


def test_stockouts_look_at_sold_pairs_only(spark):
    stock = spark.createDataFrame(
        [("K", "a", dt.date(2024, 1, 1), 5.0), ("K", "a", dt.date(2024, 1, 2), 0.0), ("K", "b", dt.date(2024, 1, 2), 0.0), ("k", "c", dt.date(2024, 1, 1), 0.0), ("k", "c", dt.date(2024, 1, 2), 1.0)],
        "kitchen string, ingredient string, snapshot_date date, qty_available double",
    )
    sold = spark.createDataFrame([("k", "a"), ("K", "c")], "outlet string, sku string")
    skus = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "sku_code string, sku_name string")
    out = alerts.kitchen_stockout(stock, sold, skus)
    assert [(r.sku, r.outlet) for r in out.collect()] == [("A", "K")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("LeftSemi")


def test_stock_shuffles_no_lines_to_reach_small_tables(spark, folder):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        plan = Roles(spark, folder).kitchen_stock()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan
