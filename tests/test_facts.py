import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from larder.session import clear_scratch, scratch_path, scratch_scope
from larder.sources import facts, sinks
from larder.sources.roles import Roles

SCHEMA = "date date, k string, v long"


def day(month, n):
    return dt.date(2024, month, n)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def stored(spark):
    path = scratch_path(spark, "fact")
    held = spark.createDataFrame(
        [(day(1, 5), "a", 1), (day(2, 1), "a", 2), (day(2, 29), "b", 3), (day(3, 1), "a", 4), (day(12, 31), "a", 5), (None, "a", 6)], SCHEMA
    )
    facts.store_fact(held, path)
    return held, path


def test_windows_of_a_stored_fact(spark, stored):
    held, path = stored
    assert rows(facts.read_fact(spark, path, held.schema)) == rows(held)
    for since, until in ((None, day(2, 1)), (day(2, 1), day(2, 29)), (day(3, 1), None), (day(4, 1), day(4, 2))):
        bounds = [None if b is None else F.lit(b) for b in (since, until)]
        inside = [r for r in held.collect() if r.date and (not since or r.date >= since) and (not until or r.date <= until)]
        assert rows(facts.read_fact(spark, path, held.schema, *bounds)) == sorted(map(tuple, inside), key=repr)


def test_refresh_rewrites_the_months_of_its_window_alone(spark, stored):
    held, path = stored

    def files():
        listed = facts.read_fact(spark, path, held.schema).inputFiles()
        return {f for f in listed if "month=2024-02-01" not in f and "month=2024-03-01" not in f}

    before = files()
    new = spark.createDataFrame([(day(2, 10), "c", 10), (day(2, 29), "b", 30), (day(4, 1), "x", 99)], SCHEMA)
    for _ in range(2):
        facts.refresh_fact(new, path, day(2, 2), day(3, 1))
        found = rows(facts.read_fact(spark, path, held.schema))
        assert found == sorted(
            [(day(1, 5), "a", 1), (day(2, 1), "a", 2), (day(2, 10), "c", 10), (day(2, 29), "b", 30), (day(12, 31), "a", 5), (None, "a", 6)], key=repr
        )
    assert files() == before
    assert not sinks.path_exists(spark, f"{path}/month=2024-03-01")
    facts.refresh_fact(new.limit(0), path, day(12, 1), day(12, 31))
    assert not sinks.path_exists(spark, f"{path}/month=2024-12-01")


def test_a_window_prunes_months_by_a_subquery(spark):
    r = Roles(spark, "/root/testdata/sf0.001").by_month()
    week = r.daily_sales("fine", since=F.date_sub(r.ship_as_of, 7))
    plan = week._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "daily-fact" in line and "qty_sold" in line]
    assert scans and all(re.search(r"PartitionFilters: \[[^\]]*month", line) for line in scans), plan
    # The subquery's months, not all of them, are opened.
    literal = r.spark.range(1).select(r.ship_as_of).first()[0]
    read = facts.read_fact(spark, r._fact[0], r._fact[1], F.lit(literal - dt.timedelta(days=7)))
    whole = facts.read_fact(spark, r._fact[0], r._fact[1])
    assert rows(week.select("date", "qty_sold")) == rows(read.select("date", "qty_sold"))
    opened = read.select(F.input_file_name().alias("f")).distinct().count()
    assert opened <= 4 < whole.select(F.input_file_name().alias("f")).distinct().count()


def test_roles_by_month_are_the_same(spark):
    r = Roles(spark, "/root/testdata/sf0.001")
    m = r.by_month()
    for grain in ("coarse", "mid", "fine"):
        bounds = {"since": F.date_sub(r.ship_as_of, 90), "until": F.date_sub(r.ship_as_of, 30)}
        assert rows(m.daily_qty(grain, **bounds)) == rows(r.daily_qty(grain, **bounds))
    assert rows(m.history()) == rows(r.history())


def test_a_batch_delivered_again_adds_nothing(spark):
    path, key = scratch_path(spark, "t"), ["date", "k"]
    first = spark.createDataFrame([(day(1, 1), "a", 1), (day(1, 2), "a", 2)], SCHEMA)
    second = spark.createDataFrame([(day(1, 2), "a", 9), (day(1, 2), "b", 8), (day(1, 2), "b", 7), (day(1, 3), "c", 3)], SCHEMA)
    for batch in (first, second, second, first):
        sinks.insert_new_path(batch, path, key, "date", ["v"])
    expected = [("a", 1), ("a", 2), ("b", 7), ("c", 3)]
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("k", "v").collect()) == expected
    with pytest.raises(ValueError):
        sinks.insert_new_path(first, path, ["k"], "date", ["v"])


def test_scratch_tables_end_with_their_scope(spark):
    kept = sinks.round_trip(spark.range(3), "kept")
    with pytest.raises(RuntimeError), scratch_scope(spark):
        outer = sinks.round_trip(spark.range(3), "outer")
        with scratch_scope(spark):
            inner = sinks.round_trip(spark.range(3), "inner")
            assert spark.read.parquet(inner).count() == 3
        assert sinks.path_exists(spark, outer) and not sinks.path_exists(spark, inner)
        raise RuntimeError
    assert sinks.path_exists(spark, kept) and not sinks.path_exists(spark, outer)
    other = kept.replace(spark.sparkContext.applicationId, "another-application")
    spark.range(3).write.parquet(other)
    clear_scratch(spark)
    assert not sinks.path_exists(spark, kept) and sinks.path_exists(spark, other)
