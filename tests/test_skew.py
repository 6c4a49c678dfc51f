"""One key holding most of the rows must not gather in one task, and results stay whole."""

from pyspark.sql import functions as F

from larder.operators import cleaning as cl, sales, series
from larder.operators.skew import hot_keys, salted_join


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def hot(spark, n=300_000):
    """Two thirds of the rows carry key 0."""
    return spark.range(0, n, 1, 8).select(
        F.when(F.col("id") % 3 < 2, F.lit(0)).otherwise(F.col("id")).alias("order_id"), F.col("id").alias("v")
    )


def test_dedup_is_cut_before_the_shuffle(spark):
    df = cl.keep_last(hot(spark), ["order_id"], ["v"])
    plan = plan_of(df)
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan
    rows = df.collect()
    assert len(rows) == 100_001 and max(r.v for r in rows if r.order_id == 0) == 299_998


def test_hot_order_is_split_by_the_join(spark):
    items = hot(spark).select("order_id", F.lit("dish").alias("item_name"), F.col("v").alias("quantity"))
    orders = spark.range(0, 300_000, 1, 8).where("id = 0 or id % 3 = 2").withColumn("store_name", F.col("id").cast("string"))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        joined = sales.order_item_join(items, orders)
        assert len(joined.collect()) == 300_000
        assert "isSkew=true" in plan_of(joined) or "skewed" in plan_of(joined)
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_salted_join_equals_the_join_and_spreads_the_hot_key(spark):
    fact = hot(spark, 3000)
    lookup = hot(spark, 1500).select("order_id").distinct().withColumn("name", F.col("order_id").cast("string"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        got, want = salted_join(fact, lookup, ["order_id"], how), fact.join(lookup, "order_id", how)
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    salts = fact.where("order_id = 0").groupBy(F.pmod(F.xxhash64(*fact.columns), F.lit(16))).count().collect()
    assert len(salts) == 16 and max(r["count"] for r in salts) < 300


def test_measured_salts_copy_the_hot_keys_alone(spark):
    fact = hot(spark, 3000).withColumn("order_id", F.when(F.col("v") % 10 != 1, F.col("order_id")))
    lookup = fact.select("order_id").where("v < 1500").distinct().withColumn("name", F.col("order_id").cast("string"))
    keys = hot_keys(fact, ["order_id"])
    named = spark.range(1).select(F.sort_array(keys).alias("k")).first().k
    assert [row.order_id for row in named] == [None, 0]  # a NULL key is spread too
    for how in ("inner", "left", "left_semi", "left_anti"):
        got, want = salted_join(fact, lookup, ["order_id"], how, hot=keys), fact.join(lookup, "order_id", how)
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    empty = fact.limit(0)
    assert salted_join(empty, lookup, ["order_id"], hot=hot_keys(empty, ["order_id"])).count() == 0


def test_dwell_times_of_a_hot_entity_match_one_window(spark):
    base = F.lit("2024-01-01").cast("timestamp_ntz")
    events = spark.range(0, 5000, 1, 4).select(
        F.when(F.col("id") % 3 < 2, F.lit(7)).otherwise(F.col("id") % 11).alias("user_id"),
        F.col("id").alias("event_id"),
        (base + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("id") * 7919 % 90_000).cast("decimal(18,6)") * 13)).alias("ts"),
        (F.col("id") % 4).cast("string").alias("event_type"),
    )
    got = series.dwell_times(events, "user_id", "ts", "event_type", "event_id")
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    want = events.select(
        "user_id", "event_id", F.col("event_type").alias("from_state"), F.lead("event_type").over(w).alias("to_state"),
        F.timestamp_diff("SECOND", "ts", F.lead("ts").over(w)).alias("dwell_seconds"),
    ).where("to_state is not null")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
