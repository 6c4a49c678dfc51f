import datetime as dt

from pyspark.sql import functions as F

from larder.session import scratch_path
from larder.streaming import incremental as inc

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


def landed(spark, files=4):
    """Events as several files, out of time order and with repeated deliveries."""
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(hours=(i * 37) % 400), i % 5, ["error", "view"][i % 2], i % 11 + 0.25) for i in range(200)]
    folder = scratch_path(spark, "feed")
    for n in range(files):
        spark.createDataFrame(rows[n::files] + rows[:10], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
    return folder, spark.read.parquet(f"{folder}/events.parquet")


def stream(spark, folder):
    return inc.file_stream(spark, folder, "events", spark.read.parquet(f"{folder}/events.parquet").schema, max_files=1)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_windows_equal_batch(spark):
    folder, batch = landed(spark)
    for op in (inc.tumbling_sales, inc.sliding_mean):
        windows = op(stream(spark, folder), "ts", "event_type", "value", delay="30 days")
        assert rows(inc.run_aggregate(spark, windows, "event_type")) == rows(op(batch, "ts", "event_type", "value"))


def test_closed_windows_leave_the_state(spark):
    """Twenty daily files: late rows within the delay count, and the state holds the open windows only."""
    base, folder = dt.datetime(2024, 1, 1), scratch_path(spark, "feed")
    days = [[(n * 10 + k, base + dt.timedelta(days=n, hours=k * 2 - (10 if k == 9 else 0)), 1, "view", 1.0) for k in range(10)] for n in range(20)]
    days[10].append((999, base + dt.timedelta(days=9, hours=23), 1, "view", 1.0))  # a day late
    for n in days:
        spark.createDataFrame(n, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
    windows = inc.tumbling_sales(stream(spark, folder), "ts", "event_type", "value")
    progress = inc.drain(windows, lambda b, _: b.count(), scratch_path(spark, "ck"), mode="update")
    assert max(p.stateOperators[0].numRowsTotal for p in progress) <= 4
    table = inc.run_aggregate(spark, inc.tumbling_sales(stream(spark, folder), "ts", "event_type", "value"), "event_type")
    assert rows(table) == rows(inc.tumbling_sales(spark.read.parquet(f"{folder}/events.parquet"), "ts", "event_type", "value"))


def test_upsert_keeps_newest_whatever_the_arrival_order(spark):
    folder, batch = landed(spark)
    got = inc.run_upsert(spark, stream(spark, folder), ["user_id", "event_type"], "event_type", ["ts", "event_id"])
    want = batch.groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id")).alias("m"))
    assert rows(got.select("user_id", "event_type", "event_id")) == rows(want.select("user_id", "event_type", "m.event_id"))


def test_insert_new_has_one_row_per_key(spark):
    folder, batch = landed(spark)
    got = inc.run_insert_new(spark, stream(spark, folder), ["event_id"], ["ts"])
    assert got.count() == 200 and rows(got) == rows(batch.distinct())


def test_alerts_open_once_and_again_after_they_were_resolved(spark):
    """Five batches against a walk over the rows; the state holds open alerts only."""
    base, folder = dt.datetime(2024, 1, 1), scratch_path(spark, "feed")
    schema = "alert_id string, alert_type string, sku string, outlet string, ingredient string, created_at timestamp, resolved int"
    batches = [
        [(f"{n}-{k:02}", "low", "s", f"o{k % 4}", None, base + dt.timedelta(days=n, minutes=(k * 7) % 20), int((k * 5 + n) % 3 == 0)) for k in range(20)]
        for n in range(5)
    ]
    batches.append([("9", "low", "s", f"o{k}", None, base + dt.timedelta(days=9), 1) for k in range(4)])
    is_open, expected = set(), []
    for rows_ in batches:
        for r in sorted(rows_, key=lambda r: (r[5], r[0])):
            if r[6]:
                is_open.discard(r[3])
            elif r[3] not in is_open:
                is_open.add(r[3])
                expected.append(r[0])
        spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
    got = inc.run_alert_dedup(spark, stream(spark, folder))
    assert sorted(r.alert_id for r in got.collect()) == sorted(expected) and len(expected) > 8
    progress = inc.drain(inc.raised_alerts(stream(spark, folder)), lambda b, _: b.count(), scratch_path(spark, "ck"))
    assert len(progress) >= 6 and progress[-1].stateOperators[0].numRowsTotal == 0


def test_alerts_call_python_per_bucket_not_per_key(spark):
    """Three batches of 60 keys, some with empty parts; the state has an entry per bucket, the log an alert per key that opens."""
    base, folder = dt.datetime(2024, 1, 1), scratch_path(spark, "feed")
    schema = "alert_id string, alert_type string, sku string, outlet string, ingredient string, created_at timestamp, resolved int"
    for n, resolved in enumerate([0, 0, 1, 0]):
        rows_ = [(f"{n}-{k:02}", ["low", None][k % 2], "s", f"o{k}" if k else None, None, base + dt.timedelta(days=n), resolved if k < 20 else 0) for k in range(60)]
        spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
    got = [r.alert_id for r in inc.run_alert_dedup(spark, stream(spark, folder)).collect()]
    assert sorted(got) == [f"0-{k:02}" for k in range(60)] + [f"3-{k:02}" for k in range(20)]
    progress = inc.drain(inc.raised_alerts(stream(spark, folder), buckets=5), lambda b, _: b.count(), scratch_path(spark, "ck"))
    assert 0 < progress[-1].stateOperators[0].numRowsTotal <= 5


def test_watermarked_dedup_of_an_ordered_feed(spark):
    folder, _ = landed(spark, files=1)
    out = scratch_path(spark, "dedup")
    deduped = inc.drop_late_duplicates(stream(spark, folder), "ts", ["event_id"])
    inc.drain(deduped, lambda b, i: b.write.mode("append").parquet(out), scratch_path(spark, "ck"))
    assert spark.read.parquet(out).count() == 200


def test_month_and_fixed_chunks(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 20),), (dt.datetime(2024, 3, 2, 5),)], "ts timestamp_ntz")
    months = [tuple(map(str, r)) for r in inc.month_chunks(df, "ts").collect()]
    assert months == [("2024-01-01", "2024-02-01"), ("2024-02-01", "2024-03-01"), ("2024-03-01", "2024-03-03")]
    fixed = [tuple(map(str, r)) for r in inc.fixed_chunks(df, "ts").collect()]
    assert fixed[0] == ("2024-01-20", "2024-02-04") and fixed[-1][1] == "2024-03-03"
    sizes = rows(inc.chunk_sizes(df, "ts").select(F.col("chunk_start").cast("string"), "n"))
    assert sizes == [("2024-01-20", 1), ("2024-02-19", 1)]


def test_reload_of_an_empty_sink_takes_everything(spark):
    _, batch = landed(spark)
    empty = batch.limit(0)
    assert inc.newer_than(batch, "ts", empty.select(F.max("ts")).scalar()).count() == batch.count()
    assert inc.overlap_reload(batch, empty, "ts", ["event_id"], ["ts"]).count() == 200


def timed(spark, rows_):
    return spark.createDataFrame([(i, dt.datetime(2024, 1, 1) + dt.timedelta(days=d), n) for i, d, n in rows_], "id long, ts timestamp_ntz, note string")


def load(source, folder, **more):
    inc.run_backfill(source, folder, "ts", ["id"], ["note"], days=5, wave=2, **more)


def test_a_broken_backfill_goes_on_and_equals_one_load(spark):
    source = timed(spark, [(i, (i * 7) % 33, "b") for i in range(60)] + [(i, (i * 7) % 33, "a") for i in range(0, 60, 3)])
    broken, whole = scratch_path(spark, "backfill"), scratch_path(spark, "backfill")
    load(source, broken, waves=1)
    states = [r.state for r in inc.backfill_ledger(spark, broken).orderBy("chunk_start").collect()]
    assert states == ["loaded"] * 2 + ["planned"] * 5
    load(source, broken)
    load(source, whole)
    got, want = inc.backfill_rows(source, broken), inc.backfill_rows(source, whole)
    assert rows(got) == rows(want) and got.count() == 60 and got.where("note = 'a'").count() == 20
    assert rows(inc.backfill_ledger(spark, broken)) == rows(inc.backfill_ledger(spark, whole))
    assert inc.plan_backfill(source, broken, "ts", 5) == []


def test_newer_days_extend_the_last_chunk_and_loaded_ones_are_left_alone(spark):
    folder = scratch_path(spark, "backfill")
    load(timed(spark, [(1, 0, "x"), (2, 6, "x")]), folder)
    # The source has changed inside a loaded chunk: not read again. Day 9 moves the end of the last one, day -3 is older than the first.
    grown = timed(spark, [(1, 0, "changed"), (2, 6, "x"), (3, 9, "x"), (4, 12, "x"), (5, -3, "x")])
    load(grown, folder)
    assert sorted((r.id, r.note) for r in inc.backfill_rows(grown, folder).collect()) == [(1, "x"), (2, "x"), (3, "x"), (4, "x"), (5, "x")]
    ends = [(str(r.chunk_start), str(r.chunk_end), r.n) for r in inc.backfill_ledger(spark, folder).orderBy("chunk_start").collect()]
    assert ends == [("2023-12-27", "2024-01-01", 1), ("2024-01-01", "2024-01-06", 1), ("2024-01-06", "2024-01-11", 2), ("2024-01-11", "2024-01-14", 1)]


def test_a_key_that_moves_between_chunks_stays_in_the_first(spark):
    source, folder = timed(spark, [(1, 0, "x"), (1, 11, "y"), (2, 12, "x"), (1, 22, "z")]), scratch_path(spark, "backfill")
    load(source, folder, key_moves=True)
    assert sorted((r.id, r.note) for r in inc.backfill_rows(source, folder).collect()) == [(1, "x"), (2, "x")]


def test_backfill_of_nothing(spark):
    folder, empty = scratch_path(spark, "backfill"), timed(spark, [(1, 0, "x")]).limit(0)
    load(empty, folder)
    assert inc.plan_backfill(empty, folder, "ts", 5) == []


def test_late_rows_wait_in_a_side_table_and_none_is_lost(spark):
    """Four files: redelivered rows, rows late by days, one late row of a stored key and one late twice."""
    base, folder = dt.datetime(2024, 1, 1), scratch_path(spark, "feed")
    row = lambda i, day: (i, base + dt.timedelta(days=day), 1, "view", float(i))
    files = [
        [row(1, 0), row(2, 1), row(2, 1)],
        [row(3, 4), row(2, 1)],  # a day behind is still in time
        [row(4, 6), row(5, 2), row(1, 0)],  # 5 is late, 1 late and stored
        [row(6, 7), row(5, 2), row(7, 3), (8, None, 1, "view", 8.0)],
    ]
    for rows_ in files:
        spark.createDataFrame(rows_, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
    source = stream(spark, folder)
    out = inc.run_overlap_load(spark, source, "ts", ["event_id"], ["ts"])
    late = inc.late_rows(spark, out, source.schema)
    assert sorted((r.event_id, r.batch) for r in late.collect()) == [(1, 2), (5, 2), (5, 3), (7, 3)]
    for _ in range(2):  # a repeated merge changes nothing
        merged = inc.merge_late(spark, out, source.schema, ["event_id"], ["ts"])
        assert sorted(r.event_id for r in merged.collect()) == [1, 2, 3, 4, 5, 6, 7, 8]
