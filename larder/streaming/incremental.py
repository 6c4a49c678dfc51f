"""Incremental loads, batch and streaming.

Streams read files, run with the ``availableNow`` trigger and write through
``foreachBatch``. A micro-batch may be replayed after a failure, so every sink
is keyed: it either overwrites what the same batch wrote or keeps the newest
version per key.
"""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from larder.operators.cleaning import keep_first
from larder.plans.alerts import KEY as ALERT_KEY
from larder.session import checkpointed, scratch_path
from larder.sources.sinks import in_partitions, insert_new, path_exists, upsert_path

OVERLAP_DAYS = 1
CHUNK_DAYS = 15


def newer_than(source: DataFrame, time: str, high_water: Column) -> DataFrame:
    """Source rows past the sink's newest time; everything while the sink is empty."""
    return source.where(high_water.isNull() | (F.col(time) > high_water))


def overlap_reload(source: DataFrame, sink: DataFrame, time: str, key: list[str], order: list[str]) -> DataFrame:
    """Sink plus the unseen rows of a window that starts a day before its newest time."""
    start = sink.select(F.max(time)).scalar() - F.expr(f"INTERVAL {OVERLAP_DAYS} DAY")
    window = source.where(start.isNull() | (F.col(time) >= start))
    return insert_new(sink, keep_first(window, key, order), key)


def fixed_chunks(df: DataFrame, time: str, days: int = CHUNK_DAYS) -> DataFrame:
    """Bounds of consecutive chunks of ``days`` over the span of ``df``, end exclusive."""
    span = df.agg(F.to_date(F.min(time)).alias("lo"), F.date_add(F.to_date(F.max(time)), 1).alias("hi"))
    step = F.make_dt_interval(F.lit(days))
    starts = span.where(F.col("lo").isNotNull()).select(
        "hi", F.explode(F.sequence("lo", F.date_sub("hi", 1), step)).alias("chunk_start")
    )
    return starts.select("chunk_start", F.least(F.date_add("chunk_start", days), "hi").alias("chunk_end"))


def month_chunks(df: DataFrame, time: str) -> DataFrame:
    """Calendar months over the span of ``df``, the last cut at its end."""
    span = df.agg(F.to_date(F.min(time)).alias("lo"), F.date_add(F.to_date(F.max(time)), 1).alias("hi"))
    starts = span.where(F.col("lo").isNotNull()).select(
        "hi",
        F.explode(F.sequence(F.trunc("lo", "month"), F.date_sub("hi", 1), F.expr("INTERVAL 1 MONTH"))).alias("chunk_start"),
    )
    return starts.select("chunk_start", F.least(F.add_months("chunk_start", 1), "hi").alias("chunk_end"))


def chunk_sizes(df: DataFrame, time: str, days: int = CHUNK_DAYS) -> DataFrame:
    """Rows per chunk; the chunk of a row is computed, not joined."""
    lo = df.select(F.to_date(F.min(time))).scalar()
    index = F.floor(F.datediff(F.to_date(time), lo) / days)
    start = F.date_add(lo, (index * days).cast("int"))
    return df.groupBy(start.alias("chunk_start")).agg(F.count("*").alias("n"))


# -- a backfill that resumes ----------------------------------------------------

PLANNED, LOADED = "planned", "loaded"
LEDGER = T.StructType(
    [
        T.StructField("chunk_start", T.DateType()), T.StructField("chunk_end", T.DateType()),
        T.StructField("state", T.StringType()), T.StructField("n", T.LongType()),
    ]
)


def _replace_partitions(df: DataFrame, path: str, *partition: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def backfill_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """``chunk_start, chunk_end, state, n`` of every chunk planned so far; ``n`` is NULL until it is loaded."""
    return spark.read.schema(LEDGER).parquet(f"{folder}/ledger").select(*LEDGER.names)


def plan_backfill(source: DataFrame, folder: str, time: str, days: int = CHUNK_DAYS) -> list:
    """Note the chunks that ``source`` spans in the ledger and return those to load, oldest first.

    Chunks are counted from the first one ever planned, so bounds do not move
    between runs. A loaded chunk is left alone unless its end has moved, as that
    of the last one does when newer days have come. The driver holds one row per
    chunk of the calendar, whatever the number of rows.
    """
    spark = source.sparkSession
    span = source.agg(F.to_date(F.min(time)).alias("lo"), F.to_date(F.max(time)).alias("hi")).first()
    known = {}
    if path_exists(spark, f"{folder}/ledger"):
        known = {row.chunk_start: row for row in backfill_ledger(spark, folder).collect()}
    fresh = []
    if span.lo is not None:
        step, end = dt.timedelta(days=days), span.hi + dt.timedelta(days=1)
        anchor = min(known, default=span.lo)
        start = anchor + step * ((span.lo - anchor) // step)
        while start < end:
            if start not in known or known[start].chunk_end < min(start + step, end):
                fresh.append((start, min(start + step, end), PLANNED, None))
            start += step
    if fresh:
        _replace_partitions(spark.createDataFrame(fresh, LEDGER), f"{folder}/ledger", "chunk_start")
    again = {row[0] for row in fresh}
    left = [(r.chunk_start, r.chunk_end) for r in known.values() if r.state == PLANNED and r.chunk_start not in again]
    return sorted(left + [row[:2] for row in fresh])


def run_backfill(
    source: DataFrame, folder: str, time: str, key: list[str], order: list[str], days: int = CHUNK_DAYS,
    wave: int = 8, waves: int | None = None, key_moves: bool = False,
) -> None:
    """Load ``source`` into ``folder/rows`` chunk by chunk; a rerun goes on where the last one broke off.

    A wave of ``wave`` chunks is one scan: one row per key (the first by time,
    then ``order``) replaces the partitions of the wave's chunks, and only then
    does the ledger call them loaded. A break leaves planned chunks, which the
    next run writes again in whole. ``waves`` ends a run early. Rows without a
    time belong to no chunk and are not loaded.

    ``key_moves`` says that copies of a key may carry times of different chunks;
    the chunk loaded first then keeps it, which reads the keys of all chunks
    loaded before in every wave.
    """
    spark, rows = source.sparkSession, f"{folder}/rows"
    todo = plan_backfill(source, folder, time, days)
    if not todo:
        return
    anchor = F.lit(todo[0][0])
    start = F.date_add(anchor, (F.floor(F.datediff(F.to_date(time), anchor) / days) * days).cast("int"))
    kind = source.schema[time].dataType
    runs = [todo[at : at + wave] for at in range(0, len(todo), wave)]
    for chunks in runs[:waves]:
        starts = [chunk[0] for chunk in chunks]
        inside = (F.col(time) >= F.lit(starts[0]).cast(kind)) & (F.col(time) < F.lit(chunks[-1][1]).cast(kind))
        taken = source.where(inside).withColumn("chunk_start", start).where(F.col("chunk_start").isin(starts))
        fresh = keep_first(taken, key, [time, *order])
        if key_moves and path_exists(spark, rows):
            done = backfill_ledger(spark, folder).where((F.col("state") == LOADED) & ~F.col("chunk_start").isin(starts))
            stored = spark.read.schema(fresh.schema).parquet(rows).join(done.select("chunk_start"), "chunk_start", "left_semi")
            fresh = fresh.join(stored.select(*key), key, "left_anti").select(*fresh.columns)
        # Large chunks are split over tasks, small ones share one.
        _replace_partitions(fresh.hint("rebalance", "chunk_start"), rows, "chunk_start")
        counts = spark.read.schema(fresh.schema).parquet(rows).where(F.col("chunk_start").isin(starts)).groupBy("chunk_start").count()
        held = dict(tuple(row) for row in counts.collect())
        loaded = [(lo, hi, LOADED, held.get(lo, 0)) for lo, hi in chunks]
        _replace_partitions(spark.createDataFrame(loaded, LEDGER), f"{folder}/ledger", "chunk_start")


def backfill_rows(source: DataFrame, folder: str) -> DataFrame:
    """What was loaded, with the chunk of each row; ``source`` names the columns."""
    schema = T.StructType([*source.schema.fields, LEDGER["chunk_start"]])
    return source.sparkSession.read.schema(schema).parquet(f"{folder}/rows")


# -- streams ------------------------------------------------------------------


def file_stream(
    spark: SparkSession, folder: str, name: str, schema: T.StructType, max_files: int | None = None
) -> DataFrame:
    """Stream over a table stored as one Parquet file or as a folder of them."""
    # The bracket makes the path a pattern, which may name a single file.
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(f"{folder.rstrip('/')}/{name}.parque[t]")


def drain(stream: DataFrame, write_batch, checkpoint: str, mode: str = "append") -> list:
    """Run a stream over everything available now, then stop; returns the progress of its batches."""
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write_batch)
        .start()
    )
    query.awaitTermination()
    return query.recentProgress


def drop_late_duplicates(stream: DataFrame, time: str, key: list[str]) -> DataFrame:
    """First arrival per key, remembered for the overlap window.

    For feeds whose files arrive in time order; rows later than the window are
    the batch reload's business, which loses none.
    """
    # A watermark needs an instant; local times are taken as such.
    timed = stream.withColumn("_event_time", F.col(time).cast("timestamp"))
    return timed.withWatermark("_event_time", f"{OVERLAP_DAYS} day").dropDuplicatesWithinWatermark(key).drop("_event_time")


def _overlap_table(spark: SparkSession, folder: str, name: str, schema: T.StructType) -> DataFrame:
    extra = [T.StructField("load_day", T.DateType()), T.StructField("batch", T.IntegerType())]
    return spark.read.schema(T.StructType([*schema.fields, *extra])).parquet(f"{folder}/{name}")


def run_overlap_load(spark: SparkSession, stream: DataFrame, time: str, key: list[str], order: list[str]) -> str:
    """Drain a feed whose rows may come late; returns the folder of its tables.

    ``rows`` holds the first row stored per key. Rows more than the overlap
    behind the newest time of earlier batches go to ``late``, from where
    ``merge_late`` brings them in, so none is lost. A batch looks for its keys on
    the days that it holds itself: it reads what the overlap spans, not the
    table. Copies of a key must carry the same day. Rows without a time are never
    late. A batch replaces its own partitions and compares with earlier batches
    alone, so a replay writes the same again.
    """
    folder = scratch_path(spark, "overlap")

    def write(batch: DataFrame, batch_id: int) -> None:
        late = F.lit(False)
        if path_exists(spark, f"{folder}/marks"):
            newest = spark.read.parquet(f"{folder}/marks").where(F.col("batch") < batch_id).select(F.max("newest")).scalar()
            late = F.coalesce(F.col(time) < newest - F.expr(f"INTERVAL {OVERLAP_DAYS} DAY"), F.lit(False))
        marked = batch.withColumns({"load_day": F.to_date(time), "batch": F.lit(batch_id), "_late": late}).persist()
        try:
            _replace_partitions(marked.where("_late").drop("_late"), f"{folder}/late", "load_day", "batch")
            fresh = keep_first(marked.where("NOT _late").drop("_late"), key, order)
            if path_exists(spark, f"{folder}/rows"):
                stored = _overlap_table(spark, folder, "rows", batch.schema).where(in_partitions(marked, "load_day"))
                fresh = fresh.join(stored.where(F.col("batch") != batch_id).select(*key), key, "left_anti")
            _replace_partitions(fresh.select(*marked.drop("_late").columns), f"{folder}/rows", "load_day", "batch")
            _replace_partitions(marked.groupBy("batch").agg(F.max(time).alias("newest")), f"{folder}/marks", "batch")
        finally:
            marked.unpersist()

    drain(stream, write, scratch_path(spark, "stream"))
    return folder


def late_rows(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """Rows set aside as late, with the batch that brought them."""
    return _overlap_table(spark, folder, "late", schema).drop("load_day")


def merge_late(spark: SparkSession, folder: str, schema: T.StructType, key: list[str], order: list[str]) -> DataFrame:
    """Bring late rows whose key is stored nowhere into the table, the earliest batch first; returns the table.

    Only the days of late rows are read. They are stored under negative batch
    numbers, so a repeated merge replaces what it wrote before.
    """
    late = _overlap_table(spark, folder, "late", schema)
    rows = _overlap_table(spark, folder, "rows", schema)
    known = rows.where((F.col("batch") >= 0) & in_partitions(late, "load_day")).select(*key)
    fresh = keep_first(late, key, ["batch", *order]).join(known, key, "left_anti").withColumn("batch", -1 - F.col("batch"))
    # What is written is cut from the table that it read.
    _replace_partitions(checkpointed(fresh.select(*late.columns)), f"{folder}/rows", "load_day", "batch")
    return _overlap_table(spark, folder, "rows", schema).drop("load_day", "batch")


def tumbling_sales(stream: DataFrame, time: str, key: str, qty: str, delay: str = "1 day") -> DataFrame:
    """Daily totals as one-day windows, kept open for rows up to ``delay`` behind the newest."""
    return _windowed(stream, time, ["1 day"], key, qty, delay)


def sliding_mean(stream: DataFrame, time: str, key: str, qty: str, delay: str = "1 day") -> DataFrame:
    """Seven-day totals and means, advancing by a day."""
    return _windowed(stream, time, ["7 days", "1 day"], key, qty, delay)


def _windowed(df: DataFrame, time: str, window: list[str], key: str, qty: str, delay: str) -> DataFrame:
    # A watermark needs an instant; local times are taken as such.
    timed = df.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", delay)
    # Decimal totals are exact, so they do not depend on how the rows were split over batches.
    exact = F.sum(F.col(qty).cast("decimal(18,4)")).cast("double")
    out = timed.groupBy(F.window("_at", *window).alias("w"), key).agg(F.count("*").alias("n"), exact.alias("total"))
    return out.select(
        F.to_date("w.start").alias("window_start"), F.to_date("w.end").alias("window_end"), key, "n", "total",
        F.try_divide("total", "n").alias("mean"),
    )


def spikes(windows: DataFrame, key: str, ratio: float) -> DataFrame:
    """Windows whose mean exceeds ``ratio`` times the mean of the window that ended where it starts."""
    before = windows.select(F.col("window_end").alias("window_start"), key, F.col("mean").alias("base"))
    joined = windows.join(before, ["window_start", key])
    return joined.where(F.col("mean") > ratio * F.col("base")).select("window_start", "window_end", key, "mean", "base")


def run_aggregate(spark: SparkSession, stream: DataFrame, key: str) -> DataFrame:
    """Drain a stream of windowed aggregates and return the final table.

    In update mode a batch brings only the windows it changed, with their new
    totals; they replace their rows in a table partitioned by window start, so a
    replayed batch writes the same again. Windows behind the watermark leave the
    state, which holds no more than the open ones.
    """
    table = scratch_path(spark, "windows")

    def write(batch: DataFrame, _: int) -> None:
        upsert_path(batch, table, ["window_start", key], "window_start")

    drain(stream, write, scratch_path(spark, "stream"), mode="update")
    return spark.read.parquet(table).select(*stream.columns)


ALERT_STATE = T.StructType(
    [
        T.StructField("keys", T.ArrayType(T.ArrayType(T.StringType()))),
        T.StructField("alert_ids", T.ArrayType(T.StringType())),
        T.StructField("created_at", T.ArrayType(T.TimestampType())),
    ]
)
ALERT_BUCKETS = 256


def raised_alerts(stream: DataFrame, buckets: int = ALERT_BUCKETS) -> DataFrame:
    """Alerts that open: unresolved, of a key without an open one.

    Keys are dealt over ``buckets``, so Python is called per bucket, not per
    key; a checkpoint keeps the number it began with. The state of a bucket is
    the list of its open alerts and nothing else: a resolved row removes its
    key, and a bucket without an open alert has no state. Rows of a batch are
    taken in order of time, then id; batches should come in order.
    """
    columns = [f.name for f in stream.schema.fields]

    def step(_, frames, state: GroupState):
        rows = pd.concat(list(frames), ignore_index=True).sort_values(["created_at", "alert_id"], kind="stable")
        held = {}
        if state.exists:
            held = {tuple(key): alert for key, *alert in zip(*state.get, strict=True)}
        opened = []
        keys = zip(*(rows[c] for c in ALERT_KEY), strict=True)
        for at, (key, alert_id, created_at, resolved) in enumerate(zip(keys, rows.alert_id, rows.created_at, rows.resolved, strict=True)):
            if resolved:
                held.pop(key, None)
            elif key not in held:
                held[key] = alert_id, None if pd.isna(created_at) else created_at.to_pydatetime()
                opened.append(at)
        if held:
            state.update(([list(key) for key in held], *map(list, zip(*held.values(), strict=True))))
        elif state.exists:
            state.remove()
        yield rows.iloc[opened][columns]

    dealt = stream.withColumn("_bucket", F.pmod(F.xxhash64(*ALERT_KEY), F.lit(buckets)))
    return dealt.groupBy("_bucket").applyInPandasWithState(step, stream.schema, ALERT_STATE, "append", GroupStateTimeout.NoTimeout)


def run_alert_dedup(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """Drain an alert stream into a log of the alerts that opened.

    A batch writes its own partition of the log; a replay overwrites it. Earlier
    batches are never read, as what they left open is in the state.
    """
    log = scratch_path(spark, "alerts")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("batch").parquet(log)

    drain(raised_alerts(stream), write, scratch_path(spark, "stream"))
    return spark.read.schema(stream.schema).parquet(log).drop("batch")


def run_upsert(spark: SparkSession, stream: DataFrame, key: list[str], partition: str, version: list[str]) -> DataFrame:
    """Drain a change feed into a table that holds the newest version per key."""
    table = scratch_path(spark, "upsert")

    def write(batch: DataFrame, _: int) -> None:
        upsert_path(batch, table, key, partition, version)

    drain(stream, write, scratch_path(spark, "stream"))
    return spark.read.parquet(table)


def run_insert_new(spark: SparkSession, stream: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Drain a feed into a table that keeps the first row stored per key."""
    table = scratch_path(spark, "insert")

    def write(batch: DataFrame, batch_id: int) -> None:
        fresh = keep_first(batch, key, order)
        if path_exists(spark, table):
            before = spark.read.parquet(table).where(F.col("batch") != batch_id)
            fresh = fresh.join(before.select(*key), key, "left_anti")
        fresh.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("batch").parquet(table)

    drain(stream, write, scratch_path(spark, "stream"))
    return spark.read.parquet(table).drop("batch")
