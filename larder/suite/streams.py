"""T-queries: incremental loads and their streaming forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.session import scratch_path
from larder.streaming import incremental as inc
from larder.suite.registry import query


def events_stream(r, *columns):
    schema = r.t("events").schema
    return inc.file_stream(r.spark, r.folder, "events", schema).select(*columns)


FEED_FILES = 5


def feed(r, *columns, late_hours: int = 12):
    """The events as a folder of files in order of time, some rows up to ``late_hours`` late in a later file; one file a batch."""
    events = r.t("events").withColumn("_late", F.when(F.col("event_id") % 7 == 0, late_hours * 3600).otherwise(0))
    span = events.agg(F.min(F.unix_timestamp("ts")).alias("lo"), F.max(F.unix_timestamp("ts")).alias("hi")).first()
    step = (span.hi - span.lo + late_hours * 3600) // FEED_FILES + 1
    arrives = F.floor((F.unix_timestamp("ts") + F.col("_late") - span.lo) / step)
    folder = scratch_path(r.spark, "feed")
    for n in range(FEED_FILES):  # one after another, as files are read by their age
        events.where(arrives == n).drop("_late").coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
    return inc.file_stream(r.spark, folder, "events", r.t("events").schema, max_files=1).select(*columns)


@query(
    "T1_incremental_high_water",
    """SELECT event_id, user_id, event_type FROM events WHERE ts > (SELECT max(ts) FROM events
      WHERE CAST(ts AS DATE) < (SELECT d - 10 FROM event_day))""",
)
def _(r):
    source = r.t("events", "event_id", "user_id", "event_type", "ts")
    sink = source.where(F.to_date("ts") < F.date_sub(r.event_as_of, 10))
    return inc.newer_than(source, "ts", sink.select(F.max("ts")).scalar()).drop("ts")


@query(
    "T2_overlap_reload",
    """WITH sink AS (SELECT event_id, user_id, ts FROM events WHERE CAST(ts AS DATE) < (SELECT d - 10 FROM event_day) AND event_type <> 'signup')
    SELECT event_id, user_id FROM sink UNION ALL SELECT event_id, user_id FROM events
      WHERE ts >= (SELECT max(ts) - INTERVAL 1 DAY FROM sink) AND event_id NOT IN (SELECT event_id FROM sink)""",
)
def _(r):
    source = r.t("events", "event_id", "user_id", "event_type", "ts")
    loaded = (F.to_date("ts") < F.date_sub(r.event_as_of, 10)) & (F.col("event_type") != "signup")
    sink = source.where(loaded).drop("event_type")
    twice = source.drop("event_type").unionByName(source.drop("event_type"))
    return inc.overlap_reload(twice, sink, "ts", ["event_id"], ["ts"]).select("event_id", "user_id")


@query("T2_overlap_stream", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def _(r):
    stream = events_stream(r, "event_id", "user_id", "event_type")
    return inc.run_insert_new(r.spark, stream, ["user_id", "event_type"], ["event_id"])


LATE_HOURS = 72
LATE_SQL = f"""span AS (SELECT CAST(floor(epoch(min(ts))) AS BIGINT) AS lo, CAST(floor(epoch(max(ts))) AS BIGINT) AS hi FROM events),
  landed AS (SELECT event_id, user_id, ts, CAST(floor((CAST(floor(epoch(ts)) AS BIGINT) + CASE WHEN event_id % 7 = 0 THEN {LATE_HOURS * 3600} ELSE 0 END - lo)
    / ((hi - lo + {LATE_HOURS * 3600}) // {FEED_FILES} + 1)) AS INTEGER) AS batch FROM events, span),
  marks AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM landed GROUP BY batch)"""


def overlap_load(r):
    """Five files, every seventh row three days late."""
    stream = feed(r, "event_id", "user_id", "ts", late_hours=LATE_HOURS)
    return inc.run_overlap_load(r.spark, stream, "ts", ["event_id"], ["ts"]), stream.schema


@query(
    "T2_late_rows",
    f"WITH {LATE_SQL} SELECT event_id, user_id, batch FROM landed JOIN marks USING (batch) WHERE ts < mark - INTERVAL 1 DAY",
)
def _(r):
    folder, schema = overlap_load(r)
    return inc.late_rows(r.spark, folder, schema).select("event_id", "user_id", "batch")


@query("T2_late_rows_merged", "SELECT event_id, user_id, ts FROM events")
def _(r):
    folder, schema = overlap_load(r)
    return inc.merge_late(r.spark, folder, schema, ["event_id"], ["ts"])


BACKFILL_DAYS = 3
BACKFILL_SQL = f"""b AS (SELECT min(CAST(ts AS DATE)) AS lo, max(CAST(ts AS DATE)) + 1 AS hi FROM events),
  r AS (SELECT event_id, event_type, ts, CAST(lo + CAST(floor((CAST(ts AS DATE) - lo) / {BACKFILL_DAYS}) AS INTEGER) * {BACKFILL_DAYS} AS DATE) AS chunk_start FROM events, b)"""


def backfill(r):
    """A run that breaks off after its first wave of three chunks, and one that goes on; every row is delivered twice."""
    events = r.t("events", "event_id", "event_type", "ts")
    source, folder = events.unionByName(events), scratch_path(r.spark, "backfill")
    for waves in (1, None):
        inc.run_backfill(source, folder, "ts", ["event_id"], ["event_type"], BACKFILL_DAYS, wave=3, waves=waves)
    return source, folder


@query("T3_backfill_rows", f"WITH {BACKFILL_SQL} SELECT * FROM r")
def _(r):
    return inc.backfill_rows(*backfill(r))


@query(
    "T3_backfill_ledger",
    f"""WITH {BACKFILL_SQL}, s AS (SELECT CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi - 1 AS TIMESTAMP), INTERVAL {BACKFILL_DAYS} DAY)) AS DATE) AS chunk_start, hi FROM b),
      n AS (SELECT chunk_start, count(*) AS n FROM r GROUP BY 1)
    SELECT s.chunk_start, CAST(least(s.chunk_start + {BACKFILL_DAYS}, hi) AS DATE) AS chunk_end, 'loaded' AS state, coalesce(n, 0) AS n
    FROM s LEFT JOIN n ON n.chunk_start = s.chunk_start""",
)
def _(r):
    _, folder = backfill(r)
    return inc.backfill_ledger(r.spark, folder)


@query(
    "T3_chunked_backfill",
    """WITH b AS (SELECT min(CAST(l_shipdate AS DATE)) AS lo, max(CAST(l_shipdate AS DATE)) + 1 AS hi FROM lineitem),
      s AS (SELECT CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi - 1 AS TIMESTAMP), INTERVAL 15 DAY)) AS DATE) AS chunk_start, hi FROM b),
      n AS (SELECT CAST(lo + CAST(floor((CAST(l_shipdate AS DATE) - lo) / 15) AS INTEGER) * 15 AS DATE) AS chunk_start, count(*) AS n FROM lineitem, b GROUP BY 1)
    SELECT s.chunk_start, CAST(least(s.chunk_start + 15, hi) AS DATE) AS chunk_end, coalesce(n, 0) AS n FROM s LEFT JOIN n ON n.chunk_start = s.chunk_start""",
)
def _(r):
    lines = r.t("lineitem", "l_shipdate")
    sizes = inc.chunk_sizes(lines, "l_shipdate")
    return inc.fixed_chunks(lines, "l_shipdate").join(sizes, "chunk_start", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query(
    "T3_month_chunks",
    """WITH b AS (SELECT min(CAST(o_orderdate AS DATE)) AS lo, max(CAST(o_orderdate AS DATE)) + 1 AS hi FROM orders)
    SELECT chunk_start, CAST(least(chunk_start + INTERVAL 1 MONTH, CAST(hi AS TIMESTAMP)) AS DATE) AS chunk_end FROM (
      SELECT CAST(unnest(generate_series(date_trunc('month', CAST(lo AS TIMESTAMP)), CAST(hi - 1 AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS chunk_start, hi FROM b)""",
)
def _(r):
    return inc.month_chunks(r.t("orders", "o_orderdate"), "o_orderdate")


@query(
    "T4_tumbling_sales",
    """SELECT CAST(ts AS DATE) AS window_start, CAST(ts AS DATE) + 1 AS window_end, event_type, count(*) AS n,
      CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS mean
    FROM events GROUP BY 1, 2, 3""",
)
def _(r):
    stream = feed(r, "ts", "event_type", "value")
    return inc.run_aggregate(r.spark, inc.tumbling_sales(stream, "ts", "event_type", "value"), "event_type")


SLIDING_SQL = """sliding AS (SELECT CAST(day - CAST(k AS INTEGER) AS DATE) AS window_start, CAST(day - CAST(k AS INTEGER) + 7 AS DATE) AS window_end, event_type,
    CAST(sum(c) AS BIGINT) AS n, CAST(sum(v) AS DOUBLE) AS v FROM (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS c, sum(CAST(value AS DECIMAL(18,4))) AS v FROM events GROUP BY 1, 2), range(0, 7) t(k)
    GROUP BY 1, 2, 3)"""


@query(
    "T5_sliding_spike",
    f"""WITH {SLIDING_SQL} SELECT window_start, window_end, event_type, n, v AS total, v / n AS mean FROM sliding""",
)
def _(r):
    stream = feed(r, "ts", "event_type", "value")
    return inc.run_aggregate(r.spark, inc.sliding_mean(stream, "ts", "event_type", "value"), "event_type")


@query(
    "T5_spike_windows",
    f"""WITH {SLIDING_SQL}, m AS (SELECT window_start, window_end, event_type, v / n AS mean FROM sliding)
    SELECT a.window_start, a.window_end, a.event_type, a.mean, b.mean AS base FROM m a JOIN m b
      ON b.window_end = a.window_start AND b.event_type = a.event_type WHERE a.mean > 1.02 * b.mean""",
)
def _(r):
    stream = feed(r, "ts", "event_type", "value")
    windows = inc.run_aggregate(r.spark, inc.sliding_mean(stream, "ts", "event_type", "value"), "event_type")
    return inc.spikes(windows, "event_type", 1.02)


@query(
    "T6_stateful_alert_dedup",
    """SELECT alert_id, alert_type, severity, outlet FROM (SELECT CAST(event_id AS VARCHAR) AS alert_id, event_type AS alert_type,
      CASE event_type WHEN 'error' THEN 'CRITICAL' WHEN 'purchase' THEN 'WARNING' ELSE 'INFO' END AS severity, CAST(user_id AS VARCHAR) AS outlet,
      event_id % 2 AS resolved, lag(event_id % 2) OVER (PARTITION BY event_type, user_id ORDER BY ts, CAST(event_id AS VARCHAR)) AS before FROM events)
    WHERE resolved = 0 AND coalesce(before, 1) = 1""",
)
def _(r):
    """Alerts that open over five batches: an open key stays quiet, a resolved one may be raised again."""
    kind = F.col("event_type")
    stream = feed(
        r,
        F.col("event_id").cast("string").alias("alert_id"), kind.alias("alert_type"),
        F.when(kind == "error", "CRITICAL").when(kind == "purchase", "WARNING").otherwise("INFO").alias("severity"),
        F.lit("").alias("sku"), F.col("user_id").cast("string").alias("outlet"), F.lit("").alias("ingredient"),
        F.col("ts").cast("timestamp").alias("created_at"), (F.col("event_id") % 2).cast("int").alias("resolved"), late_hours=0,
    )
    return inc.run_alert_dedup(r.spark, stream).select("alert_id", "alert_type", "severity", "outlet")


@query(
    "T7_upsert_stream",
    """SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (
      PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
)
def _(r):
    stream = events_stream(r, "user_id", "event_type", "event_id", "value", "ts")
    newest = inc.run_upsert(r.spark, stream, ["user_id", "event_type"], "event_type", ["ts", "event_id"])
    return newest.select("user_id", "event_type", "event_id", "value")
