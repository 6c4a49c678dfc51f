"""Upserts, replacements and appends.

The DataFrame forms state the new content of a table. The ``*_path`` forms
write it: only touched partitions, published by rename where a whole table is
replaced. Lineage that reads the target is cut into the shared checkpoint
folder before the target is overwritten.
"""

from __future__ import annotations

import datetime as dt
import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from larder.operators.cleaning import keep_first, keep_last
from larder.operators.skew import salted_join
from larder.session import checkpointed, scratch_path

#: Partition values of a batch that the driver lists; beyond, it takes their range.
MAX_LISTED = 10_000


def upsert(existing: DataFrame, incoming: DataFrame, key: list[str], version: list[str] | None = None) -> DataFrame:
    """Insert; on a key conflict the incoming row wins, or the newest ``version`` where one is named.

    Without a version both sides must be unique per key. With one, replaying
    a batch or receiving it late changes nothing.
    """
    tagged = existing.withColumn("_batch", F.lit(0)).unionByName(
        incoming.withColumn("_batch", F.lit(1)), allowMissingColumns=True
    )
    return keep_last(tagged, key, [*(version or []), "_batch"]).drop("_batch")


def insert_new(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Insert; on a key conflict the existing row stays."""
    known = existing.select(*key)
    return existing.unionByName(incoming.join(known, key, "left_anti"), allowMissingColumns=True)


def upsert_unless(existing: DataFrame, incoming: DataFrame, key: list[str], locked: str) -> DataFrame:
    """Upsert that leaves rows flagged ``locked`` as they are."""
    values = [c for c in existing.columns if c not in key]
    old = existing.select(*key, F.struct(*values).alias("old"))
    new = incoming.select(*key, F.struct(*values).alias("new"))
    keep_old = F.col("new").isNull() | F.coalesce(F.col(f"old.{locked}"), F.lit(False))
    chosen = F.when(keep_old & F.col("old").isNotNull(), F.col("old")).otherwise(F.col("new"))
    return old.join(new, key, "full").select(*key, chosen.alias("v")).select(*key, "v.*")


def replace_window(existing: DataFrame, recomputed: DataFrame, col: str, start: Column, end: Column) -> DataFrame:
    """Existing rows outside [start, end] and the recomputed rows inside it."""
    outside = ~F.col(col).between(start, end)
    return existing.where(outside | F.col(col).isNull()).unionByName(recomputed.where(F.col(col).between(start, end)))


def replace_group(existing: DataFrame, edits: DataFrame, key: str, normalised: list[str]) -> DataFrame:
    """For every group named in ``edits``, the edited rows replace the existing ones."""
    new = edits.withColumns({c: F.lower(F.trim(F.col(c))) for c in normalised})
    touched = new.select(F.col(key).alias("_touched")).distinct()
    keyed = existing.withColumn("_touched", F.lower(F.trim(F.col(key))))
    return salted_join(keyed, touched, ["_touched"], "left_anti").drop("_touched").unionByName(new)


def matching_columns(source: DataFrame, target_columns: list[str]) -> DataFrame:
    """Source columns the target also has; NaN becomes NULL."""
    common = [f for f in source.schema.fields if f.name in target_columns]
    if not common:
        raise ValueError("source and target share no column")
    return source.select(
        *[
            F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)).alias(f.name)
            if f.dataType.typeName() in ("double", "float")
            else F.col(f.name)
            for f in common
        ]
    )


def append_matching(existing: DataFrame, source: DataFrame) -> DataFrame:
    return existing.unionByName(matching_columns(source, existing.columns), allowMissingColumns=True)


def evolve_append(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Append; columns the target has not seen are added as text."""
    seen = set(existing.columns)
    as_text = incoming.select(*[F.col(c) if c in seen else F.col(c).cast("string").alias(c) for c in incoming.columns])
    return existing.unionByName(as_text, allowMissingColumns=True)


# -- writers ---------------------------------------------------------------


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm, fs = _fs(spark, path)
    return fs.exists(jvm.org.apache.hadoop.fs.Path(path))


def delete_path(spark: SparkSession, path: str) -> bool:
    """Delete a file or a folder with all it holds; False if there is none."""
    jvm, fs = _fs(spark, path)
    return fs.delete(jvm.org.apache.hadoop.fs.Path(path), True)


def replace_path(df: DataFrame, path: str) -> None:
    """Write beside the table, then swap by rename; readers never see a mixture of old and new.

    Between the two renames there is no table. Every rename is checked: if the
    new table cannot take its place, the old one returns and an error is raised.
    """
    spark = df.sparkSession
    staged, retired = f"{path}_new", f"{path}_old"
    df.write.mode("overwrite").parquet(staged)
    jvm, fs = _fs(spark, path)
    at = jvm.org.apache.hadoop.fs.Path
    held = fs.exists(at(path))
    if held:
        fs.delete(at(retired), True)
        if not fs.rename(at(path), at(retired)):
            raise OSError(f"could not set {path} aside")
    if not fs.rename(at(staged), at(path)):
        if held and not fs.rename(at(retired), at(path)):
            raise OSError(f"could not replace {path}; the old table is at {retired}")
        raise OSError(f"could not replace {path}")
    if held:
        fs.delete(at(retired), True)


def _put_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file in one step: written beside it, then renamed over it."""
    jvm = spark.sparkContext._jvm
    at, conf = jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    fresh = at(f"{path}.{uuid.uuid4().hex}")
    out = fresh.getFileSystem(conf).create(fresh, False)
    out.write(bytearray(text.encode()))
    out.close()
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), conf).rename(fresh, at(path), how)


def _get_text(spark: SparkSession, path: str) -> str | None:
    if not path_exists(spark, path):
        return None
    jvm, fs = _fs(spark, path)
    stream = fs.open(jvm.org.apache.hadoop.fs.Path(path))
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


CURRENT, VERSIONS, COLUMNS, ROWS = "_current", "versions", "_columns", "rows"


def publish(df: DataFrame, path: str, keep_seconds: float = 86_400) -> str:
    """Store ``df`` as a new version of the table and point readers to it; returns the version's name.

    A version is a folder of its own, and a small file names the current one.
    That file is replaced in one step after the version is complete, so a
    reader finds one whole version at any time, and a failed write leaves the
    old one in place. Versions replaced more than ``keep_seconds`` ago are then
    removed; keep them longer than the longest query runs.
    """
    spark = df.sparkSession
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(f"{path}/{VERSIONS}/{version}")
    _put_text(spark, f"{path}/{CURRENT}", version)
    jvm, fs = _fs(spark, path)
    names = sorted(s.getPath().getName() for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/{VERSIONS}")))
    # A version is out of use since the next one was begun.
    for name, later in zip(names, names[1:]):
        if later <= version and time.time_ns() - int(later.split("-")[0]) >= keep_seconds * 1e9:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/{VERSIONS}/{name}"), True)
    return version


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a table that ``publish`` writes."""
    version = _get_text(spark, f"{path}/{CURRENT}")
    if version is None:
        raise FileNotFoundError(f"nothing is published at {path}")
    return spark.read.parquet(f"{path}/{VERSIONS}/{version}")


def append_evolving(df: DataFrame, path: str) -> None:
    """Append files to a table whose columns may grow; its column list is stored beside them.

    Columns of the list keep their type, and what can't be cast is NULL; columns
    that the table has not seen are added as text. The list is replaced before
    the files are added, so no stored file holds a column that it lacks.
    """
    spark = df.sparkSession
    stored = _get_text(spark, f"{path}/{COLUMNS}")
    types = {f.name: f.dataType for f in T.StructType.fromJson(json.loads(stored)).fields} if stored else {}
    fields = {f.name: types.get(f.name, T.StringType() if stored else f.dataType) for f in df.schema.fields}
    if set(fields) - set(types):
        grown = T.StructType([T.StructField(n, t) for n, t in {**types, **fields}.items()])
        _put_text(spark, f"{path}/{COLUMNS}", grown.json())
    df.select(*[F.col(f"`{n}`").try_cast(t).alias(n) for n, t in fields.items()]).write.mode("append").parquet(f"{path}/{ROWS}")


def read_evolving(spark: SparkSession, path: str) -> DataFrame:
    """All rows under the stored column list; a file without a column has NULL there, and no footers are merged."""
    stored = _get_text(spark, f"{path}/{COLUMNS}")
    if stored is None:
        raise FileNotFoundError(f"no column list at {path}")
    return spark.read.schema(T.StructType.fromJson(json.loads(stored))).parquet(f"{path}/{ROWS}")


def append_path(source: DataFrame, path: str) -> None:
    """Append the columns the stored table knows."""
    columns = source.sparkSession.read.parquet(path).columns
    matching_columns(source, columns).write.mode("append").parquet(path)


def in_partitions(batch: DataFrame, partition: str) -> Column:
    """Condition on the partition column that the scan prunes by: the batch's own values, as literals.

    A batch of more than ``MAX_LISTED`` partitions is given as a range, which
    reads more partitions than needed and misses none.
    """
    col = F.col(partition)
    values = [row[0] for row in batch.select(partition).distinct().limit(MAX_LISTED + 1).collect()]
    known = [v for v in values if v is not None]
    if len(values) > MAX_LISTED:
        low, high = batch.agg(F.min(partition), F.max(partition)).first()
        return col.between(F.lit(low), F.lit(high)) | col.isNull()
    return col.isin(known) | col.isNull() if len(known) < len(values) else col.isin(known)


def upsert_path(incoming: DataFrame, path: str, key: list[str], partition: str, version: list[str] | None = None) -> None:
    """Upsert into a partitioned table, rewriting only the partitions the batch touches.

    ``partition`` must be part of the key, or a row could exist in two partitions.
    """
    if partition not in key:
        raise ValueError(f"partition column {partition} is not part of the key {key}")
    spark = incoming.sparkSession
    if version:
        incoming = keep_last(incoming, key, version)
    if not path_exists(spark, path):
        incoming.hint("rebalance", partition).write.partitionBy(partition).parquet(path)
        return
    stored = spark.read.parquet(path)
    incoming = checkpointed(incoming)
    touched = stored.where(in_partitions(incoming, partition))
    merged = checkpointed(upsert(touched.select(*stored.columns), incoming.select(*stored.columns), key, version))
    # Not a file per task in every partition: large ones are split over tasks, small ones share one.
    laid = merged.hint("rebalance", partition)
    laid.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def insert_new_path(incoming: DataFrame, path: str, key: list[str], partition: str, order: list[str]) -> None:
    """Add rows whose key the partitioned table doesn't hold, of several in the batch the first by ``order``.

    Only the partitions that the batch names are read, and none is rewritten. A
    batch delivered again adds nothing, unless its key holds a NULL.
    """
    if partition not in key:
        raise ValueError(f"partition column {partition} is not part of the key {key}")
    spark, fresh = incoming.sparkSession, checkpointed(keep_first(incoming, key, order))
    if path_exists(spark, path):
        known = spark.read.parquet(path).where(in_partitions(fresh, partition)).select(*key)
        fresh = checkpointed(fresh.join(known, key, "left_anti").select(*fresh.columns))
    fresh.hint("rebalance", partition).write.mode("append").partitionBy(partition).parquet(path)


def replace_window_path(recomputed: DataFrame, path: str, col: str, start: str, end: str) -> None:
    """Replace the date partitions of [start, end]; dates without new rows disappear."""
    spark = recomputed.sparkSession
    fresh = checkpointed(recomputed.where(F.col(col).between(F.lit(start).cast("date"), F.lit(end).cast("date"))))
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(col).parquet(path)
    # At most one value per day of the window, and no listing of the table's other days.
    written = {row[0] for row in fresh.select(col).distinct().collect()}
    first, last = dt.date.fromisoformat(start), dt.date.fromisoformat(end)
    for day in (first + dt.timedelta(days=n) for n in range((last - first).days + 1)):
        if day not in written:
            delete_path(spark, f"{path}/{col}={day}")


def report_json(df: DataFrame, endpoint: str, order: list[str], generated_at: Column) -> DataFrame:
    """One (endpoint, payload, generated_at) row holding a small report as a JSON array.

    For reports whose size their own limit bounds (top-k, one row per week).
    """
    ordered = F.sort_array(F.collect_list(F.struct(*order, *[c for c in df.columns if c not in order])))
    return df.agg(F.to_json(ordered).alias("payload")).select(
        F.lit(endpoint).alias("endpoint"), "payload", generated_at.alias("generated_at")
    )


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def round_trip(df: DataFrame, label: str) -> str:
    """Write ``df`` as Parquet into a fresh shared scratch folder and return the path."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return path
