"""Session defaults and the shared scratch location."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # One key may hold a third of a fact table: let AQE split such a partition.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Call-site capture for every column expression costs more than planning the queries.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "larder", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local session without the setting gets a folder of its own; on a
    cluster a machine-local folder would be lost with the machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    path = tempfile.mkdtemp(prefix="larder-")
    spark.sparkContext.setCheckpointDir(path)
    return path


_SCOPES: list[str] = []


def _own_scratch(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/larder/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh sub-folder of the shared scratch location."""
    return "/".join([_own_scratch(spark), *_SCOPES, f"{label}-{uuid.uuid4().hex}"])


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete on leaving all scratch tables made inside, by any thread; results must be consumed or stored before.

    Scopes may be nested, but must not overlap in time otherwise. Checkpoints
    are Spark's own: ``spark.cleaner.referenceTracking.cleanCheckpoints``.
    """
    _SCOPES.append(f"scope-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        folder = "/".join([_own_scratch(spark), *_SCOPES])
        _SCOPES.pop()
        _delete(spark, folder)


def clear_scratch(spark: SparkSession) -> None:
    """Delete every scratch table of this application, and those of no other one."""
    _delete(spark, _own_scratch(spark))


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage into reliable storage, which outlives lost executors."""
    scratch_root(df.sparkSession)
    return df.checkpoint(eager=eager)
