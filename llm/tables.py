"""Scratch tables and column checks shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from larder.session import scratch_path


def settled(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write to the shared scratch folder, in one folder per value of ``by`` if given, and read back.

    Cuts the lineage into storage that outlives lost executors, and gives both
    inputs of a later join plain shuffles, which AQE may split when a key is hot.
    """
    path = scratch_path(df.sparkSession, f"llm-{label}")
    writer = df.write
    if by is not None:
        writer = writer.partitionBy(by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, under fixed names, so that extra columns cannot clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
