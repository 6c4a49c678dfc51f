"""Parquet table scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from larder.functions.numbers import finite


def table_path(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}.parquet"


def read_table(
    spark: SparkSession,
    folder: str,
    name: str,
    columns: list[str] | None = None,
    where: Column | None = None,
) -> DataFrame:
    """Scan with the column list and filter stated up front, so both reach the Parquet reader."""
    df = spark.read.parquet(table_path(folder, name))
    if where is not None:
        df = df.where(where)
    return df.select(*columns) if columns else df


def finite_only(df: DataFrame) -> DataFrame:
    """NaN and infinities of every floating column become NULL."""
    return df.select(
        *[
            finite(F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )
