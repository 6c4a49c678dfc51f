"""Joins of a fact with a lookup when one key may hold a large share of the fact.

AQE splits a skewed partition only when both join inputs come straight out of
a shuffle. A lookup that was just aggregated or deduplicated does not, so such
joins spread the fact rows over a fixed number of salts and give each salt its
own copy of the lookup's row: of every key, or where the hot keys have been
measured, of those alone. Every fact row has exactly one salt, hence the result
is that of the plain join, whichever keys were named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SALTS = 16


def hot_keys(df: DataFrame, on: list[str], share: float = 0.01) -> Column:
    """The keys that hold more than ``share`` of the rows, at most ``1 / share`` of them, as a scalar subquery.

    Measure on a narrow scan that the fact comes from, counted before the
    shuffle, rather than on a fact that is costly to derive.
    """
    counts = df.groupBy(*on).agg(F.count("*").alias("_n"))
    total = df.agg(F.count("*")).scalar()
    return counts.where(F.col("_n") > share * total).agg(F.collect_list(F.struct(*on))).scalar()


def salted_join(
    fact: DataFrame, lookup: DataFrame, on: list[str], how: str = "inner", salts: int = SALTS, hot: Column | None = None
) -> DataFrame:
    """``fact.join(lookup, on, how)`` for inner, left, left_semi and left_anti joins.

    ``hot``, from ``hot_keys`` over columns of the same names and types, limits
    salts and copies to the keys in it; without it every lookup row is copied.

    The salt mixes the row's hash with the number of its input partition, so
    that exact copies of one row spread too. Both are the same when a task is
    retried. Hashing reads every column: select the needed ones first.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a {how} join would repeat unmatched lookup rows")
    mixed = F.pmod(F.xxhash64(*fact.columns), F.lit(salts)) + F.spark_partition_id()
    salt, each = F.pmod(mixed, F.lit(salts)).cast("int"), F.sequence(F.lit(0), F.lit(salts - 1))
    if hot is not None:
        is_hot = F.array_contains(hot, F.struct(*on))
        salt, each = F.when(is_hot, salt).otherwise(0), F.when(is_hot, each).otherwise(F.array(F.lit(0)))
    salted, copies = fact.withColumn("_salt", salt), lookup.withColumn("_salt", F.explode(each))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")
