"""Numeric expressions. ANSI mode is on in Spark 4, so every cast and division that can fail is a ``try_`` form."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def parse_formatted(col: Column) -> Column:
    """``'1,234.50'`` to a decimal; blank or malformed text to NULL."""
    return F.nullif(F.replace(col, F.lit(","), F.lit("")), F.lit("")).try_cast("decimal(18,4)")


def coerce(col: Column, default: float) -> Column:
    """Numeric value of a text, or the default."""
    return F.coalesce(col.try_cast("double"), F.lit(float(default)))


def clip(col: Column, lower: float | None = None, upper: float | None = None) -> Column:
    out = col
    if upper is not None:
        out = F.least(out, F.lit(upper))
    if lower is not None:
        out = F.greatest(out, F.lit(lower))
    return out


def finite(col: Column) -> Column:
    """NULL for NaN and the infinities."""
    return F.when(F.isnan(col) | (F.abs(col) == F.lit(float("inf"))), F.lit(None)).otherwise(col)


def ratio(num: Column, den: Column) -> Column:
    """Division that is NULL, not an error, at a zero denominator."""
    return F.try_divide(num, den)


def moq_round_up(qty: Column, moq: Column) -> Column:
    """Smallest multiple of the minimum order quantity covering ``qty``; nothing to order is 0."""
    step = F.when(moq > 0, moq).otherwise(F.lit(1.0))
    return F.when(qty <= 0, F.lit(0.0)).otherwise(F.ceil(qty / step) * step)


def accuracy_pct(abs_error: Column, actual: Column) -> Column:
    """``max(0, 100 (1 - error / actual))``, NULL without actuals."""
    return F.when(
        actual != 0, F.greatest(F.lit(0.0), F.lit(100.0) * (F.lit(1.0) - F.try_divide(abs_error, actual)))
    )
