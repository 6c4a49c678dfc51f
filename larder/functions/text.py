"""String expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

# Text spellings of a missing value.
NULL_WORDS = ["nan", "None", "NaN"]


def blank_if_missing(col: Column) -> Column:
    """Trim; NULL and the null spellings become the empty string."""
    trimmed = F.trim(col)
    return F.when(trimmed.isNull() | trimmed.isin(NULL_WORDS), F.lit("")).otherwise(trimmed)


def strip_strings(df: DataFrame) -> DataFrame:
    """Apply :func:`blank_if_missing` to every string column, in one projection."""
    return df.select(
        *[
            blank_if_missing(F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def normalise_name(col: Column) -> Column:
    """Trim, lower-case, squeeze inner white space to one blank."""
    return F.regexp_replace(F.lower(F.trim(col)), r"\s+", " ")


def join_key(col: Column) -> Column:
    """The spelling used to compare outlets and ingredients."""
    return F.lower(F.trim(col))


def vendor_code(name: Column) -> Column:
    """``V-`` and the first ten alphanumeric characters, upper-cased."""
    alnum = F.regexp_replace(name, "[^A-Za-z0-9]", "")
    return F.concat(F.lit("V-"), F.substring(F.upper(alnum), 1, 10))


def is_raw_id(col: Column) -> Column:
    """A 24-digit hexadecimal id where a name is expected."""
    return col.rlike("^[0-9a-f]{24}$")


def contains_ignore_case(col: Column, needle: str) -> Column:
    return F.contains(F.lower(col), F.lit(needle.lower()))


def equals_ignore_case(col: Column, value: str) -> Column:
    return F.lower(col) == F.lit(value.lower())


def first_part(col: Column, delimiter: str = " - ") -> Column:
    """Text before the first delimiter, trimmed."""
    return F.trim(F.split_part(col, F.lit(delimiter), F.lit(1)))
