"""Sums, ratios, labels and the small conversions the operators share."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def double_sum(df: DataFrame, column: str, where: Column | None = None) -> Column:
    """Sum of a column as double, over the rows that meet a condition.

    A decimal column is summed exactly and cast once at the end, so the result does not depend on
    the order in which partitions are merged or on a task being run again.
    """
    value = F.col(column)
    exact = isinstance(df.schema[column].dataType, T.DecimalType)
    value = value if exact else value.cast("double")
    return F.sum(value if where is None else F.when(where, value)).cast("double")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division that is NULL where the denominator is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def ascending(*columns: str) -> list[Column]:
    """Sort keys that put NULL after every value."""
    return [F.col(column).asc_nulls_last() for column in columns]


def range_label(left: Column, right: Column) -> Column:
    """``left-right`` with two decimals, as text."""
    return F.concat(left.cast("decimal(10,2)").cast("string"), F.lit("-"),
                    right.cast("decimal(10,2)").cast("string"))


def json_items(text: Column) -> Column:
    """Elements of a JSON array held as text; ``["1"]`` and ``[1]`` both give ``1``."""
    return F.from_json(text, "array<string>")


def comparable(df: DataFrame, ratios: Collection[str] = (), places: int = 6) -> DataFrame:
    """Types every SQL engine prints alike: doubles, ISO dates, 64-bit integers.

    Only ``ratios``, the columns of quotients and means, are rounded: engines add doubles in
    different orders, so a mean that lies exactly between two rounded values may come out a hair
    below it, and a nudge far smaller than the rounding sends it up everywhere. Sums, counts and
    amounts are compared as they are.
    """

    def plain(field: T.StructField) -> Column:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            column = column.cast("double")
            if field.name in ratios:
                column = F.round(column + 1e-9, places)
        elif isinstance(field.dataType, T.DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            column = column.cast("long")
        return column.alias(field.name)

    return df.select(*[plain(field) for field in df.schema])
