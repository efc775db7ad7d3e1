"""Derived tables that last: bucketed by key, laid out by month, updated in place, and views of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.constants import MONTH_PART
from tillscope.functions import month_of
from tillscope.sources.tables import update_where


def save_table(
    df: DataFrame,
    name: str,
    keys: Sequence[str] = (),
    buckets: int = 0,
    mode: str = "overwrite",
    path: str | None = None,
) -> DataFrame:
    """Save a derived table to the catalog, such as the first order date of every customer.

    With ``keys`` the table is bucketed and sorted by them, a file per bucket, and later joins and
    aggregations on the keys need no shuffle of it if ``buckets`` is not less than the partitions
    of the other side (``spark.sql.shuffle.partitions``). Bucket only tables that hold one row per
    key: a key that repeats very often would make one bucket far larger than the others. ``path``
    puts the files there in place of the warehouse.
    """
    if keys:
        df = df.repartition(buckets, *keys)
    writer = df.write.mode(mode)
    if keys:
        writer = writer.bucketBy(buckets, *keys).sortBy(*keys)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def save_view(
    df: DataFrame,
    name: str,
    table: str,
    comment: str = "",
    comments: dict[str, str] | None = None,
    path: str | None = None,
) -> DataFrame:
    """Save ``df`` as a table and a catalog view of it with comments on the view and its columns.

    Unlike a session view it is there for later sessions that use the same catalog, and it reads
    the stored rows, so it costs a scan of them and not the work behind them.
    """
    comments = comments or {}
    save_table(df, table, path=path)
    quoted = [f"`{c.replace('`', '``')}`" for c in df.columns]
    listed = [f"{q} COMMENT {_literal(comments[c])}" if c in comments else q for q, c in zip(quoted, df.columns)]
    df.sparkSession.sql(
        f"CREATE OR REPLACE VIEW {name} ({', '.join(listed)}) COMMENT {_literal(comment)}"
        f" AS SELECT {', '.join(quoted)} FROM {table}"
    )
    return df.sparkSession.table(name)


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def save_by_month(orders: DataFrame, path: str, date: str = "pay_date", mode: str = "overwrite") -> DataFrame:
    """Save order lines in a folder per month, as the column ``pay_month``, and read them from there.

    The rows are shuffled once by their month; adaptive execution splits a month that holds very
    many rows into several tasks and files, and puts small months together. Rows without a date
    have a folder of their own. Filters of the operators on the date then read only the folders of
    the months they touch.
    """
    monthed = orders.withColumn(MONTH_PART, month_of(date))
    monthed.hint("rebalance", F.col(MONTH_PART)).write.mode(mode).partitionBy(MONTH_PART).parquet(path)
    return orders.sparkSession.read.schema(monthed.schema).parquet(path)


def key_part(key: Column | str, parts: int) -> Column:
    """The folder number, below ``parts``, of a key: equal keys have equal numbers."""
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def save_by_part(df: DataFrame, path: str, part: str, mode: str = "overwrite") -> DataFrame:
    """Save a table in a folder per value of the column ``part`` and read it from there."""
    df.hint("rebalance", F.col(part)).write.mode(mode).partitionBy(part).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def update_in_place(
    spark: SparkSession, path: str, part: str, condition: Column, column: str, value: object
) -> int:
    """Set ``column`` to ``value`` where the condition holds, in a table in folders of ``part``.

    Only folders with a row that changes are written anew; the files of all others stay as they
    are. Returns the number of folders rewritten. Rows for which the condition is NULL, and rows
    that hold the value already, do not change; ``column`` cannot be ``part`` itself.

    The first pass reads only the columns of the condition, with its filters pushed down, and gives
    the folders to rewrite: the driver gets a row per folder at most, and it lists the folders
    anyway. The second pass reads and writes those. New files are complete before the folders are
    exchanged, at the end of the job: a lost executor repeats tasks only. The exchange goes folder
    by folder, so let no one read meanwhile, or use a table format with transactions.
    """
    if column == part:
        raise ValueError("the column that names the folders cannot be updated in place")
    saved = spark.read.parquet(path)
    changes = condition & ~F.col(column).eqNullSafe(F.lit(value))
    found = [r[0] for r in saved.where(changes).select(part).distinct().collect()]
    if not found:
        return 0
    known = [f for f in found if f is not None]
    touched = F.col(part).isin(known) if known else F.lit(False)
    if len(known) < len(found):
        touched = touched | F.col(part).isNull()
    rewritten = update_where(saved.where(touched), condition, column, value)
    # Only the folders that the rows fall into are replaced, all others are left alone.
    rewritten.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
    spark.catalog.refreshByPath(path)
    return len(found)
