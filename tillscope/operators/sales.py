"""Filters over order lines and the small reports on their dates."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.constants import MONTH_PART, SENT
from tillscope.functions import age_parts, month_of, whole_days


def valid_sales(
    orders: DataFrame,
    need: Sequence[str] = ("user_id", "order_id", "pay_date", "pay_amt"),
) -> DataFrame:
    """Order lines that count as a sale and have every needed column."""
    kept = orders.filter(F.col("order_status") == SENT)
    for column in need:
        kept = kept.filter(F.col(column).isNotNull())
    return kept


def with_month(orders: DataFrame) -> DataFrame:
    """Add ``month``, the first day of the month of the order."""
    return orders.withColumn("month", month_of("pay_date"))


def between_dates(
    df: DataFrame,
    start: date | str,
    end: date | str,
    column: str = "pay_date",
    left_open: bool = False,
) -> DataFrame:
    """Rows dated from ``start`` to ``end``, both included unless ``left_open``.

    Of order lines saved by month only the folders of the months in question are read.
    """
    value, first, last = F.col(column), F.lit(start).cast("date"), F.lit(end).cast("date")
    if column == "pay_date" and MONTH_PART in df.columns:
        df = df.filter(F.col(MONTH_PART).between(month_of(first), month_of(last)))
    lower = value > first if left_open else value >= first
    return df.filter(lower & (value <= last))


def orders_in_range(orders: DataFrame, start: date | str, end: date | str) -> DataFrame:
    """All columns of the order lines after ``start`` up to and including ``end``."""
    return between_dates(orders, start, end, left_open=True)


def orders_on_day(orders: DataFrame, day: date | str) -> DataFrame:
    """All columns of the order lines of one day."""
    return between_dates(orders, day, day)


def orders_in_windows(
    orders: DataFrame, windows: DataFrame, start: str = "start_date", end: str = "finish_date"
) -> DataFrame:
    """All columns of the order lines and of the windows, a row per line and window that holds it.

    Both ends of a window count. Each window is dealt to the months it touches, at most one row per
    window and month, and the lines are joined by their month. Of order lines saved by month, the
    scan reads only the folders of months that a window touches, whatever its filters: they are
    known when the windows have been read. Lines without a date, and windows without a start or an
    end, or with the end before the start, have no partner.
    """
    if MONTH_PART not in orders.columns:
        orders = orders.withColumn(MONTH_PART, month_of("pay_date"))
    first, last = F.col(start), F.col(end)
    months = F.sequence(month_of(first), month_of(last), F.expr("interval 1 month"))
    dealt = windows.filter(first <= last).withColumn(MONTH_PART, F.explode(months))
    held = F.col("pay_date").between(first, last)
    return orders.join(dealt, MONTH_PART).filter(held).drop(MONTH_PART)


def orders_of_products(orders: DataFrame, product_ids: Sequence[str]) -> DataFrame:
    """All columns of the order lines of the listed products, as a filter the scan can use."""
    return orders.filter(F.col("product_id").isin([str(p) for p in product_ids]))


def orders_of_listed(orders: DataFrame, listed: DataFrame) -> DataFrame:
    """All columns of the order lines whose product is in a table with ``product_id`` as text."""
    wanted = listed.select("product_id")
    return orders.join(wanted, "product_id", "left_semi").select(*orders.columns)


def products_in_category(
    products: DataFrame, category_1: str, category_2: str | None = None
) -> DataFrame:
    """Product ids (as text, the type of the order lines) of one or two category levels."""
    kept = products.filter(F.col("category_1") == category_1)
    if category_2 is not None:
        kept = kept.filter(F.col("category_2") == category_2)
    return kept.select(F.col("product_id").cast("string").alias("product_id"))


def category_orders(
    orders: DataFrame,
    products: DataFrame,
    category_1: str,
    category_2: str | None = None,
) -> DataFrame:
    """Sales of the products of a category; filter the dates of ``orders`` beforehand."""
    wanted = products_in_category(products, category_1, category_2)
    return orders_of_listed(valid_sales(orders, need=()), wanted)


def date_bounds(orders: DataFrame) -> DataFrame:
    """Earliest and latest order date, one row."""
    return orders.agg(F.min("pay_date").alias("min_date"), F.max("pay_date").alias("max_date"))


def last_date(orders: DataFrame) -> DataFrame:
    """Latest order date as ISO text, one row."""
    return orders.agg(F.date_format(F.max("pay_date"), "yyyy-MM-dd").alias("last_date"))


def row_count(df: DataFrame) -> DataFrame:
    """Number of rows, one row."""
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def with_age(
    df: DataFrame, later: str | date, earlier: str | date, prefix: str = ""
) -> DataFrame:
    """Add the days, whole months and left-over days between two dates.

    Each date is a column name or a ``date``; pass the date to measure against, where a SQL script
    would say now, as a value so that a run can be repeated.
    """
    a, b = (F.lit(d) if isinstance(d, date) else F.col(d) for d in (later, earlier))
    parts = age_parts(a, b)
    return (
        df.withColumn(f"{prefix}days", whole_days(a, b))
        .withColumn(f"{prefix}months", parts["months"])
        .withColumn(f"{prefix}rest_days", parts["days"])
    )


def customer_tenure(orders: DataFrame, as_of: date | None = None) -> DataFrame:
    """Time from each customer's first to last order, and from the last order to ``as_of``."""
    spans = orders.groupBy("user_id").agg(
        F.min("pay_date").alias("first_date"), F.max("pay_date").alias("last_date")
    )
    tenure = with_age(spans, "last_date", "first_date")
    return tenure if as_of is None else with_age(tenure, as_of, "last_date", prefix="since_")
