"""Monthly and daily development of sales and customers."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillscope.functions import ascending, double_sum, month_start, month_text, ratio
from tillscope.operators.sales import (
    between_dates,
    orders_of_products,
    valid_sales,
    with_month,
)


def monthly_order_value(orders: DataFrame, drop_nulls: bool = True) -> DataFrame:
    """Mean over customers of their money per order, by month.

    With ``drop_nulls=False`` the group of unknown customers adds to the sum but not to the number
    of customers.
    """
    need = ("pay_date", "user_id", "pay_amt") if drop_nulls else ()
    sales = with_month(valid_sales(orders, need))
    customers = sales.groupBy("month", "user_id").agg(
        ratio(double_sum(sales, "pay_amt"), F.count_distinct("order_id")).alias("order_avg")
    )
    return (
        customers.groupBy("month")
        .agg(ratio(F.sum("order_avg"), F.count("user_id")).alias("total_user_order_avg"))
        .orderBy(*ascending("month"))
        .withColumn("month", month_text("month"))
    )


def purchase_breadth(
    orders: DataFrame, cap: int = 3, merge_tail: bool = True, drop_nulls: bool = False
) -> DataFrame:
    """Customers per month by the number of distinct products they bought: 1, 2, .. ``cap`` or more.

    ``merge_tail=False`` keeps one row per number of products and only labels the tail ``cap``.
    """
    need = ("pay_date", "product_id") if drop_nulls else ()
    customers = (
        with_month(valid_sales(orders, need))
        .groupBy("month", "user_id")
        .agg(F.count_distinct("product_id").alias("bought"))
    )
    category = F.least(F.col("bought"), F.lit(cap).cast("long"))
    if merge_tail:
        return (
            customers.groupBy("month", category.alias("category"))
            .agg(F.count(F.lit(1)).alias("num"))
            .orderBy(*ascending("month", "category"))
            .withColumn("month", month_text("month"))
        )
    return (
        customers.groupBy("month", "bought")
        .agg(F.count(F.lit(1)).alias("num"))
        .orderBy(*ascending("month", "bought"))
        .select(month_text("month").alias("month"), category.alias("category"), "num")
    )


def product_growth(orders: DataFrame, products: DataFrame) -> DataFrame:
    """Monthly sales of every product and the growth over its previous month *with sales*."""
    sales = with_month(valid_sales(orders, need=()))
    monthly = sales.groupBy("product_id", "month").agg(
        double_sum(sales, "quantity").alias("sales_num")
    )
    before = F.lag("sales_num").over(Window.partitionBy("product_id").orderBy(*ascending("month")))
    names = products.select(F.col("product_id").cast("string").alias("product_id"), "product_name")
    return (
        monthly.withColumn("before", before)
        # An unknown product has no previous month.
        .withColumn("before", F.when(F.col("product_id").isNotNull(), F.col("before")))
        .join(names, "product_id", "left")
        .orderBy(*ascending("product_id", "month"))
        .select(
            month_text("month").alias("month"),
            "product_id",
            "product_name",
            "sales_num",
            ratio(F.col("sales_num") - F.col("before"), F.col("before")).alias("vspp"),
        )
    )


def calendar_growth(
    orders: DataFrame, product_ids: Sequence[str] | DataFrame | None = None
) -> DataFrame:
    """Monthly sales of a set of products and the growth over the previous *calendar* month.

    The products are a list of ids, a DataFrame with ``product_id``, or all.
    """
    sales = valid_sales(_of_products(orders, product_ids), need=("pay_date", "quantity"))
    monthly = (
        with_month(sales)
        .groupBy("month")
        .agg(double_sum(sales, "quantity").alias("sales_num"))
    )
    # One row per month from here on, so one partition is enough for the window.
    by_month = Window.orderBy("month")
    follows = F.add_months(F.lag("month").over(by_month), 1) == F.col("month")
    before = F.when(follows, F.lag("sales_num").over(by_month))
    return (
        monthly.withColumn("before", before)
        .orderBy(*ascending("month"))
        .select(
            month_text("month").alias("month"),
            "sales_num",
            ratio(F.col("sales_num") - F.col("before"), F.col("before")).alias("vspp"),
        )
    )


def daily_sales(
    orders: DataFrame,
    start: date | str,
    end: date | str,
    product_ids: Sequence[str] | DataFrame | None = None,
) -> DataFrame:
    """Quantity sold per day after ``start`` up to and including ``end``."""
    dated = between_dates(orders, start, end, left_open=True)
    sales = valid_sales(_of_products(dated, product_ids), need=("pay_date", "quantity"))
    return (
        sales.groupBy("pay_date")
        .agg(double_sum(sales, "quantity").alias("sales_num"))
        .orderBy(*ascending("pay_date"))
    )


def monthly_active_rate(orders: DataFrame, month: str | None = None) -> DataFrame:
    """Buyers of a month as a share of all buyers up to and including it.

    For one ``month``, or for every month with sales. A month without buyers has no row.
    """
    sales = valid_sales(orders, need=("pay_date", "user_id"))
    rate = ratio(F.col("month_customer_count"), F.col("before_total_customer_count"))
    if month is not None:
        first_day = month_start(month)
        in_month = (F.col("pay_date") >= first_day).cast("long")
        # One row per customer first: a single shuffle answers both counts.
        customers = (
            sales.filter(F.col("pay_date") < F.add_months(first_day, 1))
            .groupBy("user_id")
            .agg(F.max(in_month).alias("active"))
        )
        counted = customers.agg(
            F.sum("active").alias("month_customer_count"),
            F.count(F.lit(1)).alias("before_total_customer_count"),
        ).filter(F.col("month_customer_count") > 0)
        return counted.select(
            F.lit(month).alias("month"),
            "month_customer_count",
            "before_total_customer_count",
            rate.alias("month_live_rate"),
        )
    visits = with_month(sales).select("user_id", "month").distinct()
    # A customer has at most one row per month here. The window, unlike a second aggregation of
    # the visits, keeps this to one scan of the sales.
    first_month = F.min("month").over(Window.partitionBy("user_id"))
    monthly = (
        visits.withColumn("is_new", (first_month == F.col("month")).cast("long"))
        .groupBy("month")
        .agg(
            F.count(F.lit(1)).alias("month_customer_count"),
            F.sum("is_new").alias("new_customers"),
        )
    )
    # Buyers so far = running sum of new buyers, over one row per month.
    up_to = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        monthly.withColumn("before_total_customer_count", F.sum("new_customers").over(up_to))
        .orderBy(*ascending("month"))
        .select(
            month_text("month").alias("month"),
            "month_customer_count",
            "before_total_customer_count",
            rate.alias("month_live_rate"),
        )
    )


def monthly_customers(orders: DataFrame) -> DataFrame:
    """Distinct buyers of every month."""
    return (
        with_month(valid_sales(orders, need=("pay_date", "product_id")))
        .groupBy("month")
        .agg(F.count_distinct("user_id").alias("customer_count"))
        .orderBy(*ascending("month"))
        .withColumn("month", month_text("month"))
    )


def total_customers(orders: DataFrame) -> DataFrame:
    """Distinct customers of all orders, whatever their status."""
    return orders.agg(F.count_distinct("user_id").alias("customer_count"))


def _of_products(
    orders: DataFrame, product_ids: Sequence[str] | DataFrame | None
) -> DataFrame:
    if product_ids is None:
        return orders
    if isinstance(product_ids, DataFrame):
        return orders.join(product_ids, "product_id", "left_semi")
    return orders_of_products(orders, product_ids)
