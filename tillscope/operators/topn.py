"""Best sellers with one row for everything else.

What is left over is the total minus the best rows, so it needs no second look at the products: the
totals are one row per month, and sums of decimals and counts are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillscope.constants import OTHERS_ALL_TIME, OTHERS_MONTHLY
from tillscope.functions import ascending, month_text
from tillscope.operators.sales import with_month

#: What products are ranked by: quantities are added as decimals, exact to six places.
MEASURES = ("quantity", "lines")


def top_products(sales: DataFrame, n: int = 5, label: str = OTHERS_ALL_TIME) -> DataFrame:
    """Top ``n`` products by quantity over all time; row ``n + 1`` sums up the others.

    The last row is always there; its count is NULL if no product is left over.
    """
    counts = sales.groupBy("product_id").agg(_measured("quantity").alias("count"))
    first = counts.orderBy(*_best_first("count")).limit(n)
    ranked = first.select(
        F.row_number().over(Window.orderBy(*_best_first("count"))).alias("orders"),
        "product_id",
        "count",
    )
    rest = _left_over(counts, first, "count", []).select(
        F.lit(n + 1).alias("orders"), F.lit(label).alias("product_id"), "count"
    )
    result = ranked.unionByName(rest).orderBy("orders")
    return result.withColumn("count", F.col("count").cast("double"))


def monthly_top_products(
    sales: DataFrame,
    n: int = 5,
    measure: str = "quantity",
    value: str = "count",
    label: str = OTHERS_MONTHLY,
) -> DataFrame:
    """Top ``n`` products of every month; row ``n + 1`` sums up the others, where there are any.

    ``measure`` is ``quantity``, the quantity sold, or ``lines``, the number of order lines.
    """
    if measure not in MEASURES:
        raise ValueError(f"measure is one of {', '.join(MEASURES)}: only what adds up has a rest")
    counts = with_month(sales).groupBy("month", "product_id").agg(_measured(measure).alias(value))
    by_month = Window.partitionBy("month").orderBy(*_best_first(value))
    first = counts.withColumn("orders", F.row_number().over(by_month)).filter(
        F.col("orders") <= n
    )
    others = (
        _left_over(counts, first, value, ["month"])
        .filter("_rows > 0")
        .select(F.lit(n + 1).alias("orders"), "month", F.lit(label).alias("product_id"), value)
    )
    result = first.select("orders", "month", "product_id", value).unionByName(others)
    kind = "double" if measure == "quantity" else "long"
    return (
        result.orderBy(*ascending("month", "orders"))
        .withColumn("month", month_text("month"))
        .withColumn(value, F.col(value).cast(kind))
    )


def monthly_top_named(
    sales: DataFrame, products: DataFrame, n: int = 5, label: str = OTHERS_MONTHLY
) -> DataFrame:
    """Monthly top ``n`` by number of order lines, with product names.

    Products missing from the dimension get the label of the others row.
    """
    top = monthly_top_products(sales, n, "lines", "num", label)
    names = products.select(F.col("product_id").cast("string").alias("product_id"), "product_name")
    return (
        top.join(names, "product_id", "left")
        .select(
            "orders",
            "month",
            F.coalesce("product_name", F.lit(label)).alias("product_name"),
            "num",
        )
        .orderBy(*ascending("month", "orders"))
    )


def _measured(measure: str) -> Column:
    return F.count(F.lit(1)) if measure == "lines" else F.sum(F.col("quantity").cast("decimal(24,6)"))


def _best_first(value: str) -> list[Column]:
    """Largest first, NULL before all, ties by product id."""
    return [F.col(value).desc_nulls_first(), F.col("product_id").asc_nulls_last()]


def _left_over(counts: DataFrame, first: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Sum and number of the rows of ``counts`` that are not in ``first``, per group.

    The totals of all rows minus those of the first ones, one row per group on either side. The sum
    is NULL if no row that is left has a value.
    """
    sides = [
        rows.groupBy(*by).agg(
            (sign * F.coalesce(F.sum(value), F.lit(0))).alias("_sum"),
            (sign * F.count(value)).alias("_known"),
            (sign * F.count(F.lit(1))).alias("_rows"),
        )
        for rows, sign in ((counts, F.lit(1)), (first, F.lit(-1)))
    ]
    return sides[0].unionByName(sides[1]).groupBy(*by).agg(
        F.when(F.sum("_known") > 0, F.sum("_sum")).alias(value), F.sum("_rows").alias("_rows")
    )
