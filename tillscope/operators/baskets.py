"""Products bought together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.functions import double_sum
from tillscope.operators.sales import valid_sales
from tillscope.sources import written_table


def basket_lines(orders: DataFrame, product_id: str) -> DataFrame:
    """All sold lines of the orders that contain a product, the product's own lines included.

    The order ids are reduced to one each and written first. Their size is then known: Catalyst
    broadcasts them if they are few, and otherwise joins by a shuffle in which an order holding
    a large share of the lines is split by adaptive execution.
    """
    lines = valid_sales(orders, need=("quantity", "pay_amt", "order_id", "product_id"))
    holding = lines.filter(F.col("product_id") == product_id).select("order_id").distinct()
    return lines.join(written_table(holding, "basket"), "order_id", "left_semi").select(
        "order_id", "product_id", "quantity", "pay_amt"
    )


def co_purchase(orders: DataFrame, products: DataFrame, product_id: str) -> DataFrame:
    """Products in the orders that contain a product: lines, quantity and amount, most lines first.

    ``order_count`` counts order lines, not orders. A quantity is rounded to a whole number, halves
    to the even one.
    """
    lines = basket_lines(orders, product_id)
    by_product = lines.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("order_count"),
        F.sum(F.bround("quantity").cast("long")).alias("quantity_count"),
        double_sum(lines, "pay_amt").alias("pay_amt_count"),
    )
    names = products.select(F.col("product_id").cast("string").alias("product_id"), "product_name")
    return (
        by_product.join(names, "product_id")
        .select("product_id", "product_name", "order_count", "quantity_count", "pay_amt_count")
        .orderBy(F.desc("order_count"), "product_id")
    )


def orders_with_pair(orders: DataFrame, product_a: str, product_b: str) -> DataFrame:
    """Orders that hold both products, one row each.

    One aggregation of the lines of both products replaces a join of the lines with each other.
    ``line_pairs`` is the number of rows that join would have; they are counted, not produced.
    """
    lines = orders.filter(
        F.col("product_id").isin(product_a, product_b) & F.col("order_id").isNotNull()
    )
    sides = []
    for side, product in (("a", product_a), ("b", product_b)):
        mine = F.when(F.col("product_id") == product, True)
        sides += [
            F.count(mine).alias(f"{side}_lines"),
            double_sum(lines, "quantity", mine).alias(f"{side}_quantity"),
            double_sum(lines, "pay_amt", mine).alias(f"{side}_pay_amt"),
        ]
    return (
        lines.groupBy("order_id")
        .agg(*sides)
        .filter((F.col("a_lines") > 0) & (F.col("b_lines") > 0))
        .withColumn("line_pairs", F.col("a_lines") * F.col("b_lines"))
    )


def pair_lines(orders: DataFrame, product_a: str, product_b: str) -> DataFrame:
    """All lines of both products in the orders that hold both, each line once.

    ``partner_lines`` says how many lines of the other product the order holds, i.e. in how many
    line pairs the line takes part.
    """
    counts = orders_with_pair(orders, product_a, product_b).select(
        "order_id", "a_lines", "b_lines"
    )
    partners = F.when(F.col("product_id") == product_a, F.col("b_lines")).otherwise(
        F.col("a_lines")
    )
    lines = orders.filter(F.col("product_id").isin(product_a, product_b))
    return (
        lines.join(written_table(counts, "pair"), "order_id")
        .withColumn("partner_lines", partners)
        .select(*orders.columns, "partner_lines")
    )
