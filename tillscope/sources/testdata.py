"""The logical tables of the operators, mapped from the generated star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tillscope.constants import SENT
from tillscope.sources.tables import modified_at

_schemas: dict[tuple, StructType] = {}


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table whose schema is looked up in the files once for each version of the path."""
    path = f"{folder}/{name}.parquet"
    key = (path, modified_at(spark, path))
    if key not in _schemas:
        _schemas[key] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[key]).parquet(path)


def order_lines(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order line."""
    orders = _read(spark, folder, "orders")
    lines = _read(spark, folder, "lineitem")
    status = F.when(F.col("o_orderstatus") == "F", SENT).otherwise(F.col("o_orderstatus"))
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("user_id"),
        # An expression, not the join key itself: aggregations by order then shuffle what they have
        # reduced map-side, and adaptive execution may split an order that fills a join partition.
        F.greatest("l_orderkey", "o_orderkey").alias("order_id"),
        F.col("l_partkey").cast("string").alias("product_id"),
        F.col("o_orderdate").cast("date").alias("pay_date"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("pay_amt"),
        status.alias("order_status"),
    )


def products(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category_1"),
        F.col("p_brand").alias("category_2"),
    )


def clients(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_nationkey").cast("string").alias("address_1"),
    )


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Only customers in credit are scored, so some buyers have no prediction."""
    return (
        _read(spark, folder, "customer")
        .filter(F.col("c_acctbal") > 0)
        .select(
            F.col("c_custkey").alias("user_id"),
            (F.col("c_custkey") + 1).cast("int").alias("rank"),
            (F.lit(1.0) / (F.col("c_custkey") + 1)).alias("score"),
            ((F.col("c_custkey") % 97).cast("double") / 100).alias("p_obs"),
        )
    )


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    """One campaign per part: ``job_<p>`` promotes the parts p .. p+4, as JSON text."""
    key = F.col("p_partkey")
    items = F.array(*[(key + step).cast("string") for step in range(5)])
    return _read(spark, folder, "part").select(
        F.concat(F.lit("job_"), key.cast("string")).alias("name"),
        F.concat(F.lit('["'), F.array_join(items, '","'), F.lit('"]')).alias("products"),
    )


def job_windows(spark: SparkSession, folder: str) -> DataFrame:
    """One campaign month per order month, half a year later: early, usual and late starts."""
    month = F.trunc(F.col("o_orderdate").cast("date"), "month")
    start = F.add_months(F.col("month"), 6)
    return (
        _read(spark, folder, "orders")
        .select(month.alias("month"))
        .distinct()
        .select(
            F.concat(F.lit("job_"), F.date_format("month", "yyyy-MM")).alias("name"),
            start.alias("start_date"),
            F.last_day(start).alias("finish_date"),
        )
    )


def first_filters(spark: SparkSession, folder: str) -> DataFrame:
    """The first filter setting of every campaign."""
    return _read(spark, folder, "part").select(
        F.concat(F.lit("job_"), F.col("p_partkey").cast("string")).alias("job_id"),
        (F.col("p_size") * 100).cast("string").alias("filter_name"),
    )
