"""Campaign jobs: their products, buyers, audiences and training windows."""

from __future__ import annotations

import json
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.constants import SENT
from tillscope.functions import double_sum, json_items
from tillscope.operators.sales import between_dates, orders_of_listed
from tillscope.sources import written_table


def job_products(jobs: DataFrame, name: str | None = None) -> DataFrame:
    """One row per entry of the JSON product list of a job, or of all jobs."""
    chosen = jobs if name is None else jobs.filter(F.col("name") == name)
    return chosen.select("name", F.explode(json_items(F.col("products"))).alias("product_id"))


def job_buyers(orders: DataFrame, jobs: DataFrame, name: str) -> DataFrame:
    """Customers who ordered a product of the job, one row per order line, of any status."""
    return _lines_of_job(orders, jobs, name).select("user_id")


def campaign_customers(
    orders: DataFrame,
    product_ids: DataFrame | None = None,
    start: date | str | None = None,
    end: date | str | None = None,
) -> DataFrame:
    """All that a campaign asks about each customer, in one scan of the order lines.

    Per customer: ``order_count``, ``total_money``, ``first_date`` and ``last_date`` of the valid
    sales of known products, ``min_date`` (first order of any status), ``bought_listed`` (a sale of
    a product in ``product_ids``, a table with ``product_id`` as text) and ``bought_in_period`` (a
    sale from ``start`` to ``end``). The rows are written once; audiences and traits are filters and
    projections of them. The lines are reduced per customer and order first, map-side, so neither a
    hot customer nor a hot order travels.
    """
    need = ("user_id", "order_id", "pay_date", "pay_amt", "product_id")
    sold = F.col("order_status") == SENT
    for column in need:
        sold = sold & F.col(column).isNotNull()
    sold = F.coalesce(sold, F.lit(False))
    lines, listed = orders, F.lit(False)
    if product_ids is not None:
        # Written, so that the join reads it directly: adaptive execution can then split a hot
        # product, and Catalyst knows whether the list is small enough to broadcast.
        distinct = written_table(product_ids.select("product_id").dropna().distinct(), "listed")
        marks = distinct.withColumn("_listed", F.lit(True))
        lines, listed = orders.join(marks, "product_id", "left"), F.coalesce("_listed", F.lit(False))
    dated = F.lit(False)
    if start is not None and end is not None:
        dated = F.col("pay_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    customers = lines.filter(F.col("user_id").isNotNull()).groupBy("user_id").agg(
        F.count_distinct(F.when(sold, F.col("order_id"))).alias("order_count"),
        double_sum(lines, "pay_amt", sold).alias("total_money"),
        F.min(F.when(sold, F.col("pay_date"))).alias("first_date"),
        F.max(F.when(sold, F.col("pay_date"))).alias("last_date"),
        F.min("pay_date").alias("min_date"),
        F.max(sold & listed).alias("bought_listed"),
        F.max(F.coalesce(sold & dated, F.lit(False))).alias("bought_in_period"),
    )
    return written_table(customers, "campaign")


def buyers_of_listed(customers: DataFrame, before: date | str) -> DataFrame:
    """Of the campaign's customers those who bought a listed product and first ordered earlier."""
    return _known_before(customers.filter("bought_listed"), before)


def predicted_buyers(
    customers: DataFrame,
    predict: DataFrame,
    clients: DataFrame,
    before: date | str,
    top: int,
    addresses: str,
) -> DataFrame:
    """Of the campaign's customers the buyers of the period that ``audience_by_prediction`` finds."""
    buyers = _known_before(customers.filter("bought_in_period"), before)
    return _ranked_and_local(buyers, predict, clients, top, addresses)


def audience_by_products(
    sales: DataFrame, min_dates: DataFrame, jobs: DataFrame, name: str, before: date | str
) -> DataFrame:
    """Buyers of the job's products whose first order is before a date."""
    buyers = _lines_of_job(sales, jobs, name).select("user_id").distinct()
    return buyers.join(_known_before(min_dates, before), "user_id", "left_semi")


def audience_by_prediction(
    sales: DataFrame,
    min_dates: DataFrame,
    predict: DataFrame,
    clients: DataFrame,
    before: date | str,
    top: int,
    addresses: str,
    start: date | str,
    end: date | str,
) -> DataFrame:
    """Buyers of a period who ordered before, are ranked high and live at a listed address.

    ``addresses`` is a JSON array held as text. The buyers are reduced to one row each before the
    joins, so a customer with very many lines weighs no more than any other.
    """
    buyers = between_dates(sales, start, end).select("user_id").distinct()
    known = buyers.join(_known_before(min_dates, before), "user_id", "left_semi")
    return _ranked_and_local(known, predict, clients, top, addresses)


def _ranked_and_local(
    buyers: DataFrame, predict: DataFrame, clients: DataFrame, top: int, addresses: str
) -> DataFrame:
    wanted = [a if isinstance(a, str) else json.dumps(a) for a in json.loads(addresses)]
    local = clients.filter(F.col("address_1").isin(wanted))
    ranked = buyers.join(predict.filter(F.col("rank") <= top), "user_id", "left_semi")
    return ranked.join(local, "user_id", "left_semi")


def prediction_window(bounds: DataFrame, job_windows: DataFrame) -> DataFrame:
    """The year of orders a prediction may learn from, per job.

    It ends the day before the job starts, or with the last order if the job starts after it, and
    begins a year earlier, or with the first order. ``bounds`` is the row of ``date_bounds``.
    """
    first = bounds.select("min_date").scalar()
    last = bounds.select("max_date").scalar()
    start = F.col("start_date")
    return (
        job_windows.withColumn(
            "max_pay_date", F.when(start > last, last).otherwise(F.date_sub(start, 1))
        )
        .withColumn("min_pay_date", F.greatest(first, F.add_months("max_pay_date", -12)))
        .select("name", "start_date", "finish_date", "min_pay_date", "max_pay_date")
    )


def _lines_of_job(orders: DataFrame, jobs: DataFrame, name: str) -> DataFrame:
    """Order lines of the job's products: one semi join, whatever the length of the list."""
    return orders_of_listed(orders, job_products(jobs, name).select("product_id").dropna())


def _known_before(min_dates: DataFrame, before: date | str) -> DataFrame:
    return min_dates.filter(F.col("min_date") < F.lit(before).cast("date"))
