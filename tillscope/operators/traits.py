"""What is known about each customer: order value, silence and purchase frequency."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.constants import DAYS_PER_MONTH
from tillscope.functions import double_sum, ratio, whole_days
from tillscope.sources import register_view, save_view, written_table

TRAITS = ("order_avg", "activity", "frequency")

TRAITS_COMMENT = "customer traits"
TRAIT_COMMENTS = {
    "user_id": "customer id",
    "order_avg": "money per order",
    "activity": "days since the last order",
    "frequency": "orders per month",
}


def user_min_order_date(orders: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """First order date of every customer, whatever the order status.

    ``within`` limits the customers to those in another table. Where the result is used often, save
    it bucketed by ``user_id`` with ``save_table``: joins on the customer then do not shuffle it.
    """
    first = orders.groupBy("user_id").agg(F.min("pay_date").alias("min_date"))
    if within is None:
        return first
    # After the aggregation: one row per customer takes part in the join.
    return first.join(within.select("user_id"), "user_id", "left_semi")


def user_totals(sales: DataFrame) -> DataFrame:
    """Orders, money, first and last sale of every customer."""
    return sales.groupBy("user_id").agg(
        F.count_distinct("order_id").alias("order_count"),
        double_sum(sales, "pay_amt").alias("total_money"),
        F.min("pay_date").alias("first_date"),
        F.max("pay_date").alias("last_date"),
    )


def user_traits(
    sales: DataFrame,
    audience: DataFrame | None = None,
    max_date: date | None = None,
    span_days: int | None = None,
) -> DataFrame:
    """Traits of every customer, or of an audience given as a table of ``user_id``.

    ``order_avg`` is money per order, ``activity`` the days from the customer's last sale to the
    last sale of all, ``frequency`` the orders per 30 days of the whole sales period. The last date
    and the length of the period come from all sales, even for an audience, unless given.

    The sales are scanned once into one row per customer. If a date has to be found, those rows are
    written to the shared folder and read for it; with both dates given nothing is written. The
    traits are a projection of the rows; an audience is joined to them, so a customer with very
    many lines is one row by then.
    """
    totals = user_totals(sales)
    if max_date is None or span_days is None:
        totals = written_table(totals, "totals")
    if audience is None:
        return traits_of_totals(totals, totals, max_date, span_days)
    members = audience.select("user_id").distinct()
    return traits_of_totals(totals.join(members, "user_id", "right"), totals, max_date, span_days)


def traits_of_totals(
    members: DataFrame,
    totals: DataFrame,
    max_date: date | None = None,
    span_days: int | None = None,
) -> DataFrame:
    """Traits of the customers in ``members``, rows of the columns of ``user_totals``.

    The last date and the length of the period, unless given, are those of ``totals``, a stored
    table of one row per customer. A customer without sales has no order value and silence.
    """
    if max_date is None or span_days is None:
        row = totals.agg(F.max("last_date").alias("last"), F.min("first_date").alias("first")).first()
        if max_date is None:
            max_date = row["last"]
        if span_days is None and row["last"] is not None:
            span_days = (row["last"] - row["first"]).days
    months = None if span_days is None else span_days / DAYS_PER_MONTH
    order_count = F.coalesce("order_count", F.lit(0))
    return members.select(
        "user_id",
        ratio(F.col("total_money"), order_count).alias("order_avg"),
        whole_days(F.lit(max_date).cast("date"), F.col("last_date")).alias("activity"),
        ratio(order_count, F.lit(months).cast("double")).alias("frequency"),
    )


def save_users_trait(traits: DataFrame, view: str, table: str, path: str | None = None) -> DataFrame:
    """Save the traits as a table and a catalog view of it, with comments on the view and its columns."""
    return save_view(traits, view, table, TRAITS_COMMENT, TRAIT_COMMENTS, path)


def register_users_trait(traits: DataFrame, name: str = "users_trait") -> DataFrame:
    """Register the traits as a view with a comment on every column."""
    return register_view(traits, name, TRAIT_COMMENTS)
