"""How well a purchase prediction found the later buyers."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.constants import DEFAULT_P_OBS, SENT
from tillscope.operators.ntile import add_ntile
from tillscope.operators.sales import between_dates, orders_of_products, valid_sales


def lift_by_buyers(
    orders: DataFrame,
    predict: DataFrame,
    start: date | str,
    end: date | str,
    *,
    default_rank: int,
    max_rank: int | None,
    k: int = 10,
) -> DataFrame:
    """Probability mass per tile of the buyers of a period, in the order of their rank.

    Buyers without a prediction take part with ``default_rank`` and probability 0. Buyers ranked
    beyond ``max_rank`` are left out; None leaves out nobody.
    """
    buyers = between_dates(valid_sales(orders, need=()), start, end).select("user_id").distinct()
    ranked = (
        buyers.join(predict.select("user_id", "rank", "p_obs"), "user_id", "left")
        .select(
            "user_id",
            F.coalesce("rank", F.lit(default_rank)).alias("rank"),
            F.coalesce("p_obs", F.lit(DEFAULT_P_OBS)).alias("p_obs"),
        )
    )
    return _mass_per_tile(add_ntile(_up_to(ranked, max_rank), k, [F.col("rank")], "user_id", "grp"))


def lift_by_score(predict: DataFrame, *, max_rank: int | None, k: int = 100) -> DataFrame:
    """Probability mass per tile of a prediction table, highest score first.

    Rows ranked beyond ``max_rank`` are left out; None leaves out nothing.
    """
    ranked = _up_to(predict, max_rank).select("user_id", "score", "p_obs")
    by_score = [F.col("score").isNotNull(), -F.col("score")]  # unknown scores come first
    return _mass_per_tile(add_ntile(ranked, k, by_score, "user_id", "grp"))


def top_rank_sum(predict: DataFrame, n: int) -> DataFrame:
    """Probability mass of the customers ranked up to ``n``, one row."""
    return _mass(predict.filter(F.col("rank") <= n))


def count_buyers(
    orders: DataFrame,
    product_ids: Sequence[str],
    start: date | str,
    end: date | str,
    predict: DataFrame | None = None,
    max_rank: int | None = None,
    min_dates: DataFrame | None = None,
    before: date | str | None = None,
) -> DataFrame:
    """Number of customers who bought listed products in a period, one row.

    With ``predict`` only customers with a prediction count, ranked up to ``max_rank`` unless that
    is None. ``before`` asks for a first order, of any status, before a date: looked up in
    ``min_dates`` (a saved table of first orders) if given, else found in the same pass.
    """
    if before is None or min_dates is not None:
        sold = valid_sales(orders_of_products(orders, product_ids), need=("user_id",))
        buyers = between_dates(sold, start, end).select("user_id").distinct()
        if min_dates is not None:
            buyers = _known_before(buyers, min_dates, before or start)
    else:
        bought = (
            (F.col("order_status") == SENT)
            & F.col("product_id").isin([str(p) for p in product_ids])
            & F.col("pay_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
        )
        buyers = _first_and_bought(orders, bought, before)
    if predict is not None:
        buyers = buyers.join(_up_to(predict, max_rank), "user_id", "left_semi")
    return buyers.agg(F.count(F.lit(1)).alias("customer_count"))


def customers_before(
    orders: DataFrame, day: date | str, min_dates: DataFrame | None = None
) -> DataFrame:
    """Number of customers with a sale before a day, one row; ``min_dates`` also asks for a first
    order before it."""
    sold = valid_sales(orders, need=("user_id",)).filter(F.col("pay_date") < F.lit(day).cast("date"))
    buyers = sold.select("user_id").distinct()
    if min_dates is not None:
        buyers = _known_before(buyers, min_dates, day)
    return buyers.agg(F.count(F.lit(1)).alias("customer_count"))


def returning_customers(orders: DataFrame, day: date | str) -> DataFrame:
    """Number of customers with a sale and a first order, of any status, before a day; one pass."""
    sold = (F.col("order_status") == SENT) & (F.col("pay_date") < F.lit(day).cast("date"))
    return _first_and_bought(orders, sold, day).agg(F.count(F.lit(1)).alias("customer_count"))


def _first_and_bought(orders: DataFrame, bought: Column, before: date | str) -> DataFrame:
    """Customers with a line that meets a condition and a first order before a date: one scan."""
    customers = orders.filter(F.col("user_id").isNotNull()).groupBy("user_id").agg(
        F.min("pay_date").alias("min_date"), F.max(F.coalesce(bought, F.lit(False))).alias("bought")
    )
    early = F.col("min_date") < F.lit(before).cast("date")
    return customers.filter(F.col("bought") & early).select("user_id")


def _up_to(predict: DataFrame, max_rank: int | None) -> DataFrame:
    return predict if max_rank is None else predict.filter(F.col("rank") <= max_rank)


def _known_before(buyers: DataFrame, min_dates: DataFrame, before: date | str) -> DataFrame:
    earlier = min_dates.filter(F.col("min_date") < F.lit(before).cast("date"))
    return buyers.join(earlier, "user_id", "left_semi")


def _mass_per_tile(tiled: DataFrame) -> DataFrame:
    return tiled.groupBy("grp").agg(_exact_mass().alias("p_obs_sum")).orderBy("grp")


def _mass(predict: DataFrame) -> DataFrame:
    return predict.agg(_exact_mass().alias("p_obs_sum"))


def _exact_mass() -> Column:
    """Sum of probabilities to 15 places: the same whatever the order of the additions."""
    return F.sum(F.col("p_obs").cast("decimal(20,15)")).cast("double")
