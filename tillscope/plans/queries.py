"""Every operator as a query over the tables of a folder, with fixed example parameters."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope import operators as op
from tillscope.functions import comparable
from tillscope.sources import testdata as data
from tillscope.constants import MONTH_PART
from tillscope.sources import (
    intermediate_name,
    intermediate_path,
    key_part,
    save_by_month,
    save_by_part,
    save_table,
    update_in_place,
    update_where,
)

MONTH = "1998-04"
YEAR_START, YEAR_END = "1998-01-01", "1998-12-31"
RANGE_START, RANGE_END = "1998-01-01", "1998-06-30"
DAY = "1998-04-18"
CATEGORY_1, CATEGORY_2 = "ECONOMY", "Brand#2"
PRODUCT, PAIR = "5", ("40", "91")
PRODUCTS = ["1", "2", "3", "4", "5"]
JOB = "job_1"
CAMPAIGN = [str(p) for p in range(1, 61)]
CAMPAIGN_START, CAMPAIGN_END = "1996-01-01", "1996-12-31"
ADDRESSES = "[2, 3]"
TOP_RANK = 1000
# Parameters of the lift curves: the rank cut, and the rank of buyers without a prediction.
MAX_RANK, DEFAULT_RANK = 50000, 27511
AS_OF = date(2002, 1, 1)
# Campaigns that start in the second half of 1997, as a filter on their names.
WINDOWS_FROM, WINDOWS_TO = "job_1997-01", "job_1997-06"
# Folders of the campaigns' filter settings.
FILTER_PARTS = 8

Query = Callable[[SparkSession, str], DataFrame]


def sales_of(spark: SparkSession, folder: str, *extra: str) -> DataFrame:
    """Valid sales with the columns the traits need."""
    need = ("user_id", "order_id", "pay_date", "pay_amt", *extra)
    return op.valid_sales(data.order_lines(spark, folder), need)


def min_dates_of(spark: SparkSession, folder: str) -> DataFrame:
    return op.user_min_order_date(data.order_lines(spark, folder))


def audience_by_prediction(spark: SparkSession, folder: str) -> DataFrame:
    return op.audience_by_prediction(
        sales_of(spark, folder, "product_id"),
        min_dates_of(spark, folder),
        data.predictions(spark, folder),
        data.clients(spark, folder),
        before=YEAR_START,
        top=TOP_RANK,
        addresses=ADDRESSES,
        start=YEAR_START,
        end=YEAR_END,
    )


def audience_by_products(spark: SparkSession, folder: str) -> DataFrame:
    return op.audience_by_products(
        sales_of(spark, folder, "product_id"),
        min_dates_of(spark, folder),
        data.jobs(spark, folder),
        JOB,
        before=YEAR_START,
    )


def traits_of(spark: SparkSession, folder: str) -> DataFrame:
    return op.user_traits(sales_of(spark, folder))


def campaign_traits(spark: SparkSession, folder: str, predicted: bool) -> DataFrame:
    """Traits of a campaign's audience, from one scan of the order lines."""
    lines = data.order_lines(spark, folder)
    if predicted:
        customers = op.campaign_customers(lines, start=YEAR_START, end=YEAR_END)
        members = op.predicted_buyers(
            customers, data.predictions(spark, folder), data.clients(spark, folder),
            before=YEAR_START, top=TOP_RANK, addresses=ADDRESSES,
        )
    else:
        customers = op.campaign_customers(lines, op.job_products(data.jobs(spark, folder), JOB))
        members = op.buyers_of_listed(customers, before=YEAR_START)
    return op.traits_of_totals(members, customers)


def users_trait(spark: SparkSession, folder: str) -> DataFrame:
    return op.register_users_trait(traits_of(spark, folder))


def lines_by_month(spark: SparkSession, folder: str) -> DataFrame:
    """The order lines, saved in a folder per month."""
    return save_by_month(data.order_lines(spark, folder), intermediate_path(spark, "by-month"))


def rewritten_filters(spark: SparkSession, folder: str) -> DataFrame:
    """The filter settings after one campaign's was changed where they are stored."""
    path = intermediate_path(spark, "filters")
    stored = data.first_filters(spark, folder).withColumn("part", key_part("job_id", FILTER_PARTS))
    save_by_part(stored, path, "part")
    of_job = (F.col("part") == key_part(F.lit(JOB), FILTER_PARTS)) & (F.col("job_id") == JOB)
    update_in_place(spark, path, "part", of_job, "filter_name", "500")
    return spark.read.schema(stored.schema).parquet(path).drop("part")


def saved_first_orders(spark: SparkSession, folder: str) -> DataFrame:
    """The first order dates, saved in as many buckets as a join on the customer has partitions."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = intermediate_path(spark, "first-orders")
    return save_table(min_dates_of(spark, folder), intermediate_name("first_orders"), ["user_id"], buckets, path=path)


def known_buyers_from_saved(spark: SparkSession, folder: str) -> DataFrame:
    """Buyers of a job who ordered before, by the saved first order dates."""
    sales, jobs = sales_of(spark, folder, "product_id"), data.jobs(spark, folder)
    return op.audience_by_products(sales, saved_first_orders(spark, folder), jobs, JOB, before=YEAR_START)


def targeted_buyers_from_saved(spark: SparkSession, folder: str) -> DataFrame:
    """Buyers of a campaign with a prediction who ordered before, by the saved first order dates."""
    return op.count_buyers(
        data.order_lines(spark, folder), CAMPAIGN, CAMPAIGN_START, CAMPAIGN_END,
        predict=data.predictions(spark, folder), max_rank=TOP_RANK,
        min_dates=saved_first_orders(spark, folder), before=CAMPAIGN_START,
    )


def users_trait_saved(spark: SparkSession, folder: str) -> DataFrame:
    """The traits through a lasting view of the stored rows."""
    path = intermediate_path(spark, "traits")
    table, view = intermediate_name("traits"), intermediate_name("users_trait", "VIEW")
    return op.save_users_trait(traits_of(spark, folder), view, table, path)


def sales_of_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Lines, quantity and money within the window of each of some campaigns."""
    windows = data.job_windows(spark, folder).filter(F.col("name").between(WINDOWS_FROM, WINDOWS_TO))
    lines = op.orders_in_windows(lines_by_month(spark, folder), windows)
    return lines.groupBy("name").agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum("pay_amt").cast("decimal(38,2)").alias("money"),
        F.min("pay_date").alias("first_date"),
        F.max("pay_date").alias("last_date"),
    )


def _registered() -> dict[str, Query]:
    lines, products = data.order_lines, data.products
    predict, jobs = data.predictions, data.jobs

    def named_counts(s: SparkSession, d: str) -> DataFrame:
        sales = op.valid_sales(lines(s, d), ("pay_date", "product_id"))
        return op.monthly_top_named(sales, products(s, d))

    def category_of_range(s: SparkSession, d: str) -> DataFrame:
        dated = op.orders_in_range(lines(s, d), RANGE_START, RANGE_END)
        return op.category_orders(dated, products(s, d), CATEGORY_1, CATEGORY_2)

    def category_of_day(s: SparkSession, d: str) -> DataFrame:
        dated = op.orders_on_day(lines(s, d), DAY)
        return op.category_orders(dated, products(s, d), CATEGORY_1)

    def growth_of_category(s: SparkSession, d: str) -> DataFrame:
        wanted = op.products_in_category(products(s, d), CATEGORY_1)
        return op.calendar_growth(lines(s, d), wanted)

    def buyers(s: SparkSession, d: str, predicted: bool, earlier: bool) -> DataFrame:
        return op.count_buyers(
            lines(s, d),
            CAMPAIGN,
            CAMPAIGN_START,
            CAMPAIGN_END,
            predict=predict(s, d) if predicted else None,
            max_rank=TOP_RANK,
            before=CAMPAIGN_START if earlier else None,
        )

    registered: dict[str, Query] = {
        # sales and their dates
        "valid_sales": lambda s, d: sales_of(s, d),
        "orders_in_range": lambda s, d: op.orders_in_range(lines(s, d), RANGE_START, RANGE_END),
        "orders_on_day": lambda s, d: op.orders_on_day(lines(s, d), DAY),
        "orders_of_products": lambda s, d: op.orders_of_products(lines(s, d), PRODUCTS),
        "category_orders": category_of_range,
        "category_orders_on_day": category_of_day,
        "date_bounds": lambda s, d: op.date_bounds(lines(s, d)),
        "last_date": lambda s, d: op.last_date(lines(s, d)),
        "customer_tenure": lambda s, d: op.customer_tenure(lines(s, d), AS_OF),
        "update_where": lambda s, d: update_where(
            data.first_filters(s, d), F.col("job_id") == JOB, "filter_name", "500"
        ),
        "rewritten_filters": rewritten_filters,
        "known_buyers_from_saved": known_buyers_from_saved,
        "targeted_buyers_from_saved": targeted_buyers_from_saved,
        "orders_in_range_by_month": lambda s, d: op.orders_in_range(
            lines_by_month(s, d), RANGE_START, RANGE_END
        ).drop(MONTH_PART),
        "daily_sales_by_month": lambda s, d: op.daily_sales(
            lines_by_month(s, d), RANGE_START, RANGE_END, [PRODUCT]
        ),
        "sales_of_windows": sales_of_windows,
        "predict_row_count": lambda s, d: op.row_count(predict(s, d)),
        # best sellers
        "topn_with_others": lambda s, d: op.top_products(op.valid_sales(lines(s, d), ())),
        "monthly_topn": lambda s, d: op.monthly_top_products(op.valid_sales(lines(s, d), ())),
        "monthly_topn_named": named_counts,
        # trends
        "monthly_order_value": lambda s, d: op.monthly_order_value(lines(s, d)),
        "monthly_order_value_with_nulls": lambda s, d: op.monthly_order_value(
            lines(s, d), drop_nulls=False
        ),
        "purchase_breadth": lambda s, d: op.purchase_breadth(lines(s, d)),
        "purchase_breadth_unmerged": lambda s, d: op.purchase_breadth(
            lines(s, d), merge_tail=False, drop_nulls=True
        ),
        "product_monthly_growth": lambda s, d: op.product_growth(lines(s, d), products(s, d)),
        "calendar_monthly_growth": lambda s, d: op.calendar_growth(lines(s, d), [PRODUCT]),
        "calendar_growth_of_category": growth_of_category,
        "daily_sales": lambda s, d: op.daily_sales(
            lines(s, d), RANGE_START, RANGE_END, [PRODUCT]
        ),
        "daily_sales_all": lambda s, d: op.daily_sales(lines(s, d), RANGE_START, RANGE_END),
        "active_rate_month": lambda s, d: op.monthly_active_rate(lines(s, d), MONTH),
        "active_rate_all": lambda s, d: op.monthly_active_rate(lines(s, d)),
        "monthly_customers": lambda s, d: op.monthly_customers(lines(s, d)),
        "total_customers": lambda s, d: op.total_customers(lines(s, d)),
        # baskets
        "basket_with_product": lambda s, d: op.basket_lines(lines(s, d), PRODUCT),
        "co_purchase": lambda s, d: op.co_purchase(lines(s, d), products(s, d), PRODUCT),
        "orders_with_pair": lambda s, d: op.orders_with_pair(lines(s, d), *PAIR),
        "pair_lines": lambda s, d: op.pair_lines(lines(s, d), *PAIR),
        # customers
        "user_min_order_date": min_dates_of,
        "min_date_of_predicted": lambda s, d: op.user_min_order_date(lines(s, d), predict(s, d)),
        "users_trait": users_trait,
        "users_trait_saved": users_trait_saved,
        "trait_percentile_curve": lambda s, d: op.trait_percentile_curve(traits_of(s, d)),
        # campaigns
        "prediction_window": lambda s, d: op.prediction_window(
            op.date_bounds(lines(s, d)), data.job_windows(s, d)
        ),
        "job_products": lambda s, d: op.job_products(jobs(s, d)),
        "job_buyers": lambda s, d: op.job_buyers(lines(s, d), jobs(s, d), JOB),
        "audience_by_prediction": audience_by_prediction,
        "audience_by_products": audience_by_products,
        # lift
        "lift_deciles": lambda s, d: op.lift_by_buyers(
            lines(s, d), predict(s, d), YEAR_START, YEAR_END,
            default_rank=DEFAULT_RANK, max_rank=MAX_RANK,
        ),
        "lift_percentiles": lambda s, d: op.lift_by_score(predict(s, d), max_rank=MAX_RANK),
        "top_rank_p_obs": lambda s, d: op.top_rank_sum(predict(s, d), TOP_RANK),
        "targeted_repeat_buyers": lambda s, d: buyers(s, d, predicted=True, earlier=True),
        "targeted_buyers": lambda s, d: buyers(s, d, predicted=True, earlier=False),
        "repeat_buyers": lambda s, d: buyers(s, d, predicted=False, earlier=True),
        "returning_customers": lambda s, d: op.returning_customers(lines(s, d), YEAR_START),
        "customers_before": lambda s, d: op.customers_before(lines(s, d), YEAR_START),
    }

    for trait in ("order_avg", "activity", "frequency"):
        trim = 3 if trait == "order_avg" else None
        # Order values of a campaign are grouped for the predicted audience, the rest for buyers.
        predicted = trait == "order_avg"
        registered |= {
            f"{trait}_equal_count": lambda s, d, t=trait: op.equal_count_groups(traits_of(s, d), t),
            f"{trait}_equal_width": lambda s, d, t=trait, x=trim: op.equal_width_groups(
                traits_of(s, d), t, trim_sigma=x
            ),
            f"job_{trait}_equal_count": lambda s, d, t=trait, p=predicted: op.equal_count_groups(
                campaign_traits(s, d, p), t
            ),
            f"job_{trait}_equal_width": lambda s, d, t=trait: op.equal_width_groups(
                campaign_traits(s, d, predicted=False), t
            ),
        }
    return registered


#: Columns of quotients and means, which are compared to six places; all others exactly.
RATIOS = (
    "total_user_order_avg", "vspp", "month_live_rate", "order_avg", "frequency",
    "order_avg_avg", "activity_avg", "frequency_avg",
)


def _comparable(query: Query) -> Query:
    return lambda spark, folder: comparable(query(spark, folder), RATIOS)


QUERIES: dict[str, Query] = {name: _comparable(query) for name, query in _registered().items()}
