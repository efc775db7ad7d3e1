"""Columns, their order and their types: what the operators return before any rounding for SQL."""

from __future__ import annotations

import pytest

from tillscope.plans import queries

LINES = (
    "user_id bigint, order_id bigint, product_id string, pay_date date, quantity double,"
    " pay_amt decimal(18,2), order_status string"
)
GROUPS = "range string, left_range decimal(10,2), right_range decimal(10,2), {} double, {} double, count bigint"
RATE = "month string, month_customer_count bigint, before_total_customer_count bigint, month_live_rate double"
BY_TRAIT = {
    "order_avg": GROUPS.format("activity_avg", "frequency_avg"),
    "activity": GROUPS.format("order_avg_avg", "frequency_avg"),
    "frequency": GROUPS.format("order_avg_avg", "activity_avg"),
}

SCHEMAS = {
    **dict.fromkeys(
        ("valid_sales", "orders_in_range", "orders_in_range_by_month", "orders_on_day", "orders_of_products", "category_orders", "category_orders_on_day"),
        LINES,
    ),
    "date_bounds": "min_date date, max_date date",
    "last_date": "last_date string",
    "customer_tenure": "user_id bigint, first_date date, last_date date, days int, months int, rest_days int,"
    " since_days int, since_months int, since_rest_days int",
    **dict.fromkeys(("update_where", "rewritten_filters"), "job_id string, filter_name string"),
    "predict_row_count": "row_count bigint",
    "topn_with_others": "orders int, product_id string, count double",
    "monthly_topn": "orders int, month string, product_id string, count double",
    "monthly_topn_named": "orders int, month string, product_name string, num bigint",
    **dict.fromkeys(("monthly_order_value", "monthly_order_value_with_nulls"), "month string, total_user_order_avg double"),
    **dict.fromkeys(("purchase_breadth", "purchase_breadth_unmerged"), "month string, category bigint, num bigint"),
    "product_monthly_growth": "month string, product_id string, product_name string, sales_num double, vspp double",
    **dict.fromkeys(("calendar_monthly_growth", "calendar_growth_of_category"), "month string, sales_num double, vspp double"),
    **dict.fromkeys(("daily_sales", "daily_sales_all", "daily_sales_by_month"), "pay_date date, sales_num double"),
    **dict.fromkeys(("active_rate_month", "active_rate_all"), RATE),
    "monthly_customers": "month string, customer_count bigint",
    **dict.fromkeys(
        ("total_customers", "targeted_repeat_buyers", "targeted_buyers_from_saved", "targeted_buyers", "repeat_buyers", "returning_customers", "customers_before"),
        "customer_count bigint",
    ),
    "basket_with_product": "order_id bigint, product_id string, quantity double, pay_amt decimal(18,2)",
    "co_purchase": "product_id string, product_name string, order_count bigint, quantity_count bigint, pay_amt_count double",
    "orders_with_pair": "order_id bigint, a_lines bigint, a_quantity double, a_pay_amt double,"
    " b_lines bigint, b_quantity double, b_pay_amt double, line_pairs bigint",
    "pair_lines": f"{LINES}, partner_lines bigint",
    **dict.fromkeys(("user_min_order_date", "min_date_of_predicted"), "user_id bigint, min_date date"),
    "sales_of_windows": "name string, lines bigint, money decimal(38,2), first_date date, last_date date",
    "users_trait_saved": "user_id bigint, order_avg double, activity int, frequency double",
    "users_trait": "user_id bigint, order_avg double, activity int, frequency double",
    "trait_percentile_curve": "order_avg_avg double, activity_avg double, frequency_avg double, ntile bigint, count bigint",
    "prediction_window": "name string, start_date date, finish_date date, min_pay_date date, max_pay_date date",
    "job_products": "name string, product_id string",
    **dict.fromkeys(("job_buyers", "audience_by_prediction", "audience_by_products", "known_buyers_from_saved"), "user_id bigint"),
    **dict.fromkeys(("lift_deciles", "lift_percentiles"), "grp bigint, p_obs_sum double"),
    "top_rank_p_obs": "p_obs_sum double",
    **{
        f"{prefix}{trait}_equal_{kind}": schema
        for trait, schema in BY_TRAIT.items() for prefix in ("", "job_") for kind in ("count", "width")
    },
}


def test_every_query_is_here():
    assert set(SCHEMAS) == set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(SCHEMAS))
def test_schema(spark, name):
    df = queries._registered()[name](spark, "/root/testdata/sf0.001")
    assert ", ".join(f"{column} {kind}" for column, kind in df.dtypes) == SCHEMAS[name]
