"""The operators: plain functions from DataFrames to DataFrames."""

from tillscope.operators.baskets import basket_lines, co_purchase, orders_with_pair, pair_lines
from tillscope.operators.campaigns import (
    audience_by_prediction,
    audience_by_products,
    buyers_of_listed,
    campaign_customers,
    job_buyers,
    job_products,
    predicted_buyers,
    prediction_window,
)
from tillscope.operators.grouping import (
    equal_count_groups,
    equal_width_groups,
    trait_percentile_curve,
)
from tillscope.operators.lift import (
    count_buyers,
    customers_before,
    lift_by_buyers,
    lift_by_score,
    returning_customers,
    top_rank_sum,
)
from tillscope.operators.ntile import add_ntile, add_position
from tillscope.operators.sales import (
    between_dates,
    category_orders,
    customer_tenure,
    date_bounds,
    last_date,
    orders_in_range,
    orders_in_windows,
    orders_of_listed,
    orders_of_products,
    orders_on_day,
    products_in_category,
    row_count,
    valid_sales,
    with_age,
    with_month,
)
from tillscope.operators.topn import monthly_top_named, monthly_top_products, top_products
from tillscope.operators.traits import (
    register_users_trait,
    save_users_trait,
    traits_of_totals,
    user_min_order_date,
    user_totals,
    user_traits,
)
from tillscope.operators.trends import (
    calendar_growth,
    daily_sales,
    monthly_active_rate,
    monthly_customers,
    monthly_order_value,
    product_growth,
    purchase_breadth,
    total_customers,
)

__all__ = [
    "add_ntile",
    "add_position",
    "audience_by_prediction",
    "audience_by_products",
    "basket_lines",
    "between_dates",
    "buyers_of_listed",
    "calendar_growth",
    "campaign_customers",
    "category_orders",
    "co_purchase",
    "count_buyers",
    "customer_tenure",
    "customers_before",
    "daily_sales",
    "date_bounds",
    "equal_count_groups",
    "equal_width_groups",
    "job_buyers",
    "job_products",
    "last_date",
    "lift_by_buyers",
    "lift_by_score",
    "monthly_active_rate",
    "monthly_customers",
    "monthly_order_value",
    "monthly_top_named",
    "monthly_top_products",
    "orders_in_range",
    "orders_in_windows",
    "orders_of_listed",
    "orders_of_products",
    "orders_on_day",
    "orders_with_pair",
    "pair_lines",
    "predicted_buyers",
    "prediction_window",
    "product_growth",
    "products_in_category",
    "purchase_breadth",
    "register_users_trait",
    "returning_customers",
    "row_count",
    "save_users_trait",
    "top_products",
    "top_rank_sum",
    "total_customers",
    "trait_percentile_curve",
    "traits_of_totals",
    "user_min_order_date",
    "user_totals",
    "user_traits",
    "valid_sales",
    "with_age",
    "with_month",
]
