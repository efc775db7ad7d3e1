"""Column helpers: dates, sums, ratios, labels and JSON lists."""

from tillscope.functions.dates import age_parts, month_of, month_start, month_text, whole_days
from tillscope.functions.values import (
    ascending,
    comparable,
    double_sum,
    json_items,
    range_label,
    ratio,
)

__all__ = [
    "age_parts",
    "ascending",
    "comparable",
    "double_sum",
    "json_items",
    "month_of",
    "month_start",
    "month_text",
    "range_label",
    "ratio",
    "whole_days",
]
