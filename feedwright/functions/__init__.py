"""Column expressions. All are built-in Spark functions, so they stay inside generated code."""

from .compare import agree, begins_with, coalesce_flag, fold, none_of, one_of
from .dates import in_period, is_weekday, local_time, month_text, period_bounds
from .money import cascade_first_nonzero, floor_money, not_negative, price_hierarchy, sale_mark
from .shipping import carrier_name, tracking_url
from .text import (
    code_map,
    decode_code,
    decode_list,
    decode_money,
    decode_offset_money,
    list_items,
    normalize_sku,
    strip_money,
)

__all__ = [
    "agree",
    "begins_with",
    "carrier_name",
    "cascade_first_nonzero",
    "coalesce_flag",
    "code_map",
    "decode_code",
    "decode_list",
    "decode_money",
    "decode_offset_money",
    "floor_money",
    "fold",
    "in_period",
    "is_weekday",
    "list_items",
    "local_time",
    "month_text",
    "none_of",
    "normalize_sku",
    "not_negative",
    "one_of",
    "period_bounds",
    "price_hierarchy",
    "sale_mark",
    "strip_money",
    "tracking_url",
]
