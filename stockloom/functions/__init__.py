from .columns import (
    blank_to_null,
    contains_text,
    days_until,
    instant,
    is_overdue,
    js_trim,
    margin_pct,
    money,
    normalize_sku,
    number_lead,
    number_of,
    number_prefix,
    whole_lead,
    whole_of,
    whole_prefix,
)

__all__ = [
    "blank_to_null", "contains_text", "days_until", "instant", "is_overdue", "js_trim", "margin_pct", "money",
    "normalize_sku", "number_lead", "number_of", "number_prefix", "whole_lead", "whole_of", "whole_prefix",
]
