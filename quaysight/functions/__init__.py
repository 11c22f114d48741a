"""Column expressions: dialect semantics and the report clock."""

from quaysight.functions.clock import (
    MASK_DAY_MONTH,
    MASK_DAY_MONTH_TIME,
    MASK_DAY_MONTH_YEAR_TIME,
    MASK_TIME,
    after_day_offset,
    as_of_col,
    between_midnights,
    business_day_window,
    day,
    iso_weekday,
    minutes_of_day_since,
    minutes_since,
    to_char,
)
from quaysight.functions.semantics import (
    empty_as_null,
    flag,
    int_div,
    lpad_number,
    ora_concat,
    ora_substr,
    proper_name,
    round_share,
    share_string,
    to_decimal,
    to_integer,
    trunc_ratio_pct,
    zero_if_null_decimal,
)

__all__ = [
    "MASK_DAY_MONTH", "MASK_DAY_MONTH_TIME", "MASK_DAY_MONTH_YEAR_TIME", "MASK_TIME",
    "after_day_offset", "as_of_col", "between_midnights", "business_day_window", "day",
    "iso_weekday", "minutes_of_day_since", "minutes_since", "to_char",
    "empty_as_null", "flag", "int_div", "lpad_number", "ora_concat", "ora_substr",
    "proper_name", "round_share", "share_string", "to_decimal", "to_integer",
    "trunc_ratio_pct", "zero_if_null_decimal",
]
