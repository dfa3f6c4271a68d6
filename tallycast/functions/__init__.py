from tallycast.functions.calendar import (
    MONTHS,
    add_cyclic_month,
    cyclic_month,
    date_text,
    index_to_date,
    month_index,
    month_name,
    month_name_of,
    month_number,
    month_sequence,
    month_start,
    normalise_month,
    try_month_number,
)
from tallycast.functions.numeric import (
    clamp_zero,
    finite_or_zero,
    growth_factor,
    number_or_zero,
    parse_or_zero,
    round_half_even,
    years_since,
)

__all__ = [
    "MONTHS",
    "add_cyclic_month",
    "clamp_zero",
    "cyclic_month",
    "date_text",
    "finite_or_zero",
    "growth_factor",
    "index_to_date",
    "month_index",
    "month_name",
    "month_name_of",
    "month_number",
    "month_sequence",
    "month_start",
    "normalise_month",
    "number_or_zero",
    "parse_or_zero",
    "round_half_even",
    "try_month_number",
    "years_since",
]
