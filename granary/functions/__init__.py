"""Column functions with the missing-value rules of the analysis scripts."""

from granary.functions.dates import (
    in_months_after,
    inclusive_months,
    parse_date,
)
from granary.functions.missing import (
    coalesce_in,
    first_known,
    if_else,
    is_in,
    known,
    lookup,
    mean_r,
    n_distinct_r,
    not_in,
    nullify,
    paste,
    pmax,
    pmin,
    sum_r,
    yes_no,
    yes_no_text,
)
from granary.functions.numbers import (
    clamp,
    half_even,
    ratio,
    row_count_if,
    row_sum,
    to_number,
    zero_to_null,
)
from granary.functions.text import (
    detect,
    extract,
    replace_all,
    replace_first,
    right,
    title,
    words,
)

__all__ = [name for name in dir() if not name.startswith("_")]
