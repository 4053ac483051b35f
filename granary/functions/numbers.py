"""Number rules: division, rounding, conversion and row-wise sums."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.missing import ColumnOrName, as_col, pmax, pmin


def ratio(top: ColumnOrName, bottom: ColumnOrName) -> Column:
    """Floating division: x/0 is signed infinity and 0/0 is NaN."""
    top, bottom = as_col(top).cast("double"), as_col(bottom).cast("double")
    by_zero = (
        F.when(F.isnan(top) | (top == 0), F.lit(float("nan")))
        .when(top > 0, F.lit(float("inf")))
        .when(top < 0, F.lit(float("-inf")))
    )
    return F.when(bottom == 0, by_zero).otherwise(F.try_divide(top, bottom))


def half_even(value: ColumnOrName, digits: int = 0) -> Column:
    return F.bround(as_col(value), digits)


def to_number(value: ColumnOrName) -> Column:
    """Text to double; text that is no number is NULL."""
    return as_col(value).try_cast("double")


def zero_to_null(value: ColumnOrName) -> Column:
    return F.nullif(as_col(value), F.lit(0))


def clamp(value: ColumnOrName, low=None, high=None) -> Column:
    value = as_col(value)
    if low is not None:
        value = pmax(value, F.lit(low))
    if high is not None:
        value = pmin(value, F.lit(high))
    return value


def row_sum(columns: Iterable[str]) -> Column:
    """Sum across columns; NULL in one makes the row NULL."""
    return reduce(lambda a, b: a + b, [F.col(c) for c in columns])


def row_count_if(columns: Iterable[str], test: Callable[[Column], Column]) -> Column:
    """How many of the columns meet a test; an unknown result counts as no."""
    return reduce(lambda a, b: a + b, [F.when(test(F.col(c)), 1).otherwise(0) for c in columns])
