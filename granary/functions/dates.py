"""Date rules: tolerant parsing, inclusive month counts, month windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.missing import ColumnOrName, as_col


def parse_date(value: ColumnOrName, *formats: str) -> Column:
    """First format that fits; NULL if none does."""
    value = as_col(value)
    return F.coalesce(*[F.try_to_date(value, f) for f in formats])


def inclusive_months(first: ColumnOrName, last: ColumnOrName) -> Column:
    """Months from first to last, both counted."""
    return (F.months_between(as_col(last), as_col(first)) + 1).cast("int")


def in_months_after(day: ColumnOrName, start: ColumnOrName, months: int) -> Column:
    """Whether a day lies in [start, start + months); NULL without a start."""
    day, start = as_col(day), as_col(start)
    return (day >= start) & (day < F.add_months(start, months))
