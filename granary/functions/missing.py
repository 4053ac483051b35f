"""Missing values: membership, conditionals, pasting and summaries.

Spark's own functions differ from the scripts' in places that change numbers
without an error; each helper here names one such rule.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def as_col(value: ColumnOrName) -> Column:
    return F.col(value) if isinstance(value, str) else value


def is_in(value: ColumnOrName, members: Iterable) -> Column:
    """Membership that is never NULL; NULL is a member only if listed."""
    value = as_col(value)
    listed = list(members)
    present = [m for m in listed if m is not None]
    found = F.coalesce(value.isin(present), F.lit(False))
    return found | value.isNull() if None in listed else found


def not_in(value: ColumnOrName, members: Iterable) -> Column:
    """Negated membership; rows with a NULL value are kept."""
    return ~is_in(value, members)


def if_else(condition: Column, yes, no) -> Column:
    """Two-way choice; an unknown condition gives NULL, not the second value."""
    return F.when(condition, yes).when(~condition, no)


def known(value: ColumnOrName) -> Column:
    """NaN as NULL, so that comparing it is unknown (Spark ranks NaN highest)."""
    value = as_col(value)
    return F.when(~F.isnan(value), value)


def nullify(value: ColumnOrName, tokens: Iterable) -> Column:
    """NULL for any of a set of missing-value spellings."""
    value = as_col(value)
    return F.when(not_in(value, tokens), value)


def first_known(*values: ColumnOrName) -> Column:
    return F.coalesce(*[as_col(v) for v in values])


def coalesce_in(value: ColumnOrName, members: Iterable, other: ColumnOrName) -> Column:
    """Take ``other`` where ``value`` is a listed member."""
    return F.when(is_in(value, members), as_col(other)).otherwise(as_col(value))


def paste(*values: ColumnOrName, sep: str = " ", na: str | None = "NA") -> Column:
    """Join texts; NULL becomes ``na``, or makes the whole result NULL if None."""
    parts = [as_col(v).cast("string") for v in values]
    if na is not None:
        parts = [F.coalesce(p, F.lit(na)) for p in parts]
    joined = list(chain.from_iterable((F.lit(sep), p) for p in parts))[1:]
    return F.concat(*joined)


def yes_no(value: ColumnOrName, yes="Yes", no="No", missing: bool | None = None) -> Column:
    """Yes/No text to a tri-state boolean; any other text is NULL."""
    value = as_col(value)
    answer = F.when(value == no, F.lit(False)).when(value == yes, F.lit(True))
    return answer if missing is None else answer.when(value.isNull(), F.lit(missing))


def yes_no_text(value: ColumnOrName, yes="Yes", no="No") -> Column:
    return if_else(as_col(value), F.lit(yes), F.lit(no))


def lookup(value: ColumnOrName, mapping: Mapping) -> Column:
    """Value of a short literal map, NULL if absent."""
    pairs = [F.lit(x) for x in chain.from_iterable(mapping.items())]
    return F.create_map(*pairs)[as_col(value)]


def pmin(*values: ColumnOrName) -> Column:
    """Smallest of several columns, NULL if any is NULL."""
    return _all_known(F.least, values)


def pmax(*values: ColumnOrName) -> Column:
    return _all_known(F.greatest, values)


def _all_known(pick, values) -> Column:
    values = [as_col(v) for v in values]
    complete = F.lit(True)
    for v in values:
        complete = complete & v.isNotNull()
    return F.when(complete, pick(*values))


def sum_r(value: ColumnOrName, na_rm: bool = False) -> Column:
    """Sum that is NULL if any value is; with ``na_rm`` an empty sum is 0."""
    value = as_col(value)
    total = F.coalesce(F.sum(value), F.lit(0))
    return total if na_rm else F.when(F.count(value) == F.count(F.lit(1)), total)


def mean_r(value: ColumnOrName, na_rm: bool = False) -> Column:
    """Mean that is NULL if any value is. Booleans: cast to int for a share."""
    value = as_col(value)
    mean = F.avg(value)
    return mean if na_rm else F.when(F.count(value) == F.count(F.lit(1)), mean)


def n_distinct_r(value: ColumnOrName, na_rm: bool = False) -> Column:
    """Distinct count in which NULL counts as one more value."""
    value = as_col(value)
    n = F.count_distinct(value)
    if na_rm:
        return n
    has_null = F.max(F.when(value.isNull(), 1).otherwise(0))
    return n + F.coalesce(has_null, F.lit(0))
