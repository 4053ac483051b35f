"""Choosing, renaming and deriving columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.missing import ColumnOrName, as_col, is_in
from granary.functions.text import replace_first
from granary.sources.literals import literal_table


def cols(
    df: DataFrame,
    *,
    starts_with: str | Sequence[str] = (),
    ends_with: str | Sequence[str] = (),
    contains: str | Sequence[str] = (),
    matches: str | Sequence[str] = (),
    any_of: Sequence[str] = (),
    all_of: Sequence[str] = (),
    span: tuple[str, str] | None = None,
    everything: bool = False,
    but_not: Sequence[str] = (),
    ignore_case: bool = True,
) -> list[str]:
    """Column names meeting any of the given tests, in the order of the tests.

    ``any_of`` takes the listed names that exist, ``all_of`` requires them all,
    ``span`` is a range of neighbours, ``but_not`` takes names away.
    """
    names = df.columns
    fold = str.lower if ignore_case else str

    def listed(value):
        return [value] if isinstance(value, str) else list(value)

    def picked(tests, hit):
        for t in listed(tests):
            found.extend(c for c in names if hit(fold(c), fold(t)))

    found: list[str] = []
    picked(starts_with, str.startswith)
    picked(ends_with, str.endswith)
    picked(contains, str.__contains__)
    for pattern in listed(matches):
        found.extend(c for c in names if re.search(pattern, c, re.I if ignore_case else 0))
    found.extend(c for c in any_of if c in names)
    absent = [c for c in all_of if c not in names]
    if absent:
        raise KeyError(f"columns not found: {absent}")
    found.extend(all_of)
    if span:
        first, last = names.index(span[0]), names.index(span[1])
        found.extend(names[first : last + 1])
    if everything:
        found.extend(names)
    dropped = set(but_not)
    return [c for c in dict.fromkeys(found) if c not in dropped]


def both(first: Iterable[str], second: Iterable[str]) -> list[str]:
    second = set(second)
    return [c for c in first if c in second]


def across(
    names: Iterable[str], fn: Callable[[Column], Column], name: str = "{col}"
) -> dict[str, Column]:
    """The same expression over many columns, for ``withColumns`` or ``aggs``."""
    return {name.format(col=c): fn(F.col(c)) for c in names}


def aggs(exprs: Mapping[str, Column]) -> list[Column]:
    return [e.alias(n) for n, e in exprs.items()]


def select_as(df: DataFrame, **names: ColumnOrName) -> DataFrame:
    """Select and rename in one step: ``new=old`` in the order given."""
    return df.select(*[as_col(old).alias(new) for new, old in names.items()])


def rename_with(df: DataFrame, names: Iterable[str], fn: Callable[[str], str]) -> DataFrame:
    return df.withColumnsRenamed({c: fn(c) for c in names})


def clean_name(name: str) -> str:
    """Snake case of one column name; words split at case changes and symbols."""
    text = name.replace("'", "").replace('"', "").replace("%", "_percent_").replace("#", "_number_")
    text = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", text)
    text = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", text)
    text = re.sub(r"[^0-9A-Za-z]+", "_", text).strip("_").lower()
    return f"x{text}" if not text or text[0].isdigit() else text


def clean_names(df: DataFrame) -> DataFrame:
    """All names in snake case; repeats get _2, _3 and so on."""
    seen: dict[str, int] = {}
    result = []
    for name in map(clean_name, df.columns):
        seen[name] = seen.get(name, 0) + 1
        result.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return df.toDF(*result)


def recode(df: DataFrame, column: str, mapping: Mapping) -> DataFrame:
    """Swap listed values for new ones; others stay.

    The mapping is a literal in the caller's code, so its size is fixed and it
    can be broadcast whatever the data's size.
    """
    kind = df.schema[column].dataType.simpleString()
    new = literal_table(df.sparkSession, mapping.items(), [("_old", kind), ("_new", kind)])
    joined = df.join(F.broadcast(new), df[column] == new["_old"], "left")
    swapped = joined.withColumn(column, F.coalesce("_new", column))
    return swapped.select(*df.columns)


def band(
    value: ColumnOrName,
    cuts: Sequence[tuple[str, float, str]],
    default: str | None = None,
    missing_codes: Iterable = (),
) -> Column:
    """Label a number by the first cut it meets.

    ``cuts`` are (comparison, bound, label) with comparison one of ``> >= < <=``.
    ``missing_codes`` are numbers standing for "not reported"; they get the default.
    """
    value = as_col(value)
    codes = list(missing_codes)
    if codes:
        value = F.when(~is_in(value, codes), value)
    test = {">": value.__gt__, ">=": value.__ge__, "<": value.__lt__, "<=": value.__le__}
    label = F
    for comparison, bound, name in cuts:
        label = label.when(test[comparison](bound), F.lit(name))
    return label if default is None else label.otherwise(F.lit(default))


def code_band(
    value: ColumnOrName, ranges: Sequence[tuple[int, int, str]], default: str | None = None
) -> Column:
    """Label a code by the first inclusive range holding it."""
    value = as_col(value)
    label = F
    for low, high, name in ranges:
        label = label.when(value.between(low, high), F.lit(name))
    return label if default is None else label.otherwise(F.lit(default))


def score_label(score: ColumnOrName, none: str, one: str, more: str) -> Column:
    score = as_col(score)
    return F.when(score == 0, F.lit(none)).when(score == 1, F.lit(one)).otherwise(F.lit(more))


def level_rank(value: ColumnOrName, levels: Sequence[str]) -> Column:
    """Position of an ordered category among its levels (from 1), else NULL."""
    place = F.array_position(F.array(*[F.lit(x) for x in levels]), as_col(value))
    return F.nullif(place, F.lit(0)).cast("int")


def impute(value: ColumnOrName, condition: Column, other: ColumnOrName) -> Column:
    """Fill a missing value from a sibling column where the condition holds."""
    value = as_col(value)
    return F.when(condition & value.isNull(), as_col(other)).otherwise(value)


def fiscal_year_of(approved: ColumnOrName, nth: ColumnOrName) -> Column:
    """Fiscal year of the n-th year of an award; the award year is the first."""
    return as_col(approved) + as_col(nth) - 1


def split_suffix_type(
    df: DataFrame,
    column: str,
    rules: Sequence[tuple[str, str]],
    type_name: str,
    only: Column,
    otherwise: str,
    fixed_type: Mapping[str, str] | None = None,
    fixed_name: Sequence[tuple[Column, str]] = (),
) -> DataFrame:
    """Split a place name into a bare name and the type told by its suffix.

    ``rules`` are (text, type) in order; the first one found gives the type, and
    every one is taken off once. Rows not meeting ``only`` keep their name and
    get ``otherwise``. ``fixed_name`` and ``fixed_type`` are listed exceptions.
    """
    name = F.col(column)
    kind = F.when(~only, F.lit(otherwise))
    for value, label in (fixed_type or {}).items():
        kind = kind.when(name == value, F.lit(label))
    bare = name
    for text, label in rules:
        kind = kind.when(name.contains(text), F.lit(label))
        bare = replace_first(bare, re.escape(text), "")
    named = F
    for condition, new in fixed_name:
        named = named.when(condition, F.lit(new))
    named = named.when(only, bare).otherwise(name)
    return df.withColumns({type_name: kind, column: named})
