"""Counts, summaries and grouped rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.missing import ColumnOrName, as_col, n_distinct_r, sum_r
from granary.operators.joins import left_join_na
from granary.operators.quantiles import group_quantiles
from granary.operators.windows import ordering, share_within


def count_by_group(df: DataFrame, *by: str, order_by: str = "n") -> DataFrame:
    """Rows per group and share of all rows, largest first, then by group."""
    counts = share_within(df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), "n")
    return counts.orderBy(*ordering([f"-{order_by}", *[c for c in by if c != order_by]]))


def count_rows(df: DataFrame, *by: str, name: str = "n", sort: bool = False) -> DataFrame:
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    return counts.orderBy(*ordering([f"-{name}", *by])) if sort else counts


def distinct_if(condition: Column, value: ColumnOrName, na_rm: bool = True) -> Column:
    """Distinct values over the rows meeting a condition.

    The scripts count the NULL that stands for the other rows as one more value;
    ``na_rm=False`` gives that number.
    """
    return n_distinct_r(F.when(condition, as_col(value)), na_rm=na_rm)


def sum_if(flag: Column, value: ColumnOrName) -> Column:
    """Sum of value x flag, missing if the value or the flag is missing anywhere."""
    value = as_col(value)
    product = F.when(flag, value).when(~flag & value.isNotNull(), F.lit(0).cast("double"))
    return sum_r(product)


def listed(value: str, sep: str, order: Sequence[str]) -> Column:
    """Texts of a group joined in order; missing ones skipped, none gives ''."""
    by = ", ".join(
        f"`{c[1:]}` DESC NULLS LAST" if c.startswith("-") else f"`{c}` ASC NULLS LAST" for c in order
    )
    quoted = sep.replace("\\", "\\\\").replace("'", "\\'")
    joined = F.expr(f"listagg(`{value}`, '{quoted}') WITHIN GROUP (ORDER BY {by})")
    return F.coalesce(joined, F.lit(""))


def consolidate(
    df: DataFrame, keys: Sequence[str], rules: Mapping[str, str], order: Sequence[str]
) -> DataFrame:
    """One row per key, each other column merged by its own rule.

    Rules: ``max``, ``min``, ``any``, ``sum`` (empty is 0), or ``list:<separator>``.
    """
    plain = {
        "max": F.max,
        "min": F.min,
        "any": F.bool_or,
        "sum": lambda c: sum_r(c, na_rm=True),
    }
    lists = {c: rule[5:] for c, rule in rules.items() if rule.startswith("list:")}
    merged = [plain[rule](c).alias(c) for c, rule in rules.items() if c not in lists]
    if not lists:
        return df.groupBy(*keys).agg(*merged)
    # the rows of a group are sorted once for all its lists; NULL texts sort last
    place = [e for i, c in enumerate(order) for e in (F.col(c).isNull().alias(f"n{i}"), F.col(c).alias(f"o{i}"))]
    row = F.struct(*place, *[F.col(c).alias(f"v_{c}") for c in lists])
    grouped = df.groupBy(*keys).agg(*merged, F.sort_array(F.collect_list(row)).alias("_rows"))
    joined = {c: F.array_join(F.col("_rows")[f"v_{c}"], sep) for c, sep in lists.items()}
    return grouped.withColumns(joined).select(*keys, *rules)


def null_counts(df: DataFrame, columns: Sequence[str], name: str = "{col}") -> DataFrame:
    """Missing values per column, in one pass."""
    return df.agg(
        *[F.count(F.when(F.col(c).isNull(), 1)).alias(name.format(col=c)) for c in columns]
    )


def numeric_summary(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Minimum, quartiles, mean, maximum and missing count of one column."""
    plain = df.groupBy(*by).agg(
        F.min(column).alias("min"),
        F.avg(column).alias("mean"),
        F.max(column).alias("max"),
        F.count(F.when(F.col(column).isNull(), 1)).alias("n_missing"),
    )
    quartiles = group_quantiles(df, by, {"q1": (column, 0.25), "median": (column, 0.5), "q3": (column, 0.75)})
    if by:
        return left_join_na(plain, quartiles, list(by))
    return left_join_na(plain.withColumn("_one", F.lit(1)), quartiles.withColumn("_one", F.lit(1)), "_one").drop("_one")


def add_totals_row(df: DataFrame, label_column: str, label: str = "Total") -> DataFrame:
    """Append a row with the sums of the summary's own numbers."""
    numeric = [f.name for f in df.schema if f.dataType.typeName() in _NUMBERS]
    totals = df.agg(*[F.sum(c).alias(c) for c in numeric]).withColumn(label_column, F.lit(label))
    return df.unionByName(totals, allowMissingColumns=True)


_NUMBERS = {"byte", "short", "integer", "long", "float", "double", "decimal"}


def histogram(df: DataFrame, column: str, width: float) -> DataFrame:
    """Counts in bins centred on multiples of the width, closed on the right."""
    value = F.col(column).cast("double")
    finite = df.where(~F.isnan(value) & (F.abs(value) < float("inf")))
    centre = (F.ceil(value / width - 0.5) * width).alias("bin")
    return finite.groupBy(centre).agg(F.count(F.lit(1)).alias("n"))


def stacked_counts(df: DataFrame, x: str, fill: str) -> DataFrame:
    """Counts by category and fill, with the share inside the category."""
    return share_within(df.groupBy(x, fill).agg(F.count(F.lit(1)).alias("n")), "n", x)
