"""Ordered operators inside groups: numbering, filling, ranking, shares.

A window puts a whole group into one task. Here rows are dealt to slices of the order
(group, order) first, a window works on a group's rows of one slice, and what a group
hands on from slice to slice is joined back: a carry of a few rows a slice. The plan
is the same at any size. Slices begin at keys of the rows themselves, every
``PER_SLICE``-th of a sample by hash whose share is fixed, so their number follows the
number of rows, small tables are one slice, and a row's slice depends on its values
alone, whatever is computed again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.functions.missing import paste
from granary.operators.joins import left_join_na, semi_join

SLICE_ROWS = 1_000_000
PER_SLICE = 20  # sampled rows of a slice


def ordering(order: Sequence[str]) -> list[Column]:
    """Sort columns with missing values last; a leading ``-`` means descending."""
    return [
        F.desc_nulls_last(c[1:]) if c.startswith("-") else F.asc_nulls_last(c) for c in order
    ]


def _before(x: Column, y: Column, descending: bool) -> Column:
    less = x > y if descending else x < y
    return F.when(x.isNull() | y.isNull(), y.isNull() & x.isNotNull()).otherwise(less)


def _sliced(df: DataFrame, part: Sequence[str], order: Sequence[str], rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows with ``_slice``, and the groups (``part``) in which a slice begins."""
    keys, names = [*part, *order], [*part, *[c.lstrip("-") for c in order]]
    share = min(PER_SLICE / rows, 1.0)
    taken = F.pmod(F.xxhash64(*names), F.lit(1 << 40)) < int(share * (1 << 40))
    # one row in SLICE_ROWS / PER_SLICE: few enough to be put in order by one task
    place = F.row_number().over(W.orderBy(*ordering(keys)))
    starts = df.select(*names).where(taken).withColumn("_at", place).where(F.col("_at") % PER_SLICE == 0)
    listed = starts.agg(F.sort_array(F.collect_list(F.struct("_at", *names))).alias("_starts"))
    halves = F.transform(F.sequence(F.lit(30), F.lit(0), F.lit(-1)), lambda k: F.pow(F.lit(2.0), k).cast("int"))
    listed = listed.select("_starts", F.filter(halves, lambda p: p <= F.size("_starts")).alias("_halves"))

    def reached(start: Column) -> Column:
        out = F.lit(True)
        for c, name in reversed(list(zip(keys, names))):
            x, y = start[name], F.col(name)
            out = _before(x, y, c.startswith("-")) | (x.eqNullSafe(y) & out)
        return out

    def step(found: Column, half: Column) -> Column:
        return F.when(found + half <= F.size("_starts"), F.when(reached(F.get("_starts", found + half - 1)), found + half).otherwise(found)).otherwise(found)

    sliced = df.join(F.broadcast(listed)).withColumn("_slice", F.aggregate("_halves", F.lit(0), step))  # one row
    cut = starts.select(*part).distinct() if part else starts.select(F.lit(0).alias("_all")).distinct()
    return sliced.drop("_starts", "_halves"), cut


def _of_cut_groups(sliced: DataFrame, cut: DataFrame, part: Sequence[str]) -> DataFrame:
    """Rows of groups in which a slice begins; there are fewer of these groups than slices."""
    if not part:
        return sliced.join(F.broadcast(cut)).drop("_all")
    return semi_join(sliced, F.broadcast(cut), list(part))


def _earlier_slices(part: Sequence[str]):
    return W.partitionBy(*part).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)


def number_rows(df: DataFrame, part: Sequence[str], order: Sequence[str], name: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Sequence number from 1 in each group. The order must leave no ties."""
    sliced, cut = _sliced(df, part, order, slice_rows)
    inside = W.partitionBy(*part, "_slice").orderBy(*ordering(order))
    carry = (
        _of_cut_groups(sliced.select(*part, "_slice"), cut, part)
        .groupBy(*part, "_slice")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_carry", F.sum("_n").over(_earlier_slices(part)))
        .drop("_n")
    )
    numbered = left_join_na(sliced.withColumn(name, F.row_number().over(inside)), F.broadcast(carry), [*part, "_slice"])
    place = (F.col(name) + F.coalesce("_carry", F.lit(0))).cast("long")
    return numbered.withColumn(name, place).drop("_carry", "_slice")


def add_entity_id(
    df: DataFrame, key: str, order: Sequence[str], name: str = "entity_id", slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Id made of a key and the row's place among the rows of that key."""
    numbered = number_rows(df, [key], order, "_nth", slice_rows)
    return numbered.withColumn(name, paste(key, "_nth", sep="-")).drop("_nth")


def row_key(df: DataFrame, order: Sequence[str], name: str = "pk") -> DataFrame:
    """Running number over the whole table, as text."""
    numbered = number_rows(df, [], order, name)
    return numbered.withColumn(name, F.col(name).cast("string"))


def fill_down(
    df: DataFrame, part: Sequence[str], order: Sequence[str], columns: Sequence[str], slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Carry the last known value forward in each group."""
    sliced, cut = _sliced(df, part, order, slice_rows)
    inside = W.partitionBy(*part, "_slice").orderBy(*ordering(order))
    known = inside.rowsBetween(W.unboundedPreceding, 0)
    filled = sliced.withColumns({c: F.last(c, ignorenulls=True).over(known) for c in columns})
    # the last known value of a slice is what it hands on
    placed = _of_cut_groups(sliced, cut, part).withColumn("_place", F.row_number().over(inside))
    last = placed.groupBy(*part, "_slice").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_place"))).alias(f"_from_{c}") for c in columns])
    carry = last.select(*part, "_slice", *[F.last(f"_from_{c}", ignorenulls=True).over(_earlier_slices(part)).alias(f"_from_{c}") for c in columns])
    joined = left_join_na(filled, F.broadcast(carry), [*part, "_slice"])
    return joined.withColumns({c: F.coalesce(c, f"_from_{c}") for c in columns}).select(*df.columns)


def top_k(df: DataFrame, part: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """First k rows per group. Spark cuts to k rows per task before the exchange."""
    window = W.partitionBy(*part).orderBy(*ordering(order))
    return df.withColumn("_r", F.row_number().over(window)).where(F.col("_r") <= k).drop("_r")


def top_k_ties(df: DataFrame, part: Sequence[str], order: str, k: int) -> DataFrame:
    """First k rows per group by one column, keeping rows tied with the k-th.

    Works on the distinct values, whose k best per group decide the cut.
    """
    sized = df.groupBy(*part, order.lstrip("-")).agg(F.count(F.lit(1)).alias("_n"))
    best = top_k(sized, part, [order], k)
    ahead = W.partitionBy(*part).orderBy(*ordering([order])).rowsBetween(W.unboundedPreceding, -1)
    kept = (
        best.withColumn("_ahead", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
        .where(F.col("_ahead") < k)
        .select(*part, order.lstrip("-"))
    )
    return semi_join(df, kept, [*part, order.lstrip("-")])


def first_k_by_column(
    df: DataFrame, part: Sequence[str], order: Sequence[str], k: str, at_most: int
) -> DataFrame:
    """First k rows per group, k read from a column.

    ``at_most`` is what k cannot exceed: with it no task sends more rows of a group.
    A larger k is an error, never a shorter result.
    """
    k_checked = F.when(F.col(k) > at_most, F.raise_error(F.lit(f"{k} is above {at_most}"))).otherwise(F.col(k))
    df = df.withColumn(k, k_checked.cast(df.schema[k].dataType))
    window = W.partitionBy(*part).orderBy(*ordering(order))
    ranked = df.withColumn("_r", F.row_number().over(window)).where(F.col("_r") <= at_most)
    return ranked.where(F.col("_r") <= F.col(k)).drop("_r")


def share_within(df: DataFrame, n: str, *part: str, name: str = "pct") -> DataFrame:
    """Share of a row's count in its group's total, by sums joined back."""
    if not part:
        return df.withColumn(name, F.col(n) / df.agg(F.sum(n)).scalar())
    totals = df.groupBy(*part).agg(F.sum(n).alias("_total"))
    joined = left_join_na(df, totals, list(part))
    return joined.withColumn(name, F.col(n) / F.col("_total")).drop("_total")


def rank_by(
    df: DataFrame,
    ranked: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    part: Sequence[str] = (),
    name: str = "rank",
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Give rows the dense rank their key has in a summary table.

    The distinct values are numbered, so that ties share a rank.
    """
    by = [*part, *[c.lstrip("-") for c in order]]
    values = number_rows(ranked.select(*by).distinct(), part, order, name, slice_rows)
    ranks = left_join_na(ranked.select(*part, *key, *by[len(part) :]), values, by)
    return left_join_na(df, ranks.select(*part, *key, F.col(name).cast("int").alias(name)), [*part, *key])
