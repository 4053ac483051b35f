"""Unions, distinct rows, differences and duplicate finders."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators.joins import anti_join
from granary.sources.literals import literal_table


def union_by_name(*dfs: DataFrame) -> DataFrame:
    """Stack tables by column name; a column a table lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def align(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns, order and types of another table; absent ones are NULL."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in like.schema
        ]
    )


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each key, all columns kept. ``order`` columns hold no NULL.

    A minimum with its row is merged map-side, so a frequent key costs one row
    per task.
    """
    row = F.struct(*[F.col(c) for c in df.columns])
    first = df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(
        F.min_by(row, F.struct(*[F.col(c) for c in order])).alias("_row")
    )
    return first.select("_row.*")


def value_difference(left: DataFrame, left_col: str, right: DataFrame, right_col: str) -> DataFrame:
    """Distinct values of one column that another column lacks."""
    return anti_join(left.select(left_col).distinct(), right, {left_col: right_col})


def union_literals(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    kind = df.schema[column].dataType.simpleString()
    extra = literal_table(df.sparkSession, [(v,) for v in values], [(column, kind)])
    return df.select(column).union(extra).distinct()


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Groups with more than one row, on named or all columns."""
    counts = df.groupBy(*(keys or df.columns)).agg(F.count(F.lit(1)).alias("_size"))
    return counts.where(F.col("_size") > 1).withColumnRenamed("_size", "n")
