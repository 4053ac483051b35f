"""Quality checks. Each returns a table; none prints or stops by itself."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.missing import sum_r
from granary.operators.aggregate import count_by_group
from granary.operators.joins import anti_join, join_checked, left_join_na
from granary.sources.literals import literal_table


def violations(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which the predicate is false or unknown."""
    return df.where(~F.coalesce(predicate, F.lit(False)))


def control_total(raw: DataFrame, raw_sum: Column, done: DataFrame, done_sum: Column) -> DataFrame:
    """A sum before and after processing, and their difference."""
    after = done.agg(done_sum.alias("v")).scalar()
    return raw.agg(raw_sum.alias("total_raw")).select(
        "total_raw",
        after.alias("total_processed"),
        (F.col("total_raw") - after).alias("difference"),
    )


def expected_rows(df: DataFrame, dimensions: Mapping[str, Column], *factors: int) -> DataFrame:
    """Actual rows against the product of the dimensions' sizes."""
    counted = df.agg(
        F.count(F.lit(1)).alias("n_actual"), *[e.alias(n) for n, e in dimensions.items()]
    )
    product = F.lit(1).cast("long")
    for name in dimensions:
        product = product * F.col(name)
    for factor in factors:
        product = product * factor
    return counted.withColumn("n_expected", product).withColumn(
        "is_complete", F.col("n_actual") == F.col("n_expected")
    )


def source_difference(
    model: DataFrame, actual: DataFrame, on: Sequence[str], value: str
) -> DataFrame:
    """Two sources side by side by a key unique in both, and actual minus model."""
    other = actual.withColumnRenamed(value, f"{value}_actual")
    both = join_checked(model.withColumnRenamed(value, f"{value}_model"), other, on)
    return both.where(F.col(f"{value}_actual").isNotNull()).withColumn(
        "difference", F.col(f"{value}_actual") - F.col(f"{value}_model")
    )


def rolled_difference(detail: DataFrame, by: str, summary: DataFrame) -> DataFrame:
    """Differences summed per group against the differences of the summary."""
    rolled = detail.groupBy(by).agg(sum_r("difference").alias("difference_detail"))
    other = summary.select(by, F.col("difference").alias("difference_summary"))
    return left_join_na(rolled, other, by).withColumn(
        "is_equal", F.col("difference_detail") == F.col("difference_summary")
    )


def uncovered(df: DataFrame, key: str, reference: DataFrame, *by: str, reference_key: str | None = None) -> DataFrame:
    """Rows whose key the reference lacks, counted by group."""
    missing = anti_join(df, reference, {key: reference_key or key})
    return count_by_group(missing, *(by or [key]))


def remove_ids(df: DataFrame, column: str, ids: Sequence) -> DataFrame:
    """Drop rows with a listed id; rows without an id stay."""
    kind = df.schema[column].dataType.simpleString()
    listed = literal_table(df.sparkSession, [(i,) for i in ids], [(column, kind)])
    return df.join(F.broadcast(listed), on=column, how="left_anti")
