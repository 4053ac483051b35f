"""Reproducible samples: rows are ordered by a hash of their id and a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators.joins import left_join_na, semi_join
from granary.operators.windows import first_k_by_column, share_within


def draw_order(id: str, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.col(id).cast("string"), F.lit(str(seed))))


def strata_sizes(df: DataFrame, stratum: str, n: int) -> DataFrame:
    """Per stratum: rows, share, and rows to draw, rounded up."""
    counts = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
    shares = share_within(counts, "n")
    return shares.withColumn("n_sample", F.ceil(F.col("pct") * n).cast("long"))


def stratified_sample(df: DataFrame, stratum: str, id: str, n: int, seed: int) -> DataFrame:
    """About n rows, each stratum by its share; the total may exceed n a little."""
    sized = left_join_na(
        df, strata_sizes(df, stratum, n).withColumnRenamed("n", "n_stratum"), stratum
    )
    drawn = sized.withColumn("_draw", draw_order(id, seed))
    return first_k_by_column(drawn, [stratum], ["_draw", id], "n_sample", at_most=n).drop("_draw")


def sample_balance(sample: DataFrame, sizes: DataFrame, stratum: str) -> DataFrame:
    """Share of each stratum in the sample against the population."""
    counts = sample.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
    drawn = share_within(counts, "n", name="pct_sample").drop("n")
    population = sizes.select(stratum, F.col("pct").alias("pct_population"))
    return left_join_na(drawn, population, stratum).withColumn(
        "pct_diff", F.col("pct_sample") - F.col("pct_population")
    )


def random_rows(df: DataFrame, id: str, n: int, seed: int) -> DataFrame:
    return df.orderBy(draw_order(id, seed), id).limit(n)


def rows_of_sample(df: DataFrame, sample: DataFrame, id: str, condition: Column) -> DataFrame:
    return semi_join(df.where(condition), sample, id)
