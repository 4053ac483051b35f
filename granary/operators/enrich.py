"""Filling in missing attributes from an ordered list of lookup tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators.joins import left_join_na


def pending_keys(df: DataFrame, key: str, missing: Column) -> DataFrame:
    """Distinct keys still lacking a value, to be looked up once each."""
    return df.where(missing).select(key).distinct()


def one_per_key(table: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """One answer per key: the smallest tuple whose first value is known."""
    answered = table.where(F.col(values[0]).isNotNull())
    best = answered.groupBy(key).agg(F.min(F.struct(*values)).alias("_best"))
    return best.select(key, *[F.col(f"_best.{v}").alias(v) for v in values])


def cascade_lookup(
    df: DataFrame,
    key: str,
    values: Sequence[str],
    sources: Sequence[tuple[str, DataFrame]],
    source_name: str = "source",
) -> DataFrame:
    """Look keys up in each source in turn; the first answer wins.

    A source answers a key if the first of ``values`` is known there. The name
    of the answering source is recorded, NULL when none does.
    """
    result, found = df, []
    for i, (_, table) in enumerate(sources):
        answers = one_per_key(table, key, values)
        renamed = answers.withColumnsRenamed({v: f"_{i}_{v}" for v in values})
        result = left_join_na(result, renamed, key)
        found.append(F.col(f"_{i}_{values[0]}").isNotNull())
    # all values are taken from the same source
    picked = {}
    for v in values:
        choice = F
        for i, hit in enumerate(found):
            choice = choice.when(hit, F.col(f"_{i}_{v}"))
        picked[v] = choice
    tag = F
    for (name, _), hit in zip(sources, found):
        tag = tag.when(hit, F.lit(name))
    return result.select(*df.columns, *[c.alias(v) for v, c in picked.items()], tag.alias(source_name))


def repair_unmatched(df: DataFrame, key: str, value: str, fallback: DataFrame, attributes: DataFrame) -> DataFrame:
    """Fill a missing value from a second source, then attach what hangs on it.

    Every row stays, also one that no source can help; ``fanout_check`` shows that their number is unchanged.
    """
    answers = one_per_key(fallback, key, [value]).withColumnRenamed(value, "_answer")
    filled = left_join_na(df, answers, key).withColumn(value, F.coalesce(value, "_answer")).drop("_answer")
    return left_join_na(filled, attributes, value)
