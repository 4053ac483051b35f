"""Tables written in code."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def literal_table(spark: SparkSession, rows: Iterable[Sequence], schema: Sequence[tuple[str, str]]) -> DataFrame:
    """A small table made of literals by the JVM, with no Python workers.

    ``schema`` holds (name, type); the size is that of the caller's code.
    """
    structs = [
        F.struct(*[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(row, schema)]) for row in rows
    ]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*structs)))
