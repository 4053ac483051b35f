"""Writing CSV with the scripts' spellings, and named Parquet tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv_r(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV in which a missing value is NA and booleans are TRUE and FALSE."""
    spelled = {
        f.name: F.upper(F.col(f.name).cast("string"))
        for f in df.schema
        if f.dataType.typeName() == "boolean"
    }
    df.withColumns(spelled).write.mode(mode).option("header", True).option("nullValue", "NA").option(
        "emptyValue", ""
    ).csv(path)


def read_csv_r(spark: SparkSession, path: str, schema) -> DataFrame:
    reader = spark.read.schema(schema).option("header", True).option("nullValue", "NA")
    return reader.csv(path)


def save_tables(tables: Mapping[str, DataFrame], folder: str, mode: str = "overwrite") -> None:
    """One Parquet table per name: the hand-over between stages."""
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{folder}/{name}")


def load_tables(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}


def write_split(df: DataFrame, path: str, *keys: str, mode: str = "overwrite") -> None:
    """One folder per key value.

    Rows are rebalanced by key, so a frequent key is spread over several tasks.
    """
    df.hint("rebalance", *keys).write.mode(mode).partitionBy(*keys).parquet(path)
