"""Session settings and the shared folders used to cut lineage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings only, so they can be applied to a session made elsewhere.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # hot join keys: split them even when that costs one more exchange
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Where that is unset it is the warehouse, which all executors share as well.
    """
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/granary/{name}-{uuid.uuid4().hex}"


@contextmanager
def finished_shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries run inside go when each query ends, not when the driver next collects its garbage.

    For steps whose results are written or returned; a frame run twice would make its shuffles again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def setting(spark: SparkSession, key: str, value: object) -> Iterator[None]:
    """A setting for the queries run inside; None leaves it."""
    before = spark.conf.get(key, None)
    if value is not None:
        spark.conf.set(key, str(value))
    try:
        yield
    finally:
        if value is not None:
            spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def remove_table(spark: SparkSession, path: str) -> None:
    """Take a scratch table that nothing reads any more from the shared folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cut_lineage(df: DataFrame, path: str | None = None) -> DataFrame:
    """The same rows read back from a table written to the shared folder.

    Survives lost executors, fixes what depends on partitions, and is made in one
    pass; later reads take only the columns they need.
    """
    path = path or scratch_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
