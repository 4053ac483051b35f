"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.session import tune


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of this package: whole texts travel to Python, so batches have few rows."""
    tune(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return spark


def words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes: just what ``bytes.split`` cuts at."""
    return text.split() if text else []


def utf8(name: str) -> Column:
    """A text column as bytes; nothing is decoded on the way to Python."""
    return F.col(name).cast("string").cast("binary")


def crc_mod(name: str, n: int) -> Column:
    """crc32 of the id as text, modulo n (NULL for a NULL id)."""
    return F.crc32(F.col(name).cast("string").cast("binary")) % n


def map_batches(df: DataFrame, schema: str, make: Callable[[], Callable[[dict], dict]]) -> DataFrame:
    """``make()`` runs once per task; its result turns a batch of columns (lists by name) into columns.

    Columns it returns may be lists, numpy or Arrow arrays; a result of None gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    fields = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            if batch.num_rows:
                out = fn(dict(zip(batch.schema.names, batch.columns)))
                if out is not None:
                    yield pa.record_batch(
                        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type, from_pandas=False) for c, f in zip((out[f.name] for f in fields), fields)],
                        schema=fields,
                    )

    return df.mapInArrow(run, schema)


def bounded_sample(rows: DataFrame, group: str, key: str, size: int, seed: int, groups: int = 1000) -> DataFrame:
    """At most ``size`` rows of each of the ``groups`` largest groups: those with the smallest hash of their key.

    The counts of the groups give a bound on the hash, a little above what is needed, so only the few rows below
    it meet for ranking, however large a group is.
    """
    counts = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), group).limit(groups)
    marked = rows.withColumn("_mark", F.xxhash64(F.col(key), F.lit(seed))).join(F.broadcast(counts), group)
    near = marked.where(F.pmod("_mark", F.lit(1 << 40)) < (size + 8 * size**0.5 + 8) / F.col("_n") * float(1 << 40))
    order = Window.partitionBy(group).orderBy(F.pmod("_mark", F.lit(1 << 40)), key)
    return near.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= size).drop("_n", "_mark", "_at")


class WordCodes(dict):
    """64-bit code of a word, hashed once while it stays in this table of bounded size."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code

    def of(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def window_codes(codes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Code of each run of ``size`` word codes, by start."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF), np.uint64)
    factor = np.uint64(0x9FB21C651E98DF25)
    for j in range(size):
        out = (out + codes[j : j + n]) * factor
        out ^= out >> np.uint64(29)
    return mix(out)
