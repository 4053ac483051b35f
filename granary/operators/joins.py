"""Joins with the scripts' key rules.

Sides are never forced to broadcast here: Spark does it from the measured size
of a side (file statistics, or shuffle statistics at run time) and splits hot
partitions of the other joins at run time.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _key_pairs(on) -> list[tuple[str, str]]:
    if isinstance(on, str):
        return [(on, on)]
    return list(on.items()) if isinstance(on, Mapping) else [(c, c) for c in on]


def _condition(pairs, left: str = "l", right: str = "r") -> Column:
    """Keys match when equal or both missing."""
    tests = [F.col(f"{left}.`{a}`").eqNullSafe(F.col(f"{right}.`{b}`")) for a, b in pairs]
    return reduce(lambda x, y: x & y, tests)


def left_join_na(
    left: DataFrame, right: DataFrame, on: str | Sequence[str] | Mapping[str, str]
) -> DataFrame:
    """Left join in which a missing key matches a missing key.

    ``on`` is a name, names, or a map from left to right names; the right keys
    are dropped. Other names on both sides must differ (see ``join_coalesce``).
    """
    pairs = _key_pairs(on)
    keys = {b for _, b in pairs}
    extra = [c for c in right.columns if c not in keys]
    clash = [c for c in extra if c in left.columns]
    if clash:
        raise ValueError(f"columns on both sides: {clash}")
    joined = left.alias("l").join(right.alias("r"), _condition(pairs), "left")
    return joined.select("l.*", *[F.col(f"r.`{c}`") for c in extra])


def natural_left_join(left: DataFrame, right: DataFrame) -> DataFrame:
    return left_join_na(left, right, [c for c in left.columns if c in right.columns])


def join_coalesce(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str] | Mapping[str, str],
    columns: Sequence[str],
    priority: str = "left",
) -> DataFrame:
    """Left join where the named clashing columns take the first known side."""
    pairs = _key_pairs(on)
    keys = {b for _, b in pairs}
    joined = left.alias("l").join(right.alias("r"), _condition(pairs), "left")
    order = ("l", "r") if priority == "left" else ("r", "l")
    merged = {c: F.coalesce(*[F.col(f"{s}.`{c}`") for s in order]).alias(c) for c in columns}
    return joined.select(
        *[merged.get(c, F.col(f"l.`{c}`")) for c in left.columns],
        *[F.col(f"r.`{c}`") for c in right.columns if c not in keys and c not in columns],
    )


def anti_join(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """Left rows without a partner; a missing key finds a missing key."""
    return _membership(left, right, on, "left_anti")


def semi_join(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """Left rows with a partner; a missing key finds a missing key."""
    return _membership(left, right, on, "left_semi")


def _membership(left, right, on, how):
    pairs = _key_pairs(on)
    keys = right.select(*[F.col(f"`{b}`") for _, b in pairs]).distinct()
    return left.alias("l").join(keys.alias("r"), _condition(pairs), how)


def repeated_keys(df: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.groupBy(*on).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def join_checked(
    left: DataFrame, right: DataFrame, on: Sequence[str], relationship: str = "one-to-one"
) -> DataFrame:
    """Left join that fails, when it is run, if a key repeats on a side declared as "one".

    Keys are counted where the join needs their rows together anyway, so the check
    costs no pass and no exchange of its own; ``repeated_keys`` lists the repeats.
    """
    on = [on] if isinstance(on, str) else list(on)
    sides = []
    for one, df, name in zip(relationship.split("-to-"), (left, right), ("left", "right")):
        if one == "one":
            failed = F.raise_error(F.lit(f"repeated key on the {name} side of a {relationship} join"))
            alone = F.count(F.lit(1)).over(W.partitionBy(*on)) == 1
            df = df.withColumn("_alone", alone).where(F.when(F.col("_alone"), F.lit(True)).otherwise(failed.cast("boolean"))).drop("_alone")
        sides.append(df)
    return left_join_na(*sides, on)


def fanout_check(left: DataFrame, joined: DataFrame) -> DataFrame:
    """Row counts before and after a join, as one row."""
    before = left.agg(F.count(F.lit(1)).alias("n_before"))
    after = joined.agg(F.count(F.lit(1)).alias("n_after"))
    return before.select(
        "n_before",
        after.scalar().alias("n_after"),
        (F.col("n_before") == after.scalar()).alias("is_unchanged"),
    )
