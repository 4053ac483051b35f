"""Survey estimates from replicate weights, margins of error, thresholds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.missing import as_col, if_else, known, mean_r, pmax, pmin
from granary.functions.numbers import ratio
from granary.operators.joins import left_join_na
from granary.operators.quantiles import group_quantiles

Z_90 = 1.645  # fixed value: census standard, 90% confidence


@dataclass(frozen=True)
class Design:
    """Base weight, replicate weights and their scale factors."""

    weight: str
    repweights: tuple[str, ...]
    scale: float = 4 / 80
    rscales: tuple[float, ...] | None = None
    mse: bool = True  # deviations about the full estimate, else about the replicates' mean


def survey_total(df: DataFrame, by: Sequence[str], design: Design, name: str = "estimate") -> DataFrame:
    """Per group: weighted total, its standard error, unweighted row count.

    All replicate totals come from one aggregation, so there is one exchange of
    (groups x replicates) sums whatever the number of rows.
    """
    totals = df.groupBy(*by).agg(
        F.sum(design.weight).alias(name),
        F.array(*[F.sum(w) for w in design.repweights]).alias("_reps"),
        F.count(F.lit(1)).alias("n"),
    )
    n = len(design.repweights)
    scales = F.array(*[F.lit(float(s)) for s in design.rscales or (1.0,) * n])
    centre = (
        F.col(name)
        if design.mse
        else F.aggregate("_reps", F.lit(0.0), lambda a, r: a + r) / F.lit(float(n))
    )
    squares = F.zip_with("_reps", scales, lambda r, s: s * (r - centre) * (r - centre))
    variance = F.aggregate(squares, F.lit(0.0), lambda a, s: a + s) * design.scale
    return totals.select(*by, name, F.sqrt(variance).alias(f"{name}_se"), "n")


def with_moe(df: DataFrame, name: str = "estimate", z: float = Z_90) -> DataFrame:
    """Margin of error and the margin relative to the estimate."""
    moe = F.col(f"{name}_se") * z
    return df.withColumns({f"{name}_moe": moe, f"{name}_moe_rel": ratio(moe, name)})


def moe_shares(df: DataFrame, column: str, thresholds: dict[str, float]) -> DataFrame:
    """Share of rows whose relative margin exceeds each threshold.

    A margin that is NaN compares as unknown, and one unknown makes the share so.
    """
    return df.agg(
        *[
            mean_r((known(column) > limit).cast("int")).alias(name)
            for name, limit in thresholds.items()
        ]
    )


def margin_band(middle: str, margin: str) -> dict[str, Column]:
    """Low and high end of a published share (kept in 0..1) and relative margin."""
    mid, moe = as_col(middle), as_col(margin)
    return {
        "low": pmax(mid - moe, F.lit(0.0)),
        "high": pmin(mid + moe, F.lit(1.0)),
        "relative": if_else(mid == 0, F.lit(None).cast("double"), ratio(moe, mid)),
    }


def two_step_threshold(df: DataFrame, group: str, first: str, second: str) -> DataFrame:
    """Rows at or above the group's P75 of ``first`` and, among rows strictly
    above it, at or below the group's P25 of ``second``."""
    upper = group_quantiles(df, [group], {"first_p75": (first, 0.75)})
    ranked = left_join_na(df, upper, group)
    lower = group_quantiles(
        ranked.where(F.col(first) > F.col("first_p75")), [group], {"second_p25": (second, 0.25)}
    )
    return left_join_na(ranked, lower, group).where(
        (F.col(first) >= F.col("first_p75")) & (F.col(second) <= F.col("second_p25"))
    )
