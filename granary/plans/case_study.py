"""Shortlist of illustrative sites by hazard, poverty and its certainty."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions import is_in, n_distinct_r, replace_first, to_number
from granary.operators.columns import across, cols
from granary.operators.geometry import area_class, within_join
from granary.operators.joins import left_join_na
from granary.operators.quantiles import group_quantiles
from granary.operators.reshape import pivot_longer
from granary.operators.survey import margin_band, two_step_threshold
from granary.plans.risk import AT_RISK
from granary.plans.sites import HAZARDS, TERRITORIES
from granary.sources.tables import nullify_tokens

# Missing-value spellings of the survey download.
NULL_TOKENS = ["null", "-", "**"]
ISOLATED = [*TERRITORIES, "HI", "AK"]


def poverty_by_tract(raw: DataFrame) -> DataFrame:
    """Share in poverty with its band, from text (GEO_ID, NAME, estimate, margin)."""
    estimate, margin = "S1701_C03_003E", "S1701_C03_003M"
    plain = nullify_tokens(raw, [estimate, margin], NULL_TOKENS)
    shares = plain.select(
        replace_first("GEO_ID", "1400000US", "").alias("tract_fips"),
        F.col("NAME").alias("tract_name"),
        (to_number(estimate) / 100).alias("pct_poverty_middle"),
        (to_number(margin) / 100).alias("pct_poverty_moe"),
    )
    band = margin_band("pct_poverty_middle", "pct_poverty_moe")
    return shares.withColumns(
        {
            "pct_poverty_high": band["high"],
            "pct_poverty_low": band["low"],
            "pct_poverty_moe_relative": band["relative"],
        }
    )


def area_types(sites: DataFrame, urban: DataFrame) -> DataFrame:
    placed = within_join(sites, urban, "ua_id", "lon", "lat")
    return placed.withColumn("area_type", area_class("ua_id", "state_code", ISOLATED))


def very_high_programs(sites: DataFrame) -> DataFrame:
    """Federal-interest sites with a very high hazard, by funded program."""
    very_high = F.lit(False)
    for hazard in HAZARDS:
        very_high = very_high | (F.col(f"{hazard}_riskr") == "Very High")
    slots = cols(sites, ends_with="_slots")
    long = pivot_longer(
        sites.where(F.col("is_federal_interest_site") & very_high), slots, "program_type", "program_slots"
    )
    named = long.withColumn("program_type", replace_first("program_type", "_slots$", ""))
    return named.where(F.col("program_slots") > 0)


def case_study_options(sites: DataFrame) -> DataFrame:
    """Programs in poor tracts whose poverty rate is known best."""
    return two_step_threshold(
        very_high_programs(sites), "program_type", "pct_poverty_low", "pct_poverty_moe_relative"
    )


def similar_sites(sites: DataFrame, ratings: Sequence[str] | None = None) -> DataFrame:
    """Sites at risk by hazard and area type, whatever their poverty."""
    ratings = ratings or cols(sites, ends_with="_riskr")
    long = pivot_longer(sites, ratings, "risk_type", "risk_rating")
    named = long.withColumn("risk_type", replace_first("risk_type", "_riskr$", ""))
    risky = named.where(is_in("risk_rating", AT_RISK))
    keys = ["risk_type", "area_type"]
    counts = risky.groupBy(*keys).agg(
        n_distinct_r("location_id").alias("n_locations"), n_distinct_r("state_code").alias("n_states")
    )
    return left_join_na(
        counts, group_quantiles(risky, keys, {"median_pov": ("pct_poverty_middle", 0.5)}), keys
    )


def option_checks(options: DataFrame) -> DataFrame:
    """Distinct options, and options per hazard rated very high, as one row."""
    return options.agg(
        F.count_distinct("location_id").alias("n_locations"),
        *[
            F.sum((F.col(f"{h}_riskr") == "Very High").cast("int")).alias(f"n_{h}")
            for h in HAZARDS
        ],
    )
