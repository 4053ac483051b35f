"""Sites with address, coordinates, census tract and hazard ratings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.functions import (
    coalesce_in,
    if_else,
    is_in,
    lookup,
    paste,
    replace_all,
    replace_first,
    yes_no_text,
)
from granary.operators.columns import across, both, cols, level_rank
from granary.operators.enrich import cascade_lookup, one_per_key, pending_keys, repair_unmatched
from granary.operators.geometry import within_join
from granary.operators.joins import join_coalesce, left_join_na
from granary.operators.reshape import pivot_longer
from granary.operators.windows import ordering

# Areas rated by expected loss only.
TERRITORIES = ["PR", "GU", "MP", "AS", "VI", "PW"]
# Hazards, rating columns, their labels, and the levels from high to low.
HAZARDS = ["hrcn", "trnd", "wfir"]
RATINGS = ["risk_ratng", "hrcn_riskr", "trnd_riskr", "wfir_riskr"]
RISK_TYPES = {"risk": "Overall", "hrcn": "Hurricane", "trnd": "Tornado", "wfir": "Wildfire"}
RATING_LEVELS = [
    "Very High",
    "Relatively High",
    "Relatively Moderate",
    "Relatively Low",
    "Very Low",
    "Not Applicable",
    "Insufficient Data",
]


def prepare_hazards(tracts: DataFrame, territories: Sequence[str] = TERRITORIES) -> DataFrame:
    """In territories the expected-loss rating stands in for the risk rating."""
    return tracts.withColumns(
        {f"{h}_riskr": if_else(is_in("state_code", territories), F.col(f"{h}_ealr"), F.col(f"{h}_riskr")) for h in HAZARDS}
    )


def mailing_address() -> Column:
    text = paste(paste("address_line1", "city", "state_code", sep=", "), "zip", sep=" ")
    return replace_all(text, r"[#\(\)]+", "")


def add_coordinates(sites: DataFrame, sources: Sequence[tuple[str, DataFrame]], own: str = "hses") -> DataFrame:
    """Coordinates of sites lacking them, from address tables in order.

    ``sources`` hold (address, lat, lon, building_type); each distinct address is
    looked up once and the answering source recorded.
    """
    tagged = sites.withColumns(
        {"address": mailing_address(), "geocode_source": if_else(F.col("lat").isNull(), F.lit(None).cast("string"), F.lit(own))}
    )
    pending = pending_keys(tagged, "address", F.col("lat").isNull() | F.col("lon").isNull())
    answers = cascade_lookup(
        pending, "address", ["lat", "lon", "building_type"], sources, "geocode_source"
    )
    joined = join_coalesce(tagged, answers, "address", ["lat", "lon", "geocode_source"])
    building = (
        F.when(F.col("building_type").isNull(), F.lit("unknown"))
        .when(is_in("building_type", ["yes", "unclassified"]), F.lit("unknown"))
        .otherwise(replace_first("building_type", "_", " "))
    )
    return joined.withColumn("building_type", building)


def add_tracts(
    sites: DataFrame, polygons: DataFrame, fallback: DataFrame, hazards: DataFrame
) -> DataFrame:
    """Tract by location, else by the fallback table; then the tract's hazards. Every site stays."""
    placed = within_join(sites, polygons, "tract_fips", "lon", "lat")
    ratings = one_per_key(hazards, "tract_fips", ["nia_id", *RATINGS])
    return repair_unmatched(placed, "location_id", "tract_fips", fallback, ratings)


def risk_long(sites: DataFrame, ratings: Sequence[str] = RATINGS) -> DataFrame:
    """One row per site and risk type; no rating becomes "Insufficient Data"."""
    long = pivot_longer(sites, both(ratings, sites.columns), "risk_type", "risk_rating")
    kind = replace_first(replace_first("risk_type", "_ratng", ""), "_riskr", "")
    rating = (
        F.when(F.col("risk_rating").isNull() | (F.col("risk_rating") == "No Rating"), F.lit("Insufficient Data"))
        .otherwise(F.col("risk_rating"))
    )
    named = long.withColumns({"risk_type": lookup(kind, RISK_TYPES), "risk_rating": rating})
    return named.withColumns(
        {
            "risk_type_level": level_rank("risk_type", list(RISK_TYPES.values())),
            "risk_rating_level": level_rank("risk_rating", RATING_LEVELS),
        }
    )


def map_export(sites: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sites by program type with Yes/No flags and a counter per site."""
    slots = cols(sites, ends_with="_slots")
    chosen = sites.select(*columns, *cols(sites, starts_with="is_"), *slots, *cols(sites, any_of=RATINGS))
    long = pivot_longer(chosen, slots, "program_type", "program_slots")
    named = long.withColumn("program_type", replace_first("program_type", "_slots$", ""))
    flagged = named.withColumns(across(cols(named, starts_with="is_"), yes_no_text))
    # at most one row per slot column and site
    place = F.array_position(F.array(*[F.lit(c) for c in slots]), F.concat("program_type", F.lit("_slots")))
    counter = F.row_number().over(W.partitionBy("location_id").orderBy("_place"))
    return flagged.withColumn("_place", place).withColumn("dummy_filter", counter).drop("_place")
