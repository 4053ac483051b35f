"""Risk concentration, baseline shares and state drilldowns of sites."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import if_else, is_in, mean_r, n_distinct_r, paste, sum_r
from granary.functions.text import replace_all, replace_first, title
from granary.operators.aggregate import add_totals_row, distinct_if, sum_if
from granary.operators.columns import across, aggs, cols, recode
from granary.operators.joins import semi_join
from granary.operators.reshape import pivot_longer, transpose
from granary.operators.sets import union_by_name, union_literals
from granary.operators.windows import top_k

# Ratings that count as at risk, states of interest.
AT_RISK = ["Very High", "Relatively High", "Relatively Moderate"]
EMERGENCY_STATES = ["SC", "PR", "NC"]
DISASTER_STATES = ["FL", "PR", "SC"]

# Grantee names spelled in two ways.
DISASTER_GRANTEES = {
    "Episcopal Children's Services, Inc.": "Episcopal Children's Services",
    "GLEAMNS Human Resources Commission, Inc": "Gleamns Human Resource Commission, Inc.",
    "Le Jardin Community Center Inc": "Le Jardin Community Center, Inc.",
    "Orangeburg-Calhoun-Allendale-Bamberg Community Action Agency Inc": "Orangeburg-Calhoun-Allendale-Bamberg Community Action Agency, Inc.",
    "Step-Up Suncoast, Inc.": "Step Up Suncoast, Inc.",
}


def at_risk(by_risk: DataFrame) -> DataFrame:
    return by_risk.where(is_in("risk_rating", AT_RISK))


def focus_states(by_risk: DataFrame, k: int = 5, extra: Sequence[str] = EMERGENCY_STATES) -> DataFrame:
    """States with most at-risk federal-interest sites per risk type, plus some."""
    sites = at_risk(by_risk).where("is_federal_interest_site")
    counts = sites.groupBy("risk_type", "state_code").agg(F.count(F.lit(1)).alias("n_sites"))
    return union_literals(top_k(counts, ["risk_type"], ["-n_sites", "state_code"], k), "state_code", extra)


def grantee_concentration(by_risk: DataFrame, states: DataFrame, k: int = 10) -> DataFrame:
    """Per focus state the grantees with most at-risk federal-interest sites.

    ``states`` are a few per hazard, as made by ``focus_states``.
    """
    sites = semi_join(at_risk(by_risk).where("is_federal_interest_site"), states, "state_code")
    counts = sites.groupBy("state_code", "grantee").agg(
        n_distinct_r("location_id").alias("n_locations_per_grantee")
    )
    return top_k(counts, ["state_code"], ["-n_locations_per_grantee", "grantee"], k)


def state_risk_summary(by_risk: DataFrame, states: DataFrame, na_rm: bool = True) -> DataFrame:
    """Per state and hazard: sites, federal interest, owned, grantees, grants."""
    hazards = semi_join(at_risk(by_risk), states, "state_code").where("risk_type != 'Overall'")
    return hazards.groupBy("state_code", "risk_type").agg(
        n_distinct_r("location_id").alias("total"),
        distinct_if(F.col("is_federal_interest_site"), "location_id", na_rm).alias("with_federal_interest"),
        distinct_if(F.col("is_owned_by_program"), "location_id", na_rm).alias("owned"),
        n_distinct_r("grantee").alias("grantees"),
        n_distinct_r("grant_id").alias("grants"),
    )


def share_table(sites: DataFrame, tests: Mapping[str, Column], names_to: str) -> DataFrame:
    """Share and number of sites meeting each test, one row per test."""
    shares = sites.agg(*aggs({n: mean_r(t.cast("int")) for n, t in tests.items()}))
    long = pivot_longer(shares, list(tests), names_to, "pct_locations")
    n = sites.agg(F.count(F.lit(1)).alias("n")).scalar()
    return long.withColumn("n_locations", F.col("pct_locations") * n)


FLAG_NAMES = {
    "is_federal_interest_site": "Federal Interest",
    "is_owned_by_program": "Program-Owned",
    "is_child_care_partner_site": "Child Care Partner",
}


def characteristics(sites: DataFrame) -> DataFrame:
    table = share_table(sites, across(cols(sites, starts_with="is_"), lambda c: c), "characteristic")
    return recode(table.withColumn("program", F.col("characteristic")), "program", FLAG_NAMES)


def program_shares(sites: DataFrame) -> DataFrame:
    slots = cols(sites, ends_with="_slots", but_not=["total_slots"])
    table = share_table(sites, across(slots, lambda c: c > 0), "program")
    label = replace_first(replace_all("program", "_", " "), " slots", "")
    label = replace_first(replace_first(label, "ehs", "Early Head Start"), "hs", "Head Start")
    return table.withColumn("program", replace_first(title(label), "Aian", "AIAN"))


def federal_interest_by_state(sites: DataFrame) -> DataFrame:
    return sites.groupBy("state_code").agg(
        mean_r(F.col("is_federal_interest_site").cast("int")).alias("pct_federal_interest"),
        F.count(F.lit(1)).alias("n_locations"),
    )


def state_summary(sites: DataFrame, states: Sequence[str]) -> DataFrame:
    """Counts, distinct grants and slots per listed state, with a totals row."""
    named = recode(sites, "grantee", DISASTER_GRANTEES)
    summary = (
        named.where(is_in("state_code", states))
        .groupBy("state_code")
        .agg(
            n_distinct_r("grant_id").alias("n_grants"),
            n_distinct_r("grantee").alias("n_grantees"),
            F.count(F.lit(1)).alias("n_locations"),
            sum_r(F.col("is_federal_interest_site").cast("int")).alias("n_federal_interest"),
            sum_r(F.col("is_owned_by_program").cast("int")).alias("n_owned"),
            sum_r(F.col("is_child_care_partner_site").cast("int")).alias("n_child_care"),
            *aggs(across(cols(sites, ends_with="_slots"), sum_r, "n_{col}")),
        )
    )
    return add_totals_row(summary, "state_code")


def state_drilldown(by_risk: DataFrame, states: Sequence[str], na_rm: bool = True) -> DataFrame:
    """Per state: all sites under "Overall", at-risk sites under each hazard.

    Each migrant slot column sums its own program. ``na_rm=False`` counts the
    sites not at risk as one more grantee and grant, as the scripts do.
    """
    named = recode(by_risk, "grantee", DISASTER_GRANTEES).where(is_in("state_code", states))
    slots = cols(by_risk, ends_with="_slots")

    def measures(flag: Column | None) -> list[Column]:
        counted = F.lit(True) if flag is None else flag

        def total(value):
            value = value.cast("double")
            return sum_r(value) if flag is None else sum_if(flag, value)

        return [
            total(F.lit(1)).alias("total"),
            total(F.col("is_federal_interest_site").cast("int")).alias("with_federal_interest"),
            total(F.col("is_owned_by_program").cast("int")).alias("owned"),
            (n_distinct_r("grantee") if flag is None else distinct_if(counted, "grantee", na_rm)).alias("grantees"),
            (n_distinct_r("grant_id") if flag is None else distinct_if(counted, "grant_id", na_rm)).alias("grants"),
            *[total(F.col(c)).alias(c) for c in slots],
            total(F.col("is_child_care_partner_site").cast("int")).alias("child_care_partner"),
        ]

    keys = ["state_code", "risk_type"]
    overall = named.where("risk_type = 'Overall'").groupBy(*keys).agg(*measures(None))
    hazards = (
        named.where("risk_type != 'Overall'")
        .withColumn("is_at_risk", is_in("risk_rating", AT_RISK))
        .groupBy(*keys)
        .agg(*measures(F.col("is_at_risk")))
    )
    label = if_else(
        F.col("risk_type") == "Overall", F.col("risk_type"), paste(F.lit("At-risk for"), "risk_type")
    )
    return union_by_name(overall, hazards).withColumn("risk_type", label)


def drilldown_report(drilldown: DataFrame, state: str, categories: Sequence[str]) -> DataFrame:
    """The table of one state with measures as rows."""
    metrics = [c for c in drilldown.columns if c not in ("state_code", "risk_type")]
    return transpose(drilldown.where(F.col("state_code") == state), "risk_type", categories, metrics)
