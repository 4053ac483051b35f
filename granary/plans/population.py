"""Population estimates with margins of error, and banded household dimensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions import row_count_if
from granary.operators.columns import band, code_band, cols, score_label
from granary.operators.joins import left_join_na
from granary.operators.survey import Design, moe_shares, survey_total, with_moe

# Bounds and labels of the bands, in the order they are tried.
INCOME_BANDS = [
    (">=", 200000, "$200,000 or Greater"),
    (">", 150000, "$150,000 to $199,999"),
    (">", 120000, "$120,000 to $149,999"),
    (">", 100000, "$100,000 to $119,999"),
    (">", 80000, "$80,000 to $99,999"),
    (">", 70000, "$70,000 to $79,999"),
    (">", 60000, "$60,000 to $69,999"),
    (">", 50000, "$50,000 to $59,999"),
    (">", 40000, "$40,000 to $49,999"),
    (">", 30000, "$30,000 to $39,999"),
    (">", 20000, "$20,000 to $29,999"),
    (">", 10000, "$10,000 to $19,999"),
    (">", 0, "$0 to $9999"),
]
MEDIAN_BANDS = [
    (">", 5, "500% or Greater"),
    (">", 4, "400% to 499%"),
    (">", 3, "300% to 399%"),
    (">", 2, "200% to 299%"),
    (">", 1.49, "150% to 199%"),
    (">", 1, "100% to 149%"),
    (">", 0.5, "50% to 99%"),
    (">", 0.25, "25% to 49%"),
    (">", 0, "0% to 24%"),
]
POVERTY_BANDS = [
    ("<", 50, "Less than 50%"),
    ("<", 100, "50% to 99%"),
    ("<", 150, "100% to 149%"),
    ("<", 200, "150% to 199%"),
    ("<", 250, "200% to 249%"),
    ("<", 300, "250% to 299%"),
    ("<", 350, "300% to 349%"),
    ("<", 400, "350% to 399%"),
    ("<", 450, "400% to 449%"),
    ("<", 500, "450% to 499%"),
    (">=", 500, "500% or Greater"),
]
RACES = {
    1: "White, including Middle Eastern or North African",
    2: "Black or African American",
    3: "American Indian or Alaska Native",
    7: "Other Race",
}
RACE_RANGES = [
    (400, 620, "Asian"),
    (640, 643, "Asian"),
    (660, 679, "Asian"),
    (630, 634, "Native Hawaiian or Other Pacific Islander"),
    (680, 699, "Native Hawaiian or Other Pacific Islander"),
]


def banded_dimensions(people: DataFrame, states: DataFrame | None = None, missing_codes: Sequence[int] = ()) -> DataFrame:
    """Household, child and parent dimensions as labels."""
    df = people if states is None else left_join_na(people, states, "statefip")
    df = df.withColumn(
        "hh_pctof_smi", F.when(F.col("hhincome") > 0, F.col("hhincome") / F.col("smi4")).otherwise(0.0)
    )
    race = F
    for code, name in RACES.items():
        race = race.when(F.col("race") == code, F.lit(name))
    child_race = F.coalesce(
        race,
        code_band("raced", RACE_RANGES),
        F.when(F.col("race") >= 8, F.lit("Multi-Race")),
    )
    ages, schools, jobs = (cols(df, starts_with=p) for p in ("age_", "educd_", "empstat_"))
    scored = df.withColumns(
        {
            "household_income": band("hhincome", INCOME_BANDS, "None or Unreported", missing_codes),
            "household_income_as_percent_of_state_median_income": band("hh_pctof_smi", MEDIAN_BANDS, "0% OF SMI"),
            "child_ethnicity": F.when(F.col("hispan") == 0, F.lit("Not Hispanic or Latino"))
            .when(F.col("hispan") == 9, F.lit("Unknown"))
            .otherwise(F.lit("Hispanic or Latino")),
            "child_race": child_race,
            "household_income_as_percentage_of_poverty_line": band("poverty", POVERTY_BANDS),
            "parents_age_score": row_count_if(ages, lambda c: c < 18),
            "parents_college_score": row_count_if(schools, lambda c: c > 100),
            "parents_high_school_score": row_count_if(schools, lambda c: c > 61),
            "parents_employment_score": row_count_if(jobs, lambda c: c == 1),
        }
    )
    college, school = F.col("parents_college_score"), F.col("parents_high_school_score")
    return scored.withColumns(
        {
            "parents_age": score_label(
                "parents_age_score", "Both Parents Over 18", "One Parent Under 18", "Both Parents Under 18"
            ),
            "parents_education": F.when(college > 1, F.lit("Bachelors or Greater: Both Parents"))
            .when(college == 1, F.lit("Bachelors or Greater: One Parent"))
            .when(school > 1, F.lit("High School Diploma or GED: Both Parents"))
            .when(school == 1, F.lit("High School Diploma or GED: One Parent"))
            .otherwise(F.lit("No High School or Higher Education Degree: Both Parents")),
            "parents_employment": score_label(
                "parents_employment_score",
                "Both Parents Unemployed or Not in Labor Force",
                "One Parent Employed",
                "Both Parents Employed",
            ),
        }
    )


def poverty_estimates(people: DataFrame, design: Design, by: Sequence[str], poverty_limit: float = 100) -> DataFrame:
    """Population by area, age and poverty with margins of error."""
    flag = "household_income_less_than_100pct_poverty"
    flagged = people.withColumn(flag, F.col("poverty") <= poverty_limit)
    return with_moe(survey_total(flagged, [*by, flag], design, "population_estimate"), "population_estimate")


def margin_shares(estimates: DataFrame) -> DataFrame:
    return moe_shares(estimates, "population_estimate_moe_rel", {"over_50pct": 0.5, "over_100pct": 1.0})
