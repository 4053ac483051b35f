"""Award history to yearly disbursements, and the check against actuals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import detect, extract, half_even, to_number, zero_to_null
from granary.operators.aggregate import n_distinct_r
from granary.operators.checks import remove_ids, rolled_difference, source_difference, violations
from granary.operators.columns import across, both, cols, fiscal_year_of, impute, rename_with
from granary.operators.joins import left_join_na
from granary.operators.linkage import apply_threshold, link
from granary.operators.reshape import pivot_longer, pivot_wider_unique
from granary.functions.missing import is_in, sum_r

# Language programs, ids that are subtotals, codes in grant numbers.
LANGUAGE_GRANTS = ["EMI", "P&M"]
SUBTOTAL_IDS = ["NA23004143", "NL23002470", "NL22002310"]
PROGRAM_CODES = {"90NA": "SEDS", "90NB": "EMI", "90NL": "PMI", "90NK": "SEDS-AK", "90NR": "ERE"}


def pull_fields(sheet: DataFrame) -> DataFrame:
    """Fields of one decision sheet, found by name pattern, as names drift."""
    sheet = rename_with(sheet, cols(sheet, contains="Approved Amount"), lambda c: f"amt_app_{c[-2:].lower()}")
    sheet = rename_with(sheet, cols(sheet, contains="Amount Requested"), lambda c: f"amt_req_y{c[-1:]}")
    numbered = cols(sheet, contains="Number")
    grant_number = both(numbered, cols(sheet, contains="Grant"))
    application = [c for c in numbered if c not in cols(sheet, contains=["Serial", "Panel", "Grant"])]
    amounts = cols(sheet, starts_with="amt_")
    fields = sheet.select(
        F.col(f"`{application[0]}`").cast("string").alias("application_id"),
        (F.col(f"`{grant_number[0]}`") if grant_number else F.lit(None)).cast("string").alias("grant_number"),
        F.lower("Name").alias("grantee"),
        F.col(f"`{cols(sheet, starts_with='Fund')[0]}`").cast("string").alias("decision"),
        *[zero_to_null(to_number(F.col(c).cast("string"))).alias(c) for c in amounts],
        *[c for c in ("grant", "fy_approved") if c in sheet.columns],
    )
    funded = F.when(F.col("amt_app_y1").isNotNull(), F.lit("F")).otherwise(F.col("decision"))
    return fields.withColumn("decision", funded).where(
        detect("decision", "^F") & F.col("grantee").isNotNull()
    )


def disbursals(awards: DataFrame, fill_year: int = 2023) -> DataFrame:
    """One row per award and funded year, from approved and requested columns."""
    ids = ["grant", "application_id", "grantee", "fy_approved"]
    coded = awards.withColumn("grant", extract("grant", "[[:alpha:]&-]+"))
    long = pivot_longer(coded.select(*ids, *cols(coded, starts_with="amt_")), cols(coded, starts_with="amt_"), "type_yn", "amt")
    typed = long.withColumns(
        {"type": extract("type_yn", "req|app"), "yr_n": extract("type_yn", "[[:digit:]]").cast("int")}
    )
    wide = pivot_wider_unique(typed, [*ids, "yr_n"], "type", "amt", ["app", "req"], "amt_{name}")
    open_year = (F.col("fy_approved") == fill_year) & (F.col("yr_n") > 1)
    language = F.when(is_in("grant", LANGUAGE_GRANTS), F.lit("language")).otherwise(F.lit("development"))
    return (
        wide.withColumns(
            {
                "amt_app": impute("amt_app", open_year, "amt_req"),
                "fy_disbursed": fiscal_year_of("fy_approved", "yr_n"),
                "grant_type": language,
            }
        )
        .where(F.col("amt_app").isNotNull())
        .select("grant", "grant_type", "application_id", "grantee", "yr_n", "fy_approved", "fy_disbursed", "amt_app")
    )


def without_subtotals(rows: DataFrame, ids: Sequence[str] = SUBTOTAL_IDS) -> DataFrame:
    return remove_ids(rows, "application_id", ids)


def award_count_check(rows: DataFrame, awards: DataFrame) -> DataFrame:
    """Distinct awards against source rows, as one row."""
    n = awards.agg(F.count(F.lit(1)).alias("n")).scalar()
    return rows.agg(n_distinct_r("application_id").alias("n_awards")).select(
        "n_awards", n.alias("n_source_rows"), (F.col("n_awards") == n).alias("is_equal")
    )


def program_trend(rows: DataFrame) -> DataFrame:
    return rows.groupBy("fy_approved", "grant").agg(
        n_distinct_r("application_id").alias("n"), sum_r("amt_app").alias("amt_approved")
    )


def award_spans(rows: DataFrame) -> DataFrame:
    """Duration, total and last year of each award."""
    spans = rows.groupBy("grant", "grant_type", "application_id", "grantee", "fy_approved").agg(
        F.count(F.lit(1)).cast("int").alias("duration_yrs"), sum_r("amt_app").alias("amt_total")
    )
    return spans.withColumn("fy_end", fiscal_year_of("fy_approved", "duration_yrs"))


def program_of_number(number: str, codes: dict[str, str] = PROGRAM_CODES) -> Column:
    """Program by the code a grant number contains."""
    program = F
    for code, name in codes.items():
        program = program.when(F.col(number).contains(code), F.lit(name))
    return program


def continuation_differences(model: DataFrame, actual: DataFrame) -> DataFrame:
    """Continuations by program, actual minus model; programs trimmed and unique."""
    trimmed = [df.select(F.trim("grant").alias("grant"), "continuations") for df in (model, actual)]
    return source_difference(*trimmed, on=["grant"], value="continuations")


def match_actuals(rows: DataFrame, actual: DataFrame, min_similarity: float = 0.75) -> DataFrame:
    """Modelled disbursals with the actual amount of the best matching grantee.

    Amounts of matches weaker than ``min_similarity`` count as zero;
    ``revised_amount_raw`` has them as they are.
    """
    matches = link(rows, actual, "grantee", "grant", "application_id", "grant_number")
    amounts = actual.select("grant_number", F.col("grant").alias("grant_actual"), "revised_amount")
    joined = left_join_na(left_join_na(rows, matches, "application_id"), amounts, "grant_number")
    scored = apply_threshold(joined, "revised_amount", min_similarity)
    return scored.withColumns(
        {
            "grant": F.coalesce("grant", "grant_actual"),
            "difference": F.col("revised_amount") - F.col("amt_app"),
        }
    ).drop("grant_actual")


def raw_differences(matched: DataFrame, program: str = "EMI") -> DataFrame:
    """Awards of a program whose amount is not the partner's, weak partners included."""
    raw = F.col("revised_amount_raw")
    return matched.where((F.col("grant") == program) & (F.col("amt_app") != raw)).select(
        "application_id", "grant", "amt_app", raw.alias("revised_amount")
    )


def unequal_amounts(matched: DataFrame) -> DataFrame:
    return violations(matched, F.col("amt_app") == F.col("revised_amount"))


def check_by_program(matched: DataFrame, summary: DataFrame) -> DataFrame:
    """Differences of unequal awards summed by program against the program's own."""
    return rolled_difference(matched, "grant", summary)


def approved_differences(rows: DataFrame, awards: DataFrame, actual: DataFrame) -> DataFrame:
    """Awards whose rounded amount is not the approved amount of their number."""
    numbered = left_join_na(rows, awards.select("application_id", "grant_number"), "application_id")
    known = numbered.where(F.col("grant_number").isNotNull())
    joined = left_join_na(known, actual.select("grant_number", "approved_amount"), "grant_number")
    rounded = joined.withColumn("amt_app", half_even("amt_app"))
    return violations(rounded, F.col("amt_app") == F.col("approved_amount"))
