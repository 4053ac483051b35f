"""Monthly enrollment: tidy, typed, with the initiative's status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions import in_months_after, lookup, parse_date, to_number, yes_no
from granary.operators.columns import across, cols
from granary.operators.joins import left_join_na
from granary.operators.reshape import tidy_multi_header
from granary.operators.windows import row_key
from granary.session import cut_lineage

# Grant types by program acronym.
GRANT_TYPES = {
    "CH": "Region 01 – 10",
    "CI": "Region 11 American Indian and Alaska Native (AIAN)",
    "HP": "Region 01 – 10 EHS-CCP",
    "HI": "Region 11 American Indian and Alaska Native (AIAN) EHS-CCP",
}
# Columns of the sheet and their names here.
RENAMED = {
    "grant_number": "grant_id",
    "month": "report_month",
    "preceding_grant": "preceding_grant_id",
    "hses_funded": "slots_funded",
    "reported": "slots_reported",
    "enrolled": "slots_enrolled",
    "reserved": "slots_reserved",
    "vacant": "slots_vacant",
    "diff": "slots_diff_reported_from_funded",
    "percent": "slots_pct_reported_over_funded",
}
# yes/no columns, the region of interim grants, and the day from which starts are reliable.
FLAGS = ["head_start", "early_head_start", "operational"]
INTERIM_REGION = "13"
RELIABLE_FROM = "2023-01-01"


def tidy_enrollment(
    sheet: DataFrame, ordinal: str, ids: Sequence[str], columns: Sequence[str], metrics: Sequence[str]
) -> DataFrame:
    """Wide sheet (month, program, metric header rows) to grant x month x program."""
    wanted = [m for m in metrics if "total" not in m.lower()]
    body = sheet.where((F.col(ordinal) <= 3) | F.col(ids[0]).isNotNull())
    return tidy_multi_header(body, ordinal, 3, ids, columns, ["month", "program", "metric"], wanted)


def type_enrollment(tidy: DataFrame, month_formats: Sequence[str] = ("MMM yyyy", "MMMM yyyy", "yyyy-MM-dd")) -> DataFrame:
    kept = tidy.where((F.col("region") != INTERIM_REGION) & F.col("hses_funded").isNotNull())
    named = kept.withColumnsRenamed(RENAMED)
    numbers = [*cols(named, starts_with="slots_"), *cols(named, any_of=["months_under_enrolled"])]
    grant_type = lookup("program_acronym", GRANT_TYPES)
    detail = (
        F.when(grant_type.contains("AIAN"), F.lit("AIAN"))
        .when(grant_type.contains("MSHS"), F.lit("MSHS"))
        .otherwise(F.lit("Base"))
    )
    flags = cols(named, any_of=FLAGS)
    return named.withColumns(
        {
            "report_month": parse_date("report_month", *month_formats),
            "grant_type": grant_type,
            "program_detail": detail,
            **across(numbers, to_number),
            **across(flags, lambda c: yes_no(c, "yes", "no")),
        }
    )


def attach_initiative(
    enrollment: DataFrame,
    initiative: DataFrame,
    order: Sequence[str],
    months: int = 12,
) -> DataFrame:
    """Status and start of the initiative per report, and whether it was running."""
    members = initiative.select(
        "grant_id",
        F.coalesce("fei_status_hs", "fei_status_ehs").alias("fei_status"),
        F.coalesce("fei_effective_date_hs", "fei_effective_date_ehs").alias("fei_effective_date"),
        F.lit(True).alias("_member"),
    )
    joined = left_join_na(enrollment, members, "grant_id")
    early = F.col("fei_effective_date") < F.lit(RELIABLE_FROM).cast("date")
    flagged = joined.withColumns(
        {
            "is_report_month_during_fei": in_months_after("report_month", "fei_effective_date", months),
            "is_fei": F.when(F.col("_member").isNull(), F.lit(False)).when(early, F.lit(False)).otherwise(F.lit(True)),
        }
    ).drop("_member")
    return row_key(cut_lineage(flagged), order, "pk")
