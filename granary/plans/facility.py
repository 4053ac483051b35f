"""Facility master: centers and administrative facilities to one row per site."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions import replace_first, row_sum, to_number, yes_no
from granary.operators.aggregate import consolidate
from granary.operators.checks import uncovered
from granary.operators.columns import across, cols, recode, split_suffix_type
from granary.operators.joins import anti_join, left_join_na
from granary.operators.reshape import pivot_wider
from granary.operators.sets import align, union_by_name
from granary.operators.windows import add_entity_id
from granary.session import cut_lineage
from granary.functions.missing import paste

FLAGS = ["is_federal_interest_site", "is_owned_by_program", "is_child_care_partner_site"]
LICENSING = ["state_license_status", "state_license_comments", "qris_status", "qris_comments"]
SITE_KEYS = [
    "grant_id", "grantee", "program", "address_line1", "city", "state_code", "zip", "zip4", "county",
]

# Answers of the license and quality-rating questions.
LICENSE_LABELS = {
    "Yes": "State-licensed",
    "No, this center is exempt": "Exempt",
    "No, this center is not licensed for another reason": "Not licensed or exempt",
}
QRIS_LABELS = {
    "Yes": "Participates",
    "No": "Does not participate",
    "QRIS is not yet available": "QRIS is not yet available",
}

ROW_ORDER = "row_order"

# Program types of the enrollment system, in column order.
PROGRAM_TYPES = ["aian_ehs", "aian_hs", "ehs", "hs", "migrant_ehs", "migrant_hs"]


def _labelled(column: str, labels: dict[str, str]):
    label = F.when(F.col(column).isNull(), F.lit("Unknown"))
    for old, new in labels.items():
        label = label.when(F.col(column) == old, F.lit(new))
    return label


def clean_grantees(raw: DataFrame) -> DataFrame:
    return raw.select("grant_id", "agency_type", "agency_description").fillna(
        "Missing Data", ["agency_type", "agency_description"]
    )


def clean_centers(raw: DataFrame) -> DataFrame:
    return (
        raw.withColumns(across(FLAGS, yes_no))
        .withColumns(across(["total_slots", "lat", "lon"], to_number))
        .withColumns(
            {
                "county": replace_first("county", " County", ""),
                "state_license_status": _labelled("state_license_status", LICENSE_LABELS),
                "qris_status": _labelled("qris_status", QRIS_LABELS),
                "location_type": F.lit("center"),
            }
        )
    )


def clean_facilities(raw: DataFrame, centers: DataFrame) -> DataFrame:
    """Facilities in the columns of the centers; an unanswered flag counts as yes."""
    flagged = raw.withColumns(across(FLAGS, lambda c: yes_no(c, missing=True)))
    named = flagged.withColumns(
        {
            "county": replace_first("county", " County", ""),
            "location_type": F.lit("administrative facility"),
        }
    )
    aligned = align(named, centers)
    if ROW_ORDER not in aligned.columns:
        return aligned.distinct()
    # of equal rows the first one stays
    return aligned.groupBy(*[c for c in aligned.columns if c != ROW_ORDER]).agg(F.min(ROW_ORDER).alias(ROW_ORDER)).select(*aligned.columns)


def facility_master(
    centers: DataFrame,
    facilities: DataFrame,
    program_types: Sequence[str] = PROGRAM_TYPES,
) -> DataFrame:
    """One row per grant, program and address, with slots per program type.

    Texts of an address are joined in the order of the sources: centers before
    facilities, and in each by its ``row_order`` column, if it has one.
    """
    placed = [
        df.withColumn("_place", F.struct(F.lit(i).alias("source"), (F.col(ROW_ORDER) if ROW_ORDER in df.columns else F.lit(0)).cast("long").alias("row"))).drop(ROW_ORDER)
        for i, df in enumerate((centers, facilities))
    ]
    both = union_by_name(*placed).withColumn(
        "program_type", replace_first(F.lower("program_type"), " ", "_")
    )
    ids = [c for c in both.columns if c not in ("program_type", "total_slots", "_place")]
    first = [F.min("_place").alias("_place")]
    wide = pivot_wider(
        both, ids, "program_type", "total_slots", program_types, F.sum, 0.0, "{name}_slots", first
    )
    slots = cols(wide, ends_with="_slots")
    rules = {
        "address_line2": "list: ",
        "location_name": "list: / ",
        "location_type": "list: & ",
        "lat": "max",
        "lon": "max",
        "data_grantee_verification_status": "min",
        **{c: "any" for c in FLAGS},
        **{c: "list:" for c in LICENSING},
        **{c: "sum" for c in slots},
    }
    # rows without an order of their own go by their texts
    # numbering reads its rows more than once
    sites = cut_lineage(consolidate(wide, SITE_KEYS, rules, ["_place", "location_name", "address_line2", *LICENSING]))
    numbered = add_entity_id(sites, "grant_id", SITE_KEYS[1:], "location_id")
    return numbered.withColumn("total_slots", row_sum(slots)).select(
        *SITE_KEYS[:4], "address_line2", *SITE_KEYS[4:], "lat", "lon", "location_id",
        "location_name", "location_type", *slots, "total_slots",
        "data_grantee_verification_status", *FLAGS, *LICENSING,
    )


# Place-name suffixes and the types they tell, first match first.
PLACE_RULES = [
    (" city", "City"),
    (" Parish", "Parish"),
    (" City and Borough", "City and Borough"),
    (" Borough", "Borough"),
    (" Municipality", "Municipality"),
    (" Census Area", "Census Area"),
    (" Municipio", "Municipio"),
    (" District", "District"),
    (" Island", "Island"),
]

# Fixed values: (place, state) spelled otherwise in the hazard data.
PLACE_NAMES = {
    ("Dona Ana", "NM"): "Doña Ana",
    ("Bayamon", "PR"): "Bayamón",
    ("Rincon", "PR"): "Rincón",
    ("Mayaguez", "PR"): "Mayagüez",
    ("Juana Diaz", "PR"): "Juana Díaz",
    ("Penuelas", "PR"): "Peñuelas",
    ("San Sebastian", "PR"): "San Sebastián",
    ("Guanica", "PR"): "Guánica",
    ("San German", "PR"): "San Germán",
    ("Rio Grande", "PR"): "Río Grande",
    ("Las Marias", "PR"): "Las Marías",
    ("Anasco", "PR"): "Añasco",
    ("Canovanas", "PR"): "Canóvanas",
    ("Loiza", "PR"): "Loíza",
    ("Comerio", "PR"): "Comerío",
    ("Catano", "PR"): "Cataño",
    ("Manati", "PR"): "Manatí",
    ("La Salle", "LA"): "LaSalle",
    ("Wade Hampton", "AK"): "Kusilvak",
    ("Kodiak", "AK"): "Kodiak Island",
    ("Valdez-Cordova", "AK"): "Copper River",
    ("Shannon", "SD"): "Oglala Lakota",
}
PLACE_OF_CITY = {("Saipan", "MP"): "Saipan", ("Tinian", "MP"): "Tinian", ("Rota", "MP"): "Rota"}


def place_gaps(sites: DataFrame, places: DataFrame) -> DataFrame:
    """Distinct (county, state) of the sites that the other source lacks,
    in states it covers at all."""
    covered = sites.join(places.select("state_code").distinct(), "state_code", "left_semi")
    return anti_join(covered.select("county", "state_code").distinct(), places, ["county", "state_code"])


def reconcile_places(
    sites: DataFrame,
    places: DataFrame,
    rules: Sequence[tuple[str, str]] = PLACE_RULES,
    names: dict[tuple[str, str], str] = PLACE_NAMES,
    city_names: dict[tuple[str, str], str] = PLACE_OF_CITY,
    typed: dict[str, str] | None = None,
    default_type: str = "County",
) -> DataFrame:
    """Split the type off place names the other source does not know."""
    gaps = place_gaps(sites, places).withColumn("_gap", F.lit(True))
    marked = left_join_na(sites, gaps, ["county", "state_code"])

    def listed(column, table):
        return [
            ((F.col(column) == place) & (F.col("state_code") == state), new)
            for (place, state), new in table.items()
        ]

    fixed = listed("county", names)
    if "city" in sites.columns:
        fixed += listed("city", city_names)
    split = split_suffix_type(
        marked,
        "county",
        rules,
        "county_type",
        only=F.col("_gap").isNotNull(),
        otherwise=default_type,
        fixed_type={"Dona Ana": "County"} if typed is None else typed,
        fixed_name=fixed,
    ).drop("_gap")
    return split.withColumn("county_state_code", paste("county", "state_code", sep="-"))


def place_coverage(sites: DataFrame, places: DataFrame) -> DataFrame:
    """Sites whose place the other source lacks, counted by place."""
    keyed = places.select(paste("county", "state_code", sep="-").alias("county_state_code"))
    return uncovered(sites, "county_state_code", keyed)


# Grantee names spelled in two ways.
GRANTEE_NAMES = {
    "Child Development Resources Of Ventura County, Inc.": "Child Development Resources of Ventura County, Inc.",
    "Eckerd Youth Alternatives Inc.": "Eckerd Youth Alternatives, Inc.",
}


def attach_grantees(sites: DataFrame, grantees: DataFrame) -> DataFrame:
    return left_join_na(recode(sites, "grantee", GRANTEE_NAMES), grantees, "grant_id")
