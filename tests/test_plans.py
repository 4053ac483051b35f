"""Whole analyses on hand-made rows with the edge cases of FIXTURES.md."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from granary.plans import case_study, comments, disbursement, enrollment, facility, grants, population, risk, sites
from granary.operators.geometry import RINGS
from granary.operators.survey import Design
from test_operators import ring

CENTER = {
    "grant_id": "g1", "grantee": "Tribe", "program_type": "HS", "program": "p", "total_slots": "20",
    "location_name": "Oak", "address_line1": "1 Main", "address_line2": None, "city": "X", "state_code": "AL",
    "zip": "1", "zip4": None, "county": "County County", "lat": "30.5", "lon": "-80", "data_grantee_verification_status": "verified",
    "is_federal_interest_site": "Yes", "is_owned_by_program": "No", "is_child_care_partner_site": None,
    "state_license_status": "Yes", "state_license_comments": None, "qris_status": None, "qris_comments": "fine",
}
NOT_IN_FACILITIES = ["total_slots", "lat", "lon", "state_license_status", "state_license_comments", "qris_status", "qris_comments"]


@pytest.fixture(scope="module")
def master(frame):
    schema = ", ".join(f"{c} string" for c in CENTER)
    rows = [
        CENTER,
        CENTER | {"program_type": "AIAN EHS", "total_slots": "8", "location_name": "Ash", "data_grantee_verification_status": "incomplete", "is_federal_interest_site": None},
        CENTER | {"program_type": "HS", "total_slots": "n/a", "location_name": "Elm", "address_line1": "2 Main", "lat": None, "lon": "x"},
        CENTER | {"grant_id": "g2"},
    ]
    centers = facility.clean_centers(frame([tuple(r.values()) for r in rows], schema))
    office = {k: v for k, v in CENTER.items() if k not in NOT_IN_FACILITIES}
    office |= {"location_name": "Office", "address_line2": "Room 2", "is_owned_by_program": None}
    raw = frame([tuple(office.values())] * 2, ", ".join(f"{c} string" for c in office))
    facilities = facility.clean_facilities(raw, centers)
    assert facilities.columns == centers.columns and facilities.count() == 1
    return facility.facility_master(centers, facilities)


def test_facility_master_merges_an_address(master):
    got = {r.location_id: r for r in master.collect()}
    assert sorted(got) == ["g1-1", "g1-2", "g2-1"]
    site = got["g1-1"]
    assert site.county == "County" and site.address_line2 == "Room 2"
    assert site.location_name == "Ash / Oak / Office"
    assert site.location_type == "center & center & administrative facility"
    assert (site.lat, site.lon) == (30.5, -80.0)
    assert site.data_grantee_verification_status == "incomplete"
    assert site.is_federal_interest_site is True and site.is_owned_by_program is True
    assert site.is_child_care_partner_site is True
    assert site.state_license_status == "State-licensedState-licensed" and site.qris_status == "UnknownUnknown"
    assert (site.hs_slots, site.aian_ehs_slots, site.ehs_slots, site.total_slots) == (20.0, 8.0, 0.0, 28.0)
    other = got["g1-2"]
    assert (other.lat, other.lon, other.total_slots) == (None, None, 0.0)
    assert other.is_child_care_partner_site is None and other.address_line2 == ""


def test_places_are_reconciled(frame):
    places = frame(
        [("Norfolk", "VA"), ("Doña Ana", "NM"), ("Juneau", "AK"), ("James City", "VA"), ("Kusilvak", "AK"), ("Saipan", "MP")],
        "county string, state_code string",
    )
    rows = [
        ("Norfolk city", "VA", "n"), ("Dona Ana", "NM", "d"), ("Juneau City and Borough", "AK", "j"),
        ("James City", "VA", "k"), ("Wade Hampton", "AK", "w"), ("Other Parish", "PW", "o"), ("Northern Islands", "MP", "Saipan"),
    ]
    got = {r.city: r for r in facility.reconcile_places(frame(rows, "county string, state_code string, city string"), places).collect()}
    assert (got["n"].county, got["n"].county_type) == ("Norfolk", "City")
    assert (got["d"].county, got["d"].county_type) == ("Doña Ana", "County")
    assert (got["j"].county, got["j"].county_type) == ("Juneau", "City and Borough")
    assert (got["k"].county, got["k"].county_type) == ("James City", "County")
    assert got["w"].county == "Kusilvak" and got["w"].county_type is None
    # a state the other source does not cover is left alone
    assert (got["o"].county, got["o"].county_type) == ("Other Parish", "County")
    assert got["Saipan"].county_state_code == "Saipan-MP"


def test_site_enrichment(frame):
    locations = frame(
        [("s1", "#1 Main", "X", "AL", "1", 5.0, 5.0), ("s2", "2 Main", "X", "AL", "1", None, None),
         ("s3", "3 Main", "X", "PW", "1", None, None), ("s4", "4 Main", "X", "AL", "1", 50.0, 50.0)],
        "location_id string, address_line1 string, city string, state_code string, zip string, lat double, lon double",
    )
    schema = "address string, lat double, lon double, building_type string"
    osm = frame([("2 Main, X, AL 1", 6.0, 6.0, "child_care"), ("3 Main, X, PW 1", None, None, None)], schema)
    arcgis = frame([("3 Main, X, PW 1", 99.0, 99.0, "yes")], schema)
    placed = sites.add_coordinates(locations, [("osm", osm), ("arcgis", arcgis)])
    got = {r.location_id: r for r in placed.collect()}
    assert got["s1"].address == "1 Main, X, AL 1" and got["s1"].geocode_source == "hses"
    assert (got["s2"].lat, got["s2"].geocode_source, got["s2"].building_type) == (6.0, "osm", "child care")
    assert (got["s3"].geocode_source, got["s3"].building_type) == ("arcgis", "unknown")
    tracts = frame([("T1", [ring((0, 0), (10, 0), (10, 10), (0, 10))])], f"tract_fips string, rings {RINGS}")
    fallback = frame([("s4", "T2")], "location_id string, tract_fips string")
    ratings = ("Very High", "No Rating", None, "Relatively Low")
    hazards = frame([("T1", "n1", *ratings), ("T2", "n2", *ratings)], "tract_fips string, nia_id string, " + ", ".join(f"{r} string" for r in sites.RATINGS))
    done = {r.location_id: r for r in sites.add_tracts(placed, tracts, fallback, hazards).collect()}
    assert {k: r.tract_fips for k, r in done.items()} == {"s1": "T1", "s2": "T1", "s3": None, "s4": "T2"}
    assert done["s4"].nia_id == "n2" and done["s3"].risk_ratng is None


def test_territories_take_the_expected_loss_rating(frame):
    names = [f"{h}_{k}" for h in sites.HAZARDS for k in ("riskr", "ealr")]
    df = frame([("PR", *["risk", "loss"] * 3), ("AL", *["risk", "loss"] * 3)], "state_code string, " + ", ".join(f"{n} string" for n in names))
    assert {r.state_code: r.hrcn_riskr for r in sites.prepare_hazards(df).collect()} == {"PR": "loss", "AL": "risk"}


SITE = (
    "location_id string, grant_id string, grantee string, state_code string, is_federal_interest_site boolean, "
    "is_owned_by_program boolean, is_child_care_partner_site boolean, hs_slots double, ehs_slots double, total_slots double, "
    "risk_ratng string, hrcn_riskr string, trnd_riskr string, wfir_riskr string"
)


@pytest.fixture(scope="module")
def located(frame):
    rows = [
        ("s1", "g1", "A", "FL", True, False, False, 10.0, 0.0, 10.0, "Very High", "Very High", "No Rating", None),
        ("s2", "g1", "A", "FL", True, True, False, 0.0, 5.0, 5.0, "Very Low", "Relatively Low", "Relatively Moderate", None),
        ("s3", "g2", "B", "FL", False, True, True, 7.0, 1.0, 8.0, "Relatively High", "Very High", "Very Low", "Not Applicable"),
        ("s4", "g3", "C", "TX", True, True, True, 3.0, 0.0, 3.0, "Relatively High", "Very Low", "Very Low", "Very High"),
    ]
    return frame(rows, SITE)


def test_risk_long_and_map(located):
    long = sites.risk_long(located)
    row = long.where("location_id = 's1' and risk_type = 'Tornado'").first()
    assert (row.risk_rating, row.risk_rating_level, row.risk_type_level) == ("Insufficient Data", 7, 3)
    assert long.count() == 16
    table = sites.map_export(located.drop("total_slots"), ["location_id"])
    assert {(r.program_type, r.dummy_filter) for r in table.collect()} == {("hs", 1), ("ehs", 2)}
    assert {r.is_owned_by_program for r in table.where("location_id = 's1'").collect()} == {"No"}


def test_risk_concentration(located):
    by_risk = sites.risk_long(located)
    states = risk.focus_states(by_risk, k=1)
    assert sorted(r.state_code for r in states.collect()) == ["FL", "NC", "PR", "SC", "TX"]
    got = [(r.state_code, r.grantee, r.n_locations_per_grantee) for r in risk.grantee_concentration(by_risk, states).collect()]
    assert sorted(got) == [("FL", "A", 2), ("TX", "C", 1)]


def test_concentration_has_the_shape_of_the_published_table(frame):
    rows = [(f"s{i}", f"g{i}", f"Grantee {i % 23:02d}", ["FL", "TX"][i % 2], True, True, True, 1.0, 1.0, 2.0, *["Very High"] * 4) for i in range(300)]
    by_risk = sites.risk_long(frame(rows, SITE))
    got = risk.grantee_concentration(by_risk, risk.focus_states(by_risk)).collect()
    for state in ("FL", "TX"):
        listed = [(-r.n_locations_per_grantee, r.grantee) for r in got if r.state_code == state]
        assert len(listed) == 10
        assert sorted(listed) == sorted(listed, key=lambda x: (x[0], x[1]))


def test_drilldown_counts_all_sites_overall_and_risky_ones_by_hazard(located):
    by_risk = sites.risk_long(located)
    got = {(r.state_code, r.risk_type): r for r in risk.state_drilldown(by_risk, ["FL"]).collect()}
    overall, storms = got["FL", "Overall"], got["FL", "At-risk for Hurricane"]
    assert (overall.total, overall.grantees, overall.hs_slots) == (3, 2, 17.0)
    assert (storms.total, storms.with_federal_interest, storms.grantees, storms.hs_slots, storms.ehs_slots) == (2, 1, 2, 17.0, 1.0)
    assert got["FL", "At-risk for Wildfire"].total == 0
    counted = {(r.state_code, r.risk_type): r for r in risk.state_drilldown(by_risk, ["FL"], na_rm=False).collect()}
    assert counted["FL", "At-risk for Hurricane"].grantees == 3
    report = risk.drilldown_report(risk.state_drilldown(by_risk, ["FL"]), "FL", ["Overall", "At-risk for Hurricane"])
    assert {r.metric: r["At-risk for Hurricane"] for r in report.collect()}["total"] == 2.0


def test_state_summary_and_baseline(located):
    got = {r.state_code: r for r in risk.state_summary(located, ["FL", "TX"]).collect()}
    assert (got["Total"].n_grantees, got["Total"].n_locations, got["FL"].n_hs_slots) == (3, 4, 17.0)
    flags = {r.program: r.pct_locations for r in risk.characteristics(located).collect()}
    assert flags == {"Federal Interest": 0.75, "Program-Owned": 0.75, "Child Care Partner": 0.5}
    programs = {r.program: r.pct_locations for r in risk.program_shares(located).collect()}
    assert programs == {"Head Start": 0.75, "Early Head Start": 0.5}
    summary = risk.state_risk_summary(sites.risk_long(located), located.select("state_code").distinct())
    assert {(r.state_code, r.risk_type): r.total for r in summary.collect()}["FL", "Hurricane"] == 2


def test_poverty_band_and_tokens(frame):
    df = frame(
        [("1400000US01", "Tract 1, Alabama", "10", "30"), ("1400000US02", "x", "-", "**"), ("1400000US03", "y", "0", "5")],
        "GEO_ID string, NAME string, S1701_C03_003E string, S1701_C03_003M string",
    )
    got = {r.tract_fips: r for r in case_study.poverty_by_tract(df).collect()}
    assert (got["01"].pct_poverty_low, got["01"].pct_poverty_high) == (0.0, pytest.approx(0.4))
    assert got["02"].pct_poverty_middle is None and got["02"].pct_poverty_high is None
    assert got["03"].pct_poverty_moe_relative is None


def test_case_study_thresholds(frame):
    rows = [(f"s{i}", True, "Very High", None, None, 10.0, 0.0, i / 100, 1 - i / 100) for i in range(1, 9)]
    rows += [("no", False, "Very High", None, None, 1.0, 1.0, 0.9, 0.0), ("low", True, "Very Low", None, None, 1.0, 1.0, 0.9, 0.0)]
    df = frame(rows, "location_id string, is_federal_interest_site boolean, hrcn_riskr string, trnd_riskr string, wfir_riskr string, "
                     "hs_slots double, ehs_slots double, pct_poverty_low double, pct_poverty_moe_relative double")
    # P75 of .01-.08 is .0625: s7, s8 above it; P25 of .92, .93 is .9225: s8 stays
    got = case_study.case_study_options(df).collect()
    assert [(r.location_id, r.program_type) for r in got] == [("s8", "hs")]


def test_enrollment(frame):
    tidy = frame(
        [("g1", "1", "CH", "Jan 2023", "HS", "10", "9", "yes"), ("g1", "1", "CH", "May 2023", "HS", "10", "9", None),
         ("g2", "2", "CI", "Jan 2023", "EHS", "5", "no data", "no"), ("g3", "13", "CH", "Jan 2023", "HS", "5", "5", "yes"),
         ("g4", None, "CH", "Jan 2023", "HS", "5", "5", "yes"), ("g5", "1", "ZZ", "Jan 2023", "HS", None, "5", "yes"),
         ("g6", "3", "HI", "Jan 2023", "HS", "4", "2", "yes"), ("g7", "3", "ZZ", "Jan 2023", "HS", "4", "2", "yes")],
        "grant_number string, region string, program_acronym string, month string, program string, hses_funded string, reported string, operational string",
    )
    typed = enrollment.type_enrollment(tidy)
    start = dt.date
    fei = frame(
        [("g1", None, None, "in", start(2023, 1, 31)), ("g2", "out", start(2022, 6, 1), "in", start(2023, 2, 1)), ("g6", "in", None, None, None)],
        "grant_id string, fei_status_hs string, fei_effective_date_hs date, fei_status_ehs string, fei_effective_date_ehs date",
    )
    got = {(r.grant_id, r.report_month.month): r for r in enrollment.attach_initiative(typed, fei, ["grant_id", "report_month"]).collect()}
    assert sorted(got) == [("g1", 1), ("g1", 5), ("g2", 1), ("g6", 1), ("g7", 1)]
    assert (got["g1", 1].is_report_month_during_fei, got["g1", 5].is_report_month_during_fei) == (False, True)
    assert got["g1", 1].is_fei is True and got["g1", 1].fei_status == "in"
    # date before 2023 is unreliable; no date keeps membership; not listed is no
    assert got["g2", 1].is_fei is False and got["g2", 1].slots_reported is None and got["g2", 1].operational is False
    assert got["g6", 1].is_fei is True and got["g6", 1].is_report_month_during_fei is None
    assert got["g7", 1].is_fei is False and got["g7", 1].grant_type is None
    assert got["g6", 1].program_detail == "AIAN" and got["g7", 1].program_detail == "Base"
    assert [got[k].pk for k in sorted(got)] == ["1", "2", "3", "4", "5"]


def test_comment_sample(frame):
    rows = [(r, f"{r}-{i}") for r in ("1", "2", "12", "Totals") for i in range(30)] + [(None, "n")]
    listed = frame(rows, "region string, grant_id string")
    sample = comments.grant_sample(listed, n=10)
    assert {r.region: r["count"] for r in sample.groupBy("region").count().collect()} == {"1": 5, "2": 5, None: 1}
    notes = listed.withColumn("slots_pct_reported_over_funded", F.when(F.col("region").isin("1", "2"), 0.5).otherwise(1.0))
    months = notes.withColumn("report_month", F.explode(F.array(F.lit("2022-02"), F.lit("2022-01"))))
    got = [(r.region, r.grant_id, r.report_month) for r in comments.comment_sample(months, sample).collect()]
    assert len(got) == 20 and got == sorted(got)
    by_region = comments.sample_by_region(comments.comment_sample(months, sample)).collect()
    assert [(r.region, r.n, r.pct) for r in by_region] == [("1", 10, 0.5), ("2", 10, 0.5)]


def test_population_dimensions(frame):
    schema = "hhincome int, smi4 double, hispan int, race int, raced int, poverty int, age_mom int, age_pop int, educd_mom int, educd_pop int, empstat_mom int, empstat_pop int"
    rows = [
        (200000, 100000.0, 0, 1, 100, 49, 17, None, 101, 62, 1, 1),
        (0, 100000.0, 9, 5, 630, 100, 40, 40, 62, 62, 1, 3),
        (None, 100000.0, 2, 8, 801, 500, 17, 16, 10, None, None, 3),
        (9999999, 100000.0, 1, 4, 410, None, 18, 18, 101, 101, 2, 3),
    ]
    df = population.banded_dimensions(frame(rows, schema), missing_codes=())
    got = df.collect()
    assert [r.household_income for r in got] == ["$200,000 or Greater", "None or Unreported", "None or Unreported", "$200,000 or Greater"]
    assert [r.household_income_as_percent_of_state_median_income for r in got] == ["150% to 199%", "0% OF SMI", "0% OF SMI", "500% or Greater"]
    assert [r.child_ethnicity for r in got] == ["Not Hispanic or Latino", "Unknown", "Hispanic or Latino", "Hispanic or Latino"]
    assert [r.child_race for r in got] == ["White, including Middle Eastern or North African", "Native Hawaiian or Other Pacific Islander", "Multi-Race", "Asian"]
    assert [r.household_income_as_percentage_of_poverty_line for r in got] == ["Less than 50%", "100% to 149%", "500% or Greater", None]
    assert [r.parents_age for r in got] == ["One Parent Under 18", "Both Parents Over 18", "Both Parents Under 18", "Both Parents Over 18"]
    assert [r.parents_education[:20] for r in got] == ["Bachelors or Greater", "High School Diploma ", "No High School or Hi", "Bachelors or Greater"]
    assert got[0].parents_education.endswith("One Parent") and got[3].parents_education.endswith("Both Parents")
    assert [r.parents_employment for r in got][:2] == ["Both Parents Employed", "One Parent Employed"]


def test_population_estimates_count_exactly_100_as_poor(frame):
    df = frame([("a", 100, 2.0, 2.0), ("a", 101, 3.0, 4.0)], "puma string, poverty int, perwt double, repwtp1 double")
    design = Design("perwt", ("repwtp1",), scale=1.0)
    got = {r.household_income_less_than_100pct_poverty: r for r in population.poverty_estimates(df, design, ["puma"]).collect()}
    assert (got[True].population_estimate, got[True].population_estimate_se) == (2.0, 0.0)
    assert got[False].population_estimate_se == 1.0
    assert population.margin_shares(population.poverty_estimates(df, design, ["puma"])).first().over_50pct == 0.5


@pytest.fixture(scope="module")
def awards(frame):
    early = frame(
        [("SEDS FY22", 2022, 1, 99, "Tribe A", "F", 100.0, 0.0, "5"), ("SEDS FY22", 2022, 2, 99, "Tribe B", "N", 0.0, 7.0, "5"),
         ("P&M 22", 2022, 3, 99, "Tribe C", None, 50.0, 60.0, "no data"), ("P&M 22", 2022, None, 0, None, None, 150.0, 60.0, "1")],
        "grant string, fy_approved int, `Application Number` int, `Panel Number` int, Name string, `Funding Decision` string, "
        "`Approved Amount Y1` double, `Approved Amount Y2` double, `Amount Requested 2` string",
    )
    late = frame(
        [("SEDS-AK", 2023, "4", "90NK1", "Tribe D", None, 10.0, None, "30", "40")],
        "grant string, fy_approved int, Number string, `Grant Number` string, Name string, Fund string, "
        "`Approved Amount Y1` double, `Approved Amount Y2` double, `Amount Requested 2` string, `Amount Requested 3` string",
    )
    a, b = disbursement.pull_fields(early), disbursement.pull_fields(late)
    return a.unionByName(b, allowMissingColumns=True)


def test_disbursement_history(awards):
    assert sorted(r.application_id for r in awards.collect()) == ["1", "3", "4"]
    got = {(r.application_id, r.yr_n): r for r in disbursement.disbursals(awards).collect()}
    amounts = {k: r.amt_app for k, r in got.items()}
    # zero is no amount; 2023 has its later years filled from the requests
    assert amounts == {("1", 1): 100.0, ("3", 1): 50.0, ("3", 2): 60.0, ("4", 1): 10.0, ("4", 2): 30.0, ("4", 3): 40.0}
    assert got["3", 2].grant == "P&M" and got["3", 2].grant_type == "language" and got["3", 2].fy_disbursed == 2023
    assert got["4", 3].grant == "SEDS-AK" and got["4", 3].fy_disbursed == 2025
    rows = disbursement.disbursals(awards)
    spans = {r.application_id: (r.duration_yrs, r.amt_total, r.fy_end) for r in disbursement.award_spans(rows).collect()}
    assert spans["4"] == (3, 80.0, 2025)
    assert {(r.fy_approved, r.grant): (r.n, r.amt_approved) for r in disbursement.program_trend(rows).collect()}[2022, "P&M"] == (1, 110.0)
    assert disbursement.award_count_check(rows, awards).first().is_equal
    assert disbursement.without_subtotals(rows, ["4"]).count() == 3


def test_reconciliation(frame):
    model = frame([(" EMI ", 10.0), ("ERE", 5.0), ("SEDS", 1.0)], "grant string, continuations double")
    actual = frame([("EMI", 12.0), ("ERE", 5.0)], "grant string, continuations double")
    summary = disbursement.continuation_differences(model, actual)
    assert {r.grant: r.difference for r in summary.collect()} == {"EMI": 2.0, "ERE": 0.0}
    rows = frame([("a1", "zuni tribe", "EMI", 10.0), ("a2", "hopi", "ERE", 5.0)], "application_id string, grantee string, grant string, amt_app double")
    paid = frame([("n1", "zuni tribes", "EMI", 12.0), ("n2", "something else", "ERE", 5.0)], "grant_number string, grantee string, grant string, revised_amount double")
    matched = disbursement.match_actuals(rows, paid)
    got = {r.application_id: r for r in matched.collect()}
    assert (got["a1"].revised_amount, got["a1"].difference, got["a1"].is_weak) == (12.0, 2.0, False)
    assert (got["a2"].revised_amount, got["a2"].is_weak) == (0.0, True)
    assert disbursement.unequal_amounts(matched).count() == 2
    checked = {r.grant: r.is_equal for r in disbursement.check_by_program(matched, summary).collect()}
    assert checked == {"EMI": True, "ERE": False}


def test_approved_amounts_round_half_to_even(frame):
    rows = frame([("a1", 0.5), ("a2", 1.5), ("a3", 2.5)], "application_id string, amt_app double")
    numbers = frame([("a1", "n1"), ("a2", "n2"), ("a3", None)], "application_id string, grant_number string")
    paid = frame([("n1", 0.0), ("n2", 1.0)], "grant_number string, approved_amount double")
    assert [r.application_id for r in disbursement.approved_differences(rows, numbers, paid).collect()] == ["a2"]


def test_closed_grants(frame):
    schema = "award_id_fain string, awarding_sub_agency_code string, period_of_performance_current_end_date date, business_types_description string, recipient_address_line_2 {}"
    kind, day = grants.TRIBAL_TYPES[0], dt.date(2022, 9, 30)
    one = frame([("a", "7590", day, kind, 5), ("b", "7590", day, "OTHER", 5), ("c", "1", day, kind, 5)], schema.format("int"))
    two = frame([("d", "7590", day + dt.timedelta(1), kind, "x"), (None, "7590", day, kind, "x"), ("e", "7590", day, kind, "x")], schema.format("string"))
    active = frame([("e",), (None,)], "award_id_fain string")
    assert [(r.award_id_fain, r.recipient_address_line_2) for r in grants.closed_grants([one, two], active).collect()] == [("a", "5")]


def test_network(frame):
    rows = [("1", "P1", "x", "X"), ("2", "P2", "x", "X"), ("1", "P1", "y", "Y"), ("2", "P2", "y", "Y"), ("3", "P3", "y", "Y"), ("4", "P4", "z", "Z"), ("5", "P5", None, None)]
    awards = frame([(*r, i) for i, r in enumerate(rows)], "cfda_number string, cfda_title string, recipient_uei string, recipient_name string, o int")
    net = grants.shared_grantees(awards, ["o"])
    assert {(r.src, r.dst): r.weight for r in net["edges"].collect()} == {("P1", "P2"): 2, ("P1", "P3"): 1, ("P2", "P3"): 1}
    assert sorted(r.name for r in net["isolated"].collect()) == ["P4", "P5"]
    assert sorted(r.name for r in net["heavy_nodes"].collect()) == ["P1", "P2"]
    assert net["n_heavy_nodes"].first().n == 2


def test_topics(frame):
    rows = [(str(i), ("staff shortage hiring " if i % 2 else "building repair roof ") * 3 + "it's", f"r{i % 3}") for i in range(30)]
    rows += [("none", "...", "r0"), ("null", None, "r0")]
    df = frame(rows, "pk string, comment string, region string")
    stopwords = frame([("it's",)], "word string")
    found = comments.comment_topics(df, "pk", "comment", ["region"], k=2, seed=1, stopwords=stopwords, rounds=15)
    betas = found["beta"].collect()
    assert {r.term for r in betas} == {"staff", "shortage", "hiring", "building", "repair", "roof"}
    for topic in (1, 2):
        assert sum(r.beta for r in betas if r.topic == topic) == pytest.approx(1)
    sums = found["gamma"].groupBy("pk").agg(F.sum("gamma").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    assert len(sums) == 30 and all(r.s == pytest.approx(1) and r.n == 2 for r in sums)
    # the two kinds of comment are told apart
    top = {r.pk: r.topic for r in found["gamma"].where("gamma > 0.5").collect()}
    assert len({top[str(i)] for i in range(0, 30, 2)}) == len({top[str(i)] for i in range(1, 30, 2)}) == 1 and top["0"] != top["1"]
    assert found["by_region"].count() == 6 and found["map"].columns == ["pk", "1", "2", "comment"]


def brute_scores(cells, k, seed, rounds, alpha, eta):
    """Mean cosine and divergence of one model, by the recurrence in plain arrays."""
    import hashlib

    import numpy as np

    texts, terms = (sorted({c[i] for c in cells}) for i in (0, 1))
    n = np.zeros((len(texts), len(terms)))
    for d, w, c in cells:
        n[texts.index(d), terms.index(w)] = c
    theta = np.full((len(texts), k), 1 / k)
    phi = np.array([[1 + int(hashlib.md5(f"{w}|{t}|{seed}".encode()).hexdigest()[:4], 16) / 65536 for t in range(1, k + 1)] for w in terms])
    phi /= phi.sum(0)
    for _ in range(rounds):
        p = theta[:, None, :] * phi[None]
        x = n[:, :, None] * p / p.sum(2, keepdims=True)
        theta = (x.sum(1) + alpha) / (n.sum(1, keepdims=True) + k * alpha)
        phi = x.sum(0) + eta
        phi /= phi.sum(0)
    cos, div = [], []
    for i in range(k):
        for j in range(i + 1, k):
            a, b = phi[:, i], phi[:, j]
            cos.append(a @ b / np.sqrt((a @ a) * (b @ b)))
            m = (a + b) / 2
            div.append(((a * np.log(a / m)).sum() + (b * np.log(b / m)).sum()) / 2)
    return np.mean(cos), np.mean(div)


def test_sweep_against_brute_force(frame):
    from granary.operators import topics

    cells = [(d, f"w{w}", float((d * w) % 5 + 1)) for d in range(12) for w in range(9) if (d + w) % 3]
    got = topics.tune_k(frame(cells, "pk int, term string, n double"), "pk", range(2, 5), 77, rounds=4).collect()
    assert sorted(r.k for r in got) == [2, 3, 4]
    for r in got:
        want = brute_scores(cells, r.k, 77, 4, topics.ALPHA, topics.ETA)
        assert (r.mean_cosine, r.mean_divergence) == (pytest.approx(want[0]), pytest.approx(want[1]))
