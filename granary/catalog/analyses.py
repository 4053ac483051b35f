"""Whole analyses on stand-in tables."""

from pyspark.sql import functions as F

from granary.catalog.estimates import DESIGN, total_sql, weighted
from granary.catalog.registry import query
from granary.catalog.samples import SEED
from granary.catalog.standins import (
    BY_RISK_SQL,
    SITES_SQL,
    SLOTS,
    WITHIN_SQL,
    polygon_table,
    sites,
)
from granary.catalog.topics import K, TOPICS_SQL, stopword_table
from granary.catalog.topics import SEED as TOPIC_SEED
from granary.functions import paste, row_sum
from granary.operators.sets import union_by_name
from granary.operators.survey import margin_band, moe_shares
from granary.session import cut_lineage, scratch_path
from granary.sources.sinks import write_split
from granary.sources.tables import read_yearly
from granary.plans.case_study import case_study_options, similar_sites
from granary.plans.comments import comment_sample, comment_topics, grant_sample, sample_by_region
from granary.plans.disbursement import (
    award_spans,
    disbursals,
    match_actuals,
    program_trend,
    pull_fields,
)
from granary.plans.enrollment import attach_initiative, tidy_enrollment, type_enrollment
from granary.plans.facility import (
    clean_centers,
    clean_facilities,
    facility_master,
    reconcile_places,
)
from granary.plans.grants import closed_grants, shared_grantees
from granary.plans.population import INCOME_BANDS, banded_dimensions, poverty_estimates
from granary.plans.risk import (
    characteristics,
    federal_interest_by_state,
    focus_states,
    grantee_concentration,
    program_shares,
    state_drilldown,
    state_summary,
)
from granary.plans.sites import add_coordinates, add_tracts, mailing_address, map_export, risk_long
from granary.sources.literals import literal_table

EXTRA = ["NATION_0", "NATION_1", "NATION_2"]


# ---- facilities -------------------------------------------------------------------


def _centers(t):
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    kinds = {"A": "HS", "N": "EHS", "R": "AIAN HS"}
    kind = F.when(F.lit(False), "")
    for flag, name in kinds.items():
        kind = kind.when(F.col("l_returnflag") == flag, name)
    return clean_centers(
        joined.select(
            F.col("o_custkey").cast("string").alias("grant_id"),
            paste(F.lit("Grantee"), "o_custkey").alias("grantee"),
            kind.alias("program_type"),
            F.col("o_orderpriority").alias("program"),
            F.col("l_quantity").cast("int").cast("string").alias("total_slots"),
            F.when(F.col("l_linenumber") > 3, paste(F.lit("Center"), F.col("l_linenumber"))).alias("location_name"),
            paste(F.col("l_suppkey") % 10, F.lit("Main St")).alias("address_line1"),
            F.when(F.col("l_linenumber") == 2, F.lit("Suite B")).alias("address_line2"),
            F.lit("Town").alias("city"),
            F.col("o_orderstatus").alias("state_code"),
            F.lit("00001").alias("zip"),
            F.lit(None).cast("string").alias("zip4"),
            F.concat((F.col("o_custkey") % 10).cast("string"), F.lit(" County County")).alias("county"),
            F.when(F.col("l_linenumber") > 5, F.col("l_partkey").cast("string")).alias("lat"),
            F.when(F.col("l_linenumber") > 5, F.lit("no data")).alias("lon"),
            F.when(F.col("l_linestatus") == "F", "Verified").otherwise("Incomplete").alias("data_grantee_verification_status"),
            F.when(F.col("l_returnflag") == "A", "Yes").when(F.col("l_returnflag") == "N", "No").alias("is_federal_interest_site"),
            F.when(F.col("l_linestatus") == "F", "Yes").otherwise("No").alias("is_owned_by_program"),
            F.lit(None).cast("string").alias("is_child_care_partner_site"),
            F.when(F.col("l_linenumber") == 1, "Yes").when(F.col("l_linenumber") == 2, "No, this center is exempt").alias("state_license_status"),
            F.lit(None).cast("string").alias("state_license_comments"),
            F.when(F.col("l_linenumber") == 1, "No").alias("qris_status"),
            F.when(F.col("l_linenumber") == 7, F.lit("note")).alias("qris_comments"),
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_order"),
        )
    )


def _facilities(t, centers):
    raw = t.orders.select(
        F.col("o_custkey").cast("string").alias("grant_id"),
        paste(F.lit("Grantee"), "o_custkey").alias("grantee"),
        F.lit("HS").alias("program_type"),
        F.col("o_orderpriority").alias("program"),
        F.lit("Office").alias("location_name"),
        paste(F.col("o_orderkey") % 20, F.lit("Main St")).alias("address_line1"),
        F.lit(None).cast("string").alias("address_line2"),
        F.lit("Town").alias("city"),
        F.col("o_orderstatus").alias("state_code"),
        F.lit("00001").alias("zip"),
        F.lit(None).cast("string").alias("zip4"),
        F.concat((F.col("o_custkey") % 10).cast("string"), F.lit(" County")).alias("county"),
        F.lit("Verified").alias("data_grantee_verification_status"),
        F.lit("No").alias("is_federal_interest_site"),
        F.lit("Yes").alias("is_owned_by_program"),
        F.lit(None).cast("string").alias("is_child_care_partner_site"),
        F.col("o_orderkey").alias("row_order"),
    )
    return clean_facilities(raw, centers)


MASTER_SQL = """
with c as (
    select cast(o_custkey as varchar) as grant_id, 'Grantee ' || o_custkey as grantee, o_orderpriority as program,
        case l_returnflag when 'A' then 'hs' when 'N' then 'ehs' else 'aian_hs' end as program_type,
        cast(cast(l_quantity as int) as double) as total_slots,
        case when l_linenumber > 3 then 'Center ' || l_linenumber end as location_name,
        (l_suppkey % 10) || ' Main St' as address_line1,
        case when l_linenumber = 2 then 'Suite B' end as address_line2,
        o_orderstatus as state_code, (o_custkey % 10) || ' County' as county,
        case when l_linenumber > 5 then cast(l_partkey as double) end as lat,
        case when l_linestatus = 'F' then 'Verified' else 'Incomplete' end as status,
        case l_returnflag when 'A' then true when 'N' then false end as fed, l_linestatus = 'F' as owned,
        null::boolean as child,
        case l_linenumber when 1 then 'State-licensed' when 2 then 'Exempt' else 'Unknown' end as license,
        case l_linenumber when 1 then 'Does not participate' else 'Unknown' end as qris,
        case when l_linenumber = 7 then 'note' end as qris_comments, 'center' as location_type,
        0 as src, l_orderkey * 10 + l_linenumber as ord
    from lineitem join orders on l_orderkey = o_orderkey
    union all
    select * from (select cast(o_custkey as varchar), 'Grantee ' || o_custkey, o_orderpriority, 'hs', null::double, 'Office',
        (o_orderkey % 20) || ' Main St', null, o_orderstatus, (o_custkey % 10)::varchar, null::double, 'Verified',
        false, true, true, null, null, null, 'administrative facility', 1, min(o_orderkey) from orders group by all)
),
wide as (
    select grant_id, grantee, program, location_name, address_line1, address_line2, state_code, county, lat, status, fed,
        owned, child, license, qris, qris_comments, location_type, src, min(ord) as ord,
        coalesce(sum(total_slots) filter (program_type = 'aian_hs'), 0) as aian_hs_slots,
        coalesce(sum(total_slots) filter (program_type = 'ehs'), 0) as ehs_slots,
        coalesce(sum(total_slots) filter (program_type = 'hs'), 0) as hs_slots
    from c group by grant_id, grantee, program, location_name, address_line1, address_line2, state_code, county, lat, status, fed,
        owned, child, license, qris, qris_comments, location_type, src
),
sites as (
    select grant_id, grantee, program, address_line1, state_code, county,
        coalesce(string_agg(address_line2, ' ' order by src, ord), '') as address_line2,
        coalesce(string_agg(location_name, ' / ' order by src, ord), '') as location_name,
        coalesce(string_agg(location_type, ' & ' order by src, ord), '') as location_type,
        'Town' as city, '00001' as zip, null::varchar as zip4, null::double as lon, '' as state_license_comments,
        max(lat) as lat, min(status) as data_grantee_verification_status, bool_or(fed) as is_federal_interest_site,
        bool_or(owned) as is_owned_by_program, bool_or(child) as is_child_care_partner_site,
        coalesce(string_agg(license, '' order by src, ord), '') as state_license_status,
        coalesce(string_agg(qris, '' order by src, ord), '') as qris_status,
        coalesce(string_agg(qris_comments, '' order by src, ord), '') as qris_comments,
        sum(aian_hs_slots) as aian_hs_slots, sum(ehs_slots) as ehs_slots, sum(hs_slots) as hs_slots
    from wide group by 1, 2, 3, 4, 5, 6
)
select *, grant_id || '-' || row_number() over
        (partition by grant_id order by grantee, program, address_line1, state_code, county) as location_id,
    aian_hs_slots + ehs_slots + hs_slots as total_slots
from sites
"""


@query("pip_facility_master", MASTER_SQL)
def pip_facility_master(t):
    centers = _centers(t)
    return facility_master(centers, _facilities(t, centers), ["aian_hs", "ehs", "hs"])


@query(
    "pip_place_reconcile",
    """
    with s as (
        select p_partkey, 'Place ' || (p_partkey % 50) || case p_type when 'ECONOMY' then ' city' when 'SMALL' then ' Parish'
               when 'LARGE' then ' Borough' when 'PROMO' then ' Island' else '' end as county, p_brand as state_code from part),
    known as (select 'Place ' || l_linenumber as county, p_brand as state_code from lineitem join part on l_partkey = p_partkey
              where l_quantity < 3),
    marked as (select *, state_code in (select state_code from known)
               and (county, state_code) not in (select county, state_code from known) as gap from s)
    select p_partkey, state_code,
        case when not gap then 'County' when contains(county, ' city') then 'City' when contains(county, ' Parish') then 'Parish'
             when contains(county, ' Borough') then 'Borough' when contains(county, ' Island') then 'Island' end as county_type,
        case when gap then regexp_replace(county, ' (city|Parish|Borough|Island)', '') else county end as county,
        case when gap then regexp_replace(county, ' (city|Parish|Borough|Island)', '') else county end || '-' || state_code as county_state_code
    from marked
    """,
)
def pip_place_reconcile(t):
    suffix = F.when(F.col("p_type") == "ECONOMY", " city").when(F.col("p_type") == "SMALL", " Parish")
    suffix = suffix.when(F.col("p_type") == "LARGE", " Borough").when(F.col("p_type") == "PROMO", " Island").otherwise("")
    place = F.concat(F.lit("Place "), (F.col("p_partkey") % 50).cast("string"), suffix)
    places = t.part.select("p_partkey", place.alias("county"), F.col("p_brand").alias("state_code"))
    known = (
        t.lineitem.where("l_quantity < 3")
        .join(t.part, F.col("l_partkey") == F.col("p_partkey"))
        .select(F.concat(F.lit("Place "), "l_linenumber").alias("county"), F.col("p_brand").alias("state_code"))
    )
    return reconcile_places(places, known)


# ---- sites and risk ---------------------------------------------------------------


@query(
    "pip_site_enrich",
    f"""
    with {WITHIN_SQL},
    a as (select o_orderkey, c_name || ', ' || c_mktsegment || ', ' || n_name || ' ' || o_orderpriority as address, n_name as state_code,
          o_custkey, lon, lat, o_totalprice, o_orderstatus, c_mktsegment in ('BUILDING', 'MACHINERY') as in_osm,
          c_mktsegment = 'FURNITURE' as in_arcgis from orders join customer on o_custkey = c_custkey
          join nation on c_nationkey = n_nationkey join points using (o_orderkey, o_custkey)),
    own as (select *, o_totalprice >= 50000 as has_own, bool_or(o_totalprice < 50000) over (partition by address) as is_asked from a),
    fixed as (
        select o_orderkey, o_orderstatus, state_code, address, has_own, case when has_own then 'hses' when in_osm then 'osm' when in_arcgis then 'arcgis' end as geocode_source,
            case when is_asked and in_osm then 'child care' else 'unknown' end as building_type,
            case when has_own then lon when in_osm then 50.5e0 + o_custkey % 7 when in_arcgis then 10.5e0 end as lon,
            case when has_own then lat when in_osm then 80.5e0 when in_arcgis then 60.5e0 end as lat
        from own),
    hits2 as (
        select o_orderkey, tract_fips from fixed, sides
        where (y1 > lat) <> (y2 > lat) and lon < x1 + (lat - y1) * (x2 - x1) / (y2 - y1)
        group by o_orderkey, tract_fips having count(*) % 2 = 1),
    placed as (select f.*, tract_fips from fixed f left join hits2 h on f.o_orderkey = h.o_orderkey),
    repaired as (
        select * exclude (tract_fips), coalesce(tract_fips, case when o_orderstatus = 'F' then 'NATION_3' end) as tract_fips from placed)
    select cast(o_orderkey as varchar) as location_id, state_code, geocode_source, building_type, tract_fips,
        'N' || n_nationkey as nia_id, case when n_nationkey is not null then 'Very High' end as hrcn_riskr
    from repaired left join nation on tract_fips = n_name
    """,
)
def pip_site_enrich(t):
    own = F.col("o_totalprice") >= 50000
    located = (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderkey").cast("string").alias("location_id"),
            F.col("c_name").alias("address_line1"),
            F.col("c_mktsegment").alias("city"),
            F.col("n_name").alias("state_code"),
            F.col("o_orderpriority").alias("zip"),
            F.when(own, F.col("o_totalprice") / 1000).alias("lon"),
            F.when(own, F.dayofyear("o_orderdate").cast("double")).alias("lat"),
        )
    )

    # address tables as two geocoding services would return them
    def answers(segments, lon, lat, kind):
        addressed = (
            t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .where(F.col("c_mktsegment").isin(segments))
        )
        named = addressed.withColumnsRenamed(
            {"c_name": "address_line1", "c_mktsegment": "city", "n_name": "state_code", "o_orderpriority": "zip"}
        )
        return named.select(
            mailing_address().alias("address"), lat.alias("lat"), lon.alias("lon"), F.lit(kind).alias("building_type")
        ).distinct()

    sources = [
        ("osm", answers(["BUILDING", "MACHINERY"], F.col("o_custkey") % 7 + 50.5, F.lit(80.5), "child_care")),
        ("arcgis", answers(["FURNITURE"], F.lit(10.5), F.lit(60.5), "yes")),
    ]
    placed = add_coordinates(located, sources)
    fallback = t.orders.where("o_orderstatus = 'F'").select(
        F.col("o_orderkey").cast("string").alias("location_id"), F.lit("NATION_3").alias("tract_fips")
    )
    high = F.lit("Very High")
    hazards = t.nation.select(
        F.col("n_name").alias("tract_fips"),
        F.concat(F.lit("N"), "n_nationkey").alias("nia_id"),
        *[high.alias(c) for c in ("risk_ratng", "hrcn_riskr", "trnd_riskr", "wfir_riskr")],
    )
    done = add_tracts(placed, polygon_table(t), fallback, hazards)
    return done.select(
        "location_id", "state_code", "geocode_source", "building_type", "tract_fips", "nia_id", "hrcn_riskr"
    )


@query(
    "pip_risk_long",
    f"""
    with {BY_RISK_SQL}
    select location_id, risk_type, risk_rating, list_position(['Overall', 'Hurricane', 'Tornado', 'Wildfire'], risk_type) as risk_type_level,
        list_position(['Very High', 'Relatively High', 'Relatively Moderate', 'Relatively Low', 'Very Low', 'Not Applicable',
                       'Insufficient Data'], risk_rating) as risk_rating_level
    from by_risk
    """,
)
def pip_risk_long(t):
    long = risk_long(sites(t))
    return long.select("location_id", "risk_type", "risk_rating", "risk_type_level", "risk_rating_level")


@query(
    "pip_map_export",
    f"""
    with {SITES_SQL},
    long as (
        select *, 'aian_hs' as program_type, aian_hs_slots as program_slots, 1 as dummy_filter from sites
        union all select *, 'ehs', ehs_slots, 2 from sites
        union all select *, 'hs', hs_slots, 3 from sites
        union all select *, 'migrant_hs', migrant_hs_slots, 4 from sites
    )
    select location_id, state_code, case when is_federal_interest_site then 'Yes' else 'No' end as is_federal_interest_site,
        case when is_owned_by_program then 'Yes' else 'No' end as is_owned_by_program,
        case when is_child_care_partner_site then 'Yes' else 'No' end as is_child_care_partner_site,
        risk_ratng, hrcn_riskr, trnd_riskr, wfir_riskr, program_type, program_slots, dummy_filter
    from long
    """,
)
def pip_map_export(t):
    return map_export(sites(t), ["location_id", "state_code"])


@query(
    "pip_risk_concentration",
    f"""
    with {BY_RISK_SQL},
    top as (
        select state_code from (
            select risk_type, state_code, row_number() over (partition by risk_type order by count(*) desc, state_code) as r
            from at_risk where is_federal_interest_site group by 1, 2) where r <= 5
        union select unnest({EXTRA})
    ),
    c as (
        select state_code, grantee, count(distinct location_id) as n_locations_per_grantee from at_risk
        where is_federal_interest_site and state_code in (select state_code from top) group by 1, 2
    )
    select * exclude (r) from (
        select *, row_number() over (partition by state_code order by n_locations_per_grantee desc, grantee) as r from c)
    where r <= 10
    """,
)
def pip_risk_concentration(t):
    by_risk = risk_long(sites(t))
    return grantee_concentration(by_risk, focus_states(by_risk, 5, EXTRA), 10)


@query(
    "pip_baseline",
    f"""
    with {SITES_SQL},
    shares as (
        select 'Federal Interest' as program, avg(cast(is_federal_interest_site as int)) as pct from sites
        union all select 'Program-Owned', avg(cast(is_owned_by_program as int)) from sites
        union all select 'Child Care Partner', avg(cast(is_child_care_partner_site as int)) from sites
        union all select 'AIAN Head Start', avg(cast(aian_hs_slots > 0 as int)) from sites
        union all select 'Early Head Start', avg(cast(ehs_slots > 0 as int)) from sites
        union all select 'Head Start', avg(cast(hs_slots > 0 as int)) from sites
        union all select 'Migrant Head Start', avg(cast(migrant_hs_slots > 0 as int)) from sites
        union all select state_code, avg(cast(is_federal_interest_site as int)) from sites group by 1
    )
    select program, round(pct, 9) as pct_locations from shares
    """,
)
def pip_baseline(t):
    table = sites(t)
    flags = characteristics(table).select("program", "pct_locations")
    programs = program_shares(table).select("program", "pct_locations")
    states = federal_interest_by_state(table).select(
        F.col("state_code").alias("program"), F.col("pct_federal_interest").alias("pct_locations")
    )
    return union_by_name(flags, programs, states).withColumn("pct_locations", F.round("pct_locations", 9))


@query(
    "pip_case_study",
    f"""
    with {SITES_SQL},
    banded as (
        select *, greatest(pct_poverty_middle - pct_poverty_moe, 0) as low,
               case when pct_poverty_middle <> 0 then pct_poverty_moe / pct_poverty_middle end as rel
        from sites where is_federal_interest_site
        and (hrcn_riskr = 'Very High' or trnd_riskr = 'Very High' or wfir_riskr = 'Very High')
    ),
    long as (
        select *, 'aian_hs' as program_type, aian_hs_slots as slots from banded
        union all select *, 'ehs', ehs_slots from banded
        union all select *, 'hs', hs_slots from banded
        union all select *, 'migrant_hs', migrant_hs_slots from banded
    ),
    p as (select program_type, quantile_cont(low, 0.75) as p75 from long where slots > 0 group by 1),
    q as (select l.program_type, quantile_cont(rel, 0.25) as p25 from long l join p using (program_type)
          where slots > 0 and low > p75 group by 1)
    select location_id, program_type, slots as program_slots, area_type, round(low, 9) as pct_poverty_low, round(rel, 9) as pct_poverty_moe_relative
    from long join p using (program_type) join q using (program_type)
    where slots > 0 and low >= p75 and rel <= p25
    """,
)
def pip_case_study(t):
    band = margin_band("pct_poverty_middle", "pct_poverty_moe")
    table = sites(t).withColumns({"pct_poverty_low": band["low"], "pct_poverty_moe_relative": band["relative"]})
    options = case_study_options(table)
    return options.select(
        "location_id",
        "program_type",
        "program_slots",
        "area_type",
        F.round("pct_poverty_low", 9).alias("pct_poverty_low"),
        F.round("pct_poverty_moe_relative", 9).alias("pct_poverty_moe_relative"),
    )


@query(
    "pip_similar_sites",
    f"""
    with {BY_RISK_SQL}
    select case risk_type when 'Hurricane' then 'hrcn' when 'Tornado' then 'trnd' else 'wfir' end as risk_type, area_type,
        count(distinct location_id) as n_locations, count(distinct state_code) as n_states, round(median(pct_poverty_middle), 9) as median_pov
    from at_risk where risk_type <> 'Overall' group by 1, 2
    """,
)
def pip_similar_sites(t):
    return similar_sites(sites(t)).withColumn("median_pov", F.round("median_pov", 9))


DRILL_STATES = ["NATION_3", "NATION_4", "NATION_9"]


def _drill_sql(flag: str, where: str, label: str) -> str:
    sums = ", ".join(f"sum({c} * {flag}) as {c}" for c in [*SLOTS, "total_slots"])
    return f"""
    select state_code, {label} as risk_type, cast(sum({flag}) as double) as total,
        cast(sum(cast(is_federal_interest_site as int) * {flag}) as double) as with_federal_interest,
        cast(sum(cast(is_owned_by_program as int) * {flag}) as double) as owned,
        count(distinct case when {flag} = 1 then grantee end) as grantees,
        count(distinct case when {flag} = 1 then grant_id end) as grants,
        {sums}, cast(sum(cast(is_child_care_partner_site as int) * {flag}) as double) as child_care_partner
    from (select *, {' + '.join(SLOTS)} as total_slots,
          cast(risk_rating in ('Very High', 'Relatively High', 'Relatively Moderate') as int) as risky, 1 as every from by_risk)
    where {where} and state_code in ('{"', '".join(DRILL_STATES)}') group by 1, 2
    """


def _slotted(t):
    return sites(t).withColumn("total_slots", row_sum(SLOTS))


@query(
    "pip_drilldown",
    f"""
    with {BY_RISK_SQL}
    {_drill_sql("every", "risk_type = 'Overall'", "risk_type")}
    union all
    {_drill_sql("risky", "risk_type <> 'Overall'", "'At-risk for ' || risk_type")}
    """,
)
def pip_drilldown(t):
    by_risk = risk_long(_slotted(t)).drop("risk_type_level", "risk_rating_level")
    return state_drilldown(by_risk, DRILL_STATES)


@query(
    "pip_state_summary",
    f"""
    with {SITES_SQL},
    s as (
        select state_code, count(distinct grant_id) as n_grants, count(distinct grantee) as n_grantees, count(*) as n_locations,
            cast(sum(cast(is_federal_interest_site as int)) as bigint) as n_federal_interest,
            cast(sum(cast(is_owned_by_program as int)) as bigint) as n_owned,
            cast(sum(cast(is_child_care_partner_site as int)) as bigint) as n_child_care,
            {", ".join(f"sum({c}) as n_{c}" for c in SLOTS)}, sum({" + ".join(SLOTS)}) as n_total_slots
        from sites where state_code in ('{"', '".join(DRILL_STATES)}') group by 1
    )
    select * from s union all select 'Total', cast(sum(n_grants) as bigint), cast(sum(n_grantees) as bigint),
        cast(sum(n_locations) as bigint), cast(sum(n_federal_interest) as bigint), cast(sum(n_owned) as bigint),
        cast(sum(n_child_care) as bigint), {", ".join(f"sum(n_{c})" for c in [*SLOTS, "total_slots"])} from s
    """,
)
def pip_state_summary(t):
    return state_summary(_slotted(t), DRILL_STATES)


# ---- enrollment and comments ------------------------------------------------------

MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def _enrollment_sheet(t):
    """Customers as grants, one column per month, program and metric."""
    status = F.when(F.col("o_orderstatus") == "F", "HS").otherwise("EHS")
    plan = [(m, p, k) for m in range(12) for p in ("HS", "EHS") for k in ("HSES Funded", "Reported", "Operational")]
    names = [f"x{i + 1}" for i in range(len(plan))]
    cells = []
    for name, (month, program, metric) in zip(names, plan):
        here = (F.month("o_orderdate") == month + 1) & (status == program)
        n = F.nullif(F.count_if(here), F.lit(0))
        urgent = F.count_if(here & (F.col("o_orderpriority") < "3"))
        value = {
            "HSES Funded": n.cast("string"),
            "Reported": F.when(n.isNotNull(), urgent).cast("string"),
            "Operational": F.when(n > 1, "yes").when(n == 1, "no"),
        }[metric]
        cells.append(value.alias(name))
    grants = t.orders.groupBy("o_custkey").agg(*cells).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    key = F.col("o_custkey")
    acronym = F.get(F.array(*[F.lit(a) for a in ("CH", "CI", "HP", "HI")]), (key % 5).cast("int"))
    body = grants.select(
        F.lit(4).alias("row"),
        key.cast("string").alias("grant_number"),
        (F.col("c_nationkey") % 14).cast("string").alias("region"),
        acronym.alias("program_acronym"),
        *names,
    )
    header = []
    for level in range(3):
        texts, before = [], None
        for month, program, metric in plan:
            text = [f"{MONTHS[month]} 2022", f"{month}{program}", metric][level]
            shown = [f"{MONTHS[month]} 2022", program, metric][level]
            texts.append(shown if level == 2 or text != before else None)
            before = text
        header.append((level + 1, None, None, None, *texts))
    schema = [("row", "int"), *[(c, "string") for c in ("grant_number", "region", "program_acronym")]]
    top = literal_table(t.spark, header, [*schema, *[(n, "string") for n in names]])
    return top.unionByName(body), names


@query(
    "pip_enrollment",
    """
    with funded as (
        select o_custkey, month(o_orderdate) as m, case when o_orderstatus = 'F' then 'HS' else 'EHS' end as program,
               count(*) as n, count(*) filter (o_orderpriority < '3') as urgent from orders group by 1, 2, 3
    ),
    e as (
        select cast(o_custkey as varchar) as grant_id, c_custkey, cast(c_nationkey % 14 as varchar) as region,
            list_extract(['CH', 'CI', 'HP', 'HI'], cast(1 + o_custkey % 5 as int)) as program_acronym,
            make_date(2022, m, 1) as report_month, program, cast(n as double) as slots_funded,
            cast(urgent as double) as slots_reported, n > 1 as operational, c_acctbal, c_mktsegment
        from funded join customer on o_custkey = c_custkey where c_nationkey % 14 <> 13
    ),
    f as (
        select *, c_acctbal > 5000 as member,
            case when c_acctbal > 5000 and c_mktsegment in ('BUILDING', 'MACHINERY') then date '2021-06-01' + cast(c_custkey % 900 as int)
                 when c_acctbal > 5000 and c_mktsegment = 'FURNITURE' then date '2022-03-31' end as started
        from e
    )
    select grant_id, region, program_acronym, report_month, program, slots_funded, slots_reported, operational,
        case program_acronym when 'CH' then 'Region 01 – 10' when 'CI' then 'Region 11 American Indian and Alaska Native (AIAN)'
            when 'HP' then 'Region 01 – 10 EHS-CCP' when 'HI' then 'Region 11 American Indian and Alaska Native (AIAN) EHS-CCP' end as grant_type,
        case when program_acronym in ('CI', 'HI') then 'AIAN' else 'Base' end as program_detail,
        case when member then 'status ' || c_mktsegment end as fei_status, cast(started as date) as fei_effective_date,
        report_month >= started and report_month < started + interval 12 month as is_report_month_during_fei,
        case when not member then false when started < date '2023-01-01' then false else true end as is_fei,
        cast(row_number() over (order by grant_id, report_month, program) as varchar) as pk
    from f
    """,
)
def pip_enrollment(t):
    sheet, names = _enrollment_sheet(t)
    tidy = tidy_enrollment(
        sheet, "row", ["grant_number", "region", "program_acronym"], names, ["HSES Funded", "Reported", "Operational"]
    )
    tidy = tidy.withColumnsRenamed({"HSES Funded": "hses_funded", "Reported": "reported", "Operational": "operational"})
    enrollment = type_enrollment(tidy)
    started = F.expr("date_add(date '2021-06-01', cast(c_custkey % 900 as int))")
    two = F.col("c_mktsegment").isin("BUILDING", "MACHINERY")
    status = F.concat(F.lit("status "), "c_mktsegment")
    initiative = t.customer.where("c_acctbal > 5000").select(
        F.col("c_custkey").cast("string").alias("grant_id"),
        F.when(two, status).alias("fei_status_hs"),
        F.when(two, started).alias("fei_effective_date_hs"),
        status.alias("fei_status_ehs"),
        F.when(F.col("c_mktsegment") == "FURNITURE", F.lit("2022-03-31").cast("date")).alias("fei_effective_date_ehs"),
    )
    return attach_initiative(enrollment, initiative, ["grant_id", "report_month", "program"])


@query(
    "pip_topics",
    f"""with {TOPICS_SQL},
    g as (select lang as grp, t, w from documents join theta using (doc_id)
          union all select cast(n_chars > 1000 as varchar), t, w from documents join theta using (doc_id))
    select grp, cast(t as int) as topic, round(avg(w), 6) as avg_gamma from g where grp is not null group by 1, 2""",
)
def pip_topics(t):
    comments = t.documents.withColumn("is_long", F.col("n_chars") > 1000)
    found = comment_topics(comments, "doc_id", "text", ["lang", "is_long"], K, TOPIC_SEED, stopword_table(t))
    by_lang = found["by_lang"].withColumnRenamed("lang", "grp")
    by_size = found["by_is_long"].select(F.col("is_long").cast("string").alias("grp"), "topic", "avg_gamma")
    return union_by_name(by_lang, by_size).withColumn("avg_gamma", F.round("avg_gamma", 6))


SAMPLE_SQL = f"""
    g as (select cast(c_custkey as varchar) as grant_id, cast(c_nationkey as varchar) as region from customer
          where cast(c_nationkey as varchar) not in ('Totals', '12', '13')),
    sizes as (select region, cast(ceil(count(*) / sum(count(*)) over () * 400) as bigint) as n_sample from g group by 1),
    drawn as (select grant_id, region from (
        select grant_id, g.region, n_sample, row_number() over (partition by g.region order by md5(grant_id || '|{SEED}'), grant_id) as r
        from g join sizes s on g.region = s.region) where r <= n_sample),
    comments as (
        select region, grant_id, cast(date_trunc('month', o_orderdate) as date) as report_month, o_orderkey
        from orders join drawn on cast(o_custkey as varchar) = grant_id where o_totalprice / 250000 < 1)
"""


def _comment_sample(t):
    grants = t.customer.select(F.col("c_custkey").cast("string").alias("grant_id"), F.col("c_nationkey").cast("string").alias("region"))
    comments = t.orders.select(
        "o_orderkey",
        F.col("o_custkey").cast("string").alias("grant_id"),
        F.trunc("o_orderdate", "month").alias("report_month"),
        (F.col("o_totalprice") / 250000).alias("slots_pct_reported_over_funded"),
    )
    return comment_sample(comments, grant_sample(grants)).select("region", "grant_id", "report_month", "o_orderkey")


@query("pip_sample", f"with {SAMPLE_SQL} select * from comments order by region, grant_id, report_month")
def pip_sample(t):
    return _comment_sample(t)


@query("pip_sample_regions", f"with {SAMPLE_SQL} select region, count(*) as n, count(*) / sum(count(*)) over () as pct from comments group by region")
def pip_sample_regions(t):
    return sample_by_region(_comment_sample(t))


# ---- population -------------------------------------------------------------------


def _income_sql(column: str) -> str:
    branches = " ".join(f"when {column} {op} {bound} then '{label}'" for op, bound, label in INCOME_BANDS)
    return f"case {branches} else 'None or Unreported' end"


@query(
    "pip_survey",
    f"""
    with est as (
        {total_sql("l_suppkey, l_linenumber, is_poor",
                   "(select *, cast(floor(l_extendedprice) as bigint) % 500 <= 100 as is_poor from lineitem)", "population_estimate")}
    )
    select l_suppkey, l_linenumber, is_poor as household_income_less_than_100pct_poverty, population_estimate, n,
        round(population_estimate_se * 1.645e0, 4) as population_estimate_moe,
        (select round(avg(cast(population_estimate_se * 1.645e0 / population_estimate > 0.02e0 as int)), 9) from est) as share_over
    from est
    """,
)
def pip_survey(t):
    people = weighted(t).withColumn("poverty", F.floor("l_extendedprice") % 500)
    # group-sized; written because two results are made of it
    estimates = cut_lineage(poverty_estimates(people, DESIGN, ["l_suppkey", "l_linenumber"]))
    share = moe_shares(estimates, "population_estimate_moe_rel", {"share_over": 0.02})
    return estimates.select(
        "l_suppkey",
        "l_linenumber",
        "household_income_less_than_100pct_poverty",
        "population_estimate",
        "n",
        F.round("population_estimate_moe", 4).alias("population_estimate_moe"),
        F.round(share.scalar(), 9).alias("share_over"),
    )


@query(
    "pip_dimensions",
    f"""
    with p as (
        select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_tax > 0 then floor(l_extendedprice * 3) end as hhincome,
            50000 + l_suppkey as smi4, l_linenumber % 4 as hispan, l_linenumber as race, l_partkey % 700 as raced,
            cast(floor(l_quantity * 12) as int) as poverty, nullif(l_quantity, 1) as age_1, l_partkey % 40 as age_2,
            l_partkey % 120 as educd_1, l_suppkey % 110 as educd_2, l_linenumber % 3 as empstat_1, l_partkey % 3 as empstat_2
        from lineitem),
    s as (select *, case when hhincome > 0 then hhincome / smi4 else 0 end as pct,
        cast(coalesce(age_1 < 18, false) as int) + cast(age_2 < 18 as int) as young,
        cast(educd_1 > 100 as int) + cast(educd_2 > 100 as int) as college,
        cast(educd_1 > 61 as int) + cast(educd_2 > 61 as int) as school,
        cast(empstat_1 = 1 as int) + cast(empstat_2 = 1 as int) as jobs from p)
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, {_income_sql("hhincome")} as household_income,
        case when pct > 5 then '500% or Greater' when pct > 4 then '400% to 499%' when pct > 3 then '300% to 399%'
             when pct > 2 then '200% to 299%' when pct > 1.49 then '150% to 199%' when pct > 1 then '100% to 149%'
             when pct > 0.5 then '50% to 99%' when pct > 0.25 then '25% to 49%' when pct > 0 then '0% to 24%' else '0% OF SMI' end
             as household_income_as_percent_of_state_median_income,
        case when hispan = 0 then 'Not Hispanic or Latino' else 'Hispanic or Latino' end as child_ethnicity,
        case when race = 1 then 'White, including Middle Eastern or North African' when race = 2 then 'Black or African American'
             when race = 3 then 'American Indian or Alaska Native' when race = 7 then 'Other Race'
             when raced between 400 and 620 or raced between 640 and 643 or raced between 660 and 679 then 'Asian'
             when raced between 630 and 634 or raced between 680 and 699 then 'Native Hawaiian or Other Pacific Islander' end as child_race,
        case when poverty < 500 then case when poverty < 50 then 'Less than 50%' else
             (poverty // 50 * 50) || '% to ' || (poverty // 50 * 50 + 49) || '%' end else '500% or Greater' end
             as household_income_as_percentage_of_poverty_line,
        case young when 0 then 'Both Parents Over 18' when 1 then 'One Parent Under 18' else 'Both Parents Under 18' end as parents_age,
        case when college > 1 then 'Bachelors or Greater: Both Parents' when college = 1 then 'Bachelors or Greater: One Parent'
             when school > 1 then 'High School Diploma or GED: Both Parents' when school = 1 then 'High School Diploma or GED: One Parent'
             else 'No High School or Higher Education Degree: Both Parents' end as parents_education,
        case jobs when 0 then 'Both Parents Unemployed or Not in Labor Force' when 1 then 'One Parent Employed'
             else 'Both Parents Employed' end as parents_employment
    from s
    """,
)
def pip_dimensions(t):
    people = t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.when(F.col("l_tax") > 0, F.floor(F.col("l_extendedprice") * 3)).alias("hhincome"),
        (F.col("l_suppkey") + 50000).alias("smi4"),
        (F.col("l_linenumber") % 4).alias("hispan"),
        F.col("l_linenumber").alias("race"),
        (F.col("l_partkey") % 700).alias("raced"),
        F.floor(F.col("l_quantity") * 12).alias("poverty"),
        F.nullif("l_quantity", F.lit(1.0)).alias("age_1"),
        (F.col("l_partkey") % 40).alias("age_2"),
        (F.col("l_partkey") % 120).alias("educd_1"),
        (F.col("l_suppkey") % 110).alias("educd_2"),
        (F.col("l_linenumber") % 3).alias("empstat_1"),
        (F.col("l_partkey") % 3).alias("empstat_2"),
    )
    return banded_dimensions(people).select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "household_income",
        "household_income_as_percent_of_state_median_income",
        "child_ethnicity",
        "child_race",
        "household_income_as_percentage_of_poverty_line",
        "parents_age",
        "parents_education",
        "parents_employment",
    )


# ---- disbursements ----------------------------------------------------------------


def _decision_sheets(t):
    """Two yearly sheets whose column names drift, awards being orders."""
    key, price = F.col("o_orderkey"), F.floor("o_totalprice")
    fields = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    early, late = F.year("o_orderdate") < 1998, F.year("o_orderdate") >= 1998
    grantee = F.nullif("c_name", F.lit("Customer#000000007"))
    amounts = [(price % (n + 2) * 100) for n in range(1, 4)]
    requested = [(price % (n + 5) * 50) for n in range(1, 4)]
    sheet = F.concat("o_orderpriority", F.lit(" FY"))
    a = fields.where(early).select(
        sheet.alias("grant"),
        F.lit(2022).alias("fy_approved"),
        key.alias("Application Number"),
        (key * 2).alias("Panel Number"),
        grantee.alias("Name"),
        F.when(F.col("o_orderstatus") == "F", "F").when(F.col("o_orderstatus") == "O", "NF").alias("Funding"),
        *[a.alias(f"Approved Amount Y{i + 1}") for i, a in enumerate(amounts)],
        *[r.cast("string").alias(f"Amount Requested Year {i + 1}") for i, r in enumerate(requested)],
    )
    b = fields.where(late).select(
        sheet.alias("grant"),
        F.lit(2023).alias("fy_approved"),
        key.cast("string").alias("Number"),
        F.concat(F.lit("90NA"), key).alias("Grant Number"),
        grantee.alias("Name"),
        F.lit(None).cast("string").alias("Fund Decision"),
        *[a.alias(f"Approved Amount Total Y{i + 1}") for i, a in enumerate(amounts)],
        *[F.when(r > 0, r.cast("string")).otherwise("no data").alias(f"Amount Requested {i + 1}") for i, r in enumerate(requested)],
    )
    return a, b


AWARDS_SQL = """
    raw as (
        select cast(o_orderkey as varchar) as application_id, lower(nullif(c_name, 'Customer#000000007')) as grantee,
            case when year(o_orderdate) < 1998 then 2022 else 2023 end as fy_approved,
            case when year(o_orderdate) < 1998 and o_orderstatus = 'F' then 'F' end as decision,
            regexp_extract(o_orderpriority, '[\\p{L}&-]+') as grant, cast(floor(o_totalprice) as bigint) as p
        from orders join customer on o_custkey = c_custkey
    ),
    awards as (select * from raw where grantee is not null and (decision = 'F' or p % 3 <> 0)),
    d as (
        select grant, 'development' as grant_type, application_id, grantee, n as yr_n, fy_approved, fy_approved + n - 1 as fy_disbursed,
            case when fy_approved = 2023 and n > 1 then coalesce(nullif(p % (n + 2) * 100, 0), nullif(p % (n + 5) * 50, 0))
                 else nullif(p % (n + 2) * 100, 0) end::double as amt_app
        from awards, (values (1), (2), (3)) as v(n)
    ),
    disbursals as (select * from d where amt_app is not null)
"""


def _disbursals(t):
    return disbursals(union_by_name(*[pull_fields(s) for s in _decision_sheets(t)]))


@query(
    "pip_disbursement",
    f"with {AWARDS_SQL} select * from disbursals",
)
def pip_disbursement(t):
    return _disbursals(t)


@query(
    "pip_award_spans",
    f"""
    with {AWARDS_SQL}
    select grant, application_id, fy_approved, cast(count(*) as int) as duration_yrs, sum(amt_app) as amt_total,
        fy_approved + cast(count(*) as int) - 1 as fy_end from disbursals group by grant, application_id, fy_approved
    """,
)
def pip_award_spans(t):
    spans = award_spans(_disbursals(t))
    return spans.select("grant", "application_id", "fy_approved", "duration_yrs", "amt_total", "fy_end")


@query(
    "pip_program_trend",
    f"with {AWARDS_SQL} select fy_approved, grant, count(distinct application_id) as n, sum(amt_app) as amt_approved from disbursals group by 1, 2",
)
def pip_program_trend(t):
    return program_trend(_disbursals(t))


@query(
    "pip_reconcile",
    """
    with m as (select cast(s_suppkey as varchar) as application_id, regexp_replace(s_name, '^Supplier#0*', 'tribe ') as a,
               cast(s_nationkey as varchar) as grant, floor(s_acctbal) as amt_app from supplier),
    r as (select cast(c_custkey as varchar) as grant_number, regexp_replace(c_name, '^Customer#0*', 'tribe ') as b,
          cast(c_nationkey as varchar) as grant, floor(c_acctbal) as revised from customer),
    best as (
        select application_id, grant_number, sim, revised from (
            select *, row_number() over (partition by application_id order by sim desc, b, grant_number) as k from (
                select application_id, grant_number, b, revised, 1 - levenshtein(a, b) / greatest(length(a), length(b)) as sim
                from m join r on m.grant = r.grant or m.grant not in (select r.grant from r))) where k = 1)
    select m.application_id, m.grant, m.amt_app, grant_number, case when sim >= 0.75 then revised else 0 end as revised_amount,
        case when sim >= 0.75 then revised else 0 end - m.amt_app as difference, round(sim, 9) as similarity,
        coalesce(sim < 0.75, true) as is_weak, revised as revised_amount_raw
    from m left join best using (application_id)
    """,
)
def pip_reconcile(t):
    rows = t.supplier.select(
        F.col("s_suppkey").cast("string").alias("application_id"),
        F.regexp_replace("s_name", "^Supplier#0*", "tribe ").alias("grantee"),
        F.col("s_nationkey").cast("string").alias("grant"),
        F.floor("s_acctbal").cast("double").alias("amt_app"),
    )
    actual = t.customer.select(
        F.col("c_custkey").cast("string").alias("grant_number"),
        F.regexp_replace("c_name", "^Customer#0*", "tribe ").alias("grantee"),
        F.col("c_nationkey").cast("string").alias("grant"),
        F.floor("c_acctbal").cast("double").alias("revised_amount"),
    )
    matched = match_actuals(rows, actual)
    return matched.select(
        "application_id", "grant", "amt_app", "grant_number", "revised_amount", "difference",
        F.round("similarity", 9).alias("similarity"), "is_weak", "revised_amount_raw",
    )


# ---- grants and network -----------------------------------------------------------


@query(
    "pip_closed_grants",
    """
    select o_orderkey as award_id_fain, year(o_orderdate) as fy, o_orderpriority as business_types_description,
        cast(o_custkey as varchar) as recipient_address_line_2
    from orders
    where year(o_orderdate) between 1995 and 2000 and o_orderstatus = 'F' and o_orderdate <= date '1999-09-30'
    and o_orderpriority in ('1-URGENT', '2-HIGH') and o_orderkey not in (select l_orderkey from lineitem where l_quantity > 48)
    """,
)
def pip_closed_grants(t):
    path = scratch_path(t.spark, "awards_by_year")
    awards = t.orders.select(
        F.col("o_orderkey").alias("award_id_fain"),
        F.year("o_orderdate").alias("fy"),
        F.col("o_orderstatus").alias("awarding_sub_agency_code"),
        F.to_date("o_orderdate").alias("period_of_performance_current_end_date"),
        F.col("o_orderpriority").alias("business_types_description"),
        F.col("o_custkey").alias("recipient_address_line_2"),
    )
    write_split(awards, path, "fy")
    active = t.lineitem.where("l_quantity > 48").select(F.col("l_orderkey").alias("award_id_fain"))
    closed = closed_grants(read_yearly(t.spark, path, "fy", range(1995, 2001)), active, "F", "1999-09-30", ["1-URGENT", "2-HIGH"])
    return closed.select("award_id_fain", "fy", "business_types_description", "recipient_address_line_2")


@query(
    "pip_network",
    """
    with pairs as (select distinct s_name as item, p_name || ' ' || p_brand as via from lineitem
                   join supplier on l_suppkey = s_suppkey join part on l_partkey = p_partkey),
    edges as (select a.item as src, b.item as dst, count(*) as weight from pairs a join pairs b
              on a.via = b.via and a.item < b.item group by 1, 2),
    heavy as (select * from edges where weight >= (select quantile_cont(weight::double, 0.95) from edges))
    select src, dst, weight from heavy
    union all select distinct item, 'isolated', 0 from pairs where item not in (select src from heavy union select dst from heavy)
    """,
)
def pip_network(t):
    awards = (
        t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t.part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("l_suppkey").alias("cfda_number"),
            F.col("s_name").alias("cfda_title"),
            F.col("l_partkey").alias("recipient_uei"),
            F.concat_ws(" ", "p_name", "p_brand").alias("recipient_name"),
            "l_orderkey",
            "l_linenumber",
        )
    )
    net = shared_grantees(awards, ["l_orderkey", "l_linenumber"])
    alone = net["nodes"].join(net["heavy_nodes"], "name", "left_anti")
    lone = alone.select(F.col("name").alias("src"), F.lit("isolated").alias("dst"), F.lit(0).cast("long").alias("weight"))
    return net["heavy_edges"].union(lone)
