"""Domain-shaped tables derived from the test tables, with the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATINGS = [
    "Very High",
    "Relatively High",
    "Relatively Moderate",
    "Relatively Low",
    "Very Low",
    "Not Applicable",
    "Insufficient Data",
    "No Rating",
]
SLOTS = ["aian_hs_slots", "ehs_slots", "hs_slots", "migrant_hs_slots"]


def sites(t) -> DataFrame:
    """Orders as sites of grantees (customers) in states (nations)."""
    ratings = F.array(*[F.lit(r) for r in RATINGS])

    def rating(number):
        return F.get(ratings, (number % 9).cast("int"))

    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    price = F.floor("o_totalprice")
    funded = F.col("o_orderstatus") != "O"
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(
        t.nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    urgent, medium = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.col("o_orderpriority") == "3-MEDIUM"
    return joined.select(
        key.cast("string").alias("location_id"),
        cust.cast("string").alias("grant_id"),
        F.col("c_name").alias("grantee"),
        F.col("c_mktsegment").alias("program"),
        F.col("n_name").alias("state_code"),
        (F.col("o_orderstatus") == "F").alias("is_federal_interest_site"),
        urgent.alias("is_owned_by_program"),
        (F.col("o_orderstatus") == "P").alias("is_child_care_partner_site"),
        (key % 7).cast("double").alias("aian_hs_slots"),
        F.when(funded, cust % 20).otherwise(0).cast("double").alias("ehs_slots"),
        F.when(funded, key % 50).otherwise(0).cast("double").alias("hs_slots"),
        (price % 5).cast("double").alias("migrant_hs_slots"),
        rating(key).alias("risk_ratng"),
        rating(key + cust).alias("hrcn_riskr"),
        rating(cust * 3 + key).alias("trnd_riskr"),
        rating(price).alias("wfir_riskr"),
        F.when(urgent, "urban").when(medium, "isolated").otherwise("rural").alias("area_type"),
        ((price % 101) / 100).alias("pct_poverty_middle"),
        ((cust % 30 + 1) / 100).alias("pct_poverty_moe"),
    )


SITES_SQL = """
sites as (
    select cast(o_orderkey as varchar) as location_id, cast(o_custkey as varchar) as grant_id,
        c_name as grantee, c_mktsegment as program, n_name as state_code,
        o_orderstatus = 'F' as is_federal_interest_site,
        o_orderpriority in ('1-URGENT', '2-HIGH') as is_owned_by_program,
        o_orderstatus = 'P' as is_child_care_partner_site,
        cast(o_orderkey % 7 as double) as aian_hs_slots,
        cast(case when o_orderstatus <> 'O' then o_custkey % 20 else 0 end as double) as ehs_slots,
        cast(case when o_orderstatus <> 'O' then o_orderkey % 50 else 0 end as double) as hs_slots,
        cast(cast(floor(o_totalprice) as bigint) % 5 as double) as migrant_hs_slots,
        {rating_0} as risk_ratng, {rating_1} as hrcn_riskr, {rating_2} as trnd_riskr, {rating_3} as wfir_riskr,
        case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'urban'
             when o_orderpriority = '3-MEDIUM' then 'isolated' else 'rural' end as area_type,
        (cast(floor(o_totalprice) as bigint) % 101) / 100e0 as pct_poverty_middle,
        (o_custkey % 30 + 1) / 100e0 as pct_poverty_moe
    from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
)"""
for _i, _n in enumerate(
    ["o_orderkey", "o_orderkey + o_custkey", "o_custkey * 3 + o_orderkey", "cast(floor(o_totalprice) as bigint)"]
):
    SITES_SQL = SITES_SQL.replace(
        f"{{rating_{_i}}}", f"list_extract({RATINGS}, cast(1 + ({_n}) % 9 as int))"
    )

BY_RISK_SQL = (
    SITES_SQL
    + """,
by_risk as (
    select * exclude (risk_ratng, hrcn_riskr, trnd_riskr, wfir_riskr, raw),
        case when raw is null or raw = 'No Rating' then 'Insufficient Data' else raw end as risk_rating
    from (
        select *, 'Overall' as risk_type, risk_ratng as raw from sites
        union all select *, 'Hurricane', hrcn_riskr from sites
        union all select *, 'Tornado', trnd_riskr from sites
        union all select *, 'Wildfire', wfir_riskr from sites
    )
),
at_risk as (
    select * from by_risk where risk_rating in ('Very High', 'Relatively High', 'Relatively Moderate')
)"""
)


def polygon_table(t, id: str = "tract_fips") -> DataFrame:
    """Two parts per nation: a notched block with a hole, and a triangle."""
    x0, y0 = F.col("n_nationkey") * 20 + 0.123, F.col("n_nationkey") * 5 + 40.077

    def ring(points):
        return F.array(*[F.struct((x0 + x).alias("x"), (y0 + y).alias("y")) for x, y in points])

    block = F.array(ring(OUTER), ring(HOLE))
    parts = F.array(block, F.array(ring(TRIANGLE)))
    return t.nation.select(F.col("n_name").alias(id), F.explode(parts).alias("rings"))


OUTER = [(0.0, 0.0), (60.0, 0.0), (60.0, 150.0), (30.0, 60.0), (0.0, 150.0)]
HOLE = [(5.0, 5.0), (15.0, 5.0), (15.0, 25.0), (5.0, 25.0)]
TRIANGLE = [(150.0, -20.0), (190.0, -20.0), (170.0, 30.0)]


def points(t) -> DataFrame:
    """Orders as points: price in thousands against day of the year."""
    return t.orders.select(
        "o_orderkey",
        "o_custkey",
        (F.col("o_totalprice") / 1000).alias("lon"),
        F.dayofyear("o_orderdate").cast("double").alias("lat"),
    )


def _sides() -> str:
    rows = []
    for ring in (OUTER, HOLE, TRIANGLE):
        rows += [f"({x1}, {y1}, {x2}, {y2})" for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1])]
    return ", ".join(rows)


# even-odd count over all sides of a nation's two parts; no vertex lies on the data's grid
WITHIN_SQL = f"""
points as (
    select o_orderkey, o_custkey, o_totalprice / 1000e0 as lon, cast(dayofyear(o_orderdate) as double) as lat from orders
),
sides as (
    select n_name as tract_fips, n_nationkey * 20 + 0.123e0 + dx1 as x1, n_nationkey * 5 + 40.077e0 + dy1 as y1,
           n_nationkey * 20 + 0.123e0 + dx2 as x2, n_nationkey * 5 + 40.077e0 + dy2 as y2
    from nation, (values {_sides()}) as v(dx1, dy1, dx2, dy2)
),
hits as (
    select o_orderkey, tract_fips from points, sides
    where (y1 > lat) <> (y2 > lat) and lon < x1 + (lat - y1) * (x2 - x1) / (y2 - y1)
    group by o_orderkey, tract_fips having count(*) % 2 = 1
)"""
