"""Enrichment, linkage, area classes and quality control."""

from pyspark.sql import functions as F

from granary.catalog.registry import query
from granary.catalog.standins import WITHIN_SQL, points, polygon_table
from granary.operators.checks import (
    control_total,
    expected_rows,
    remove_ids,
    rolled_difference,
    source_difference,
    uncovered,
    violations,
)
from granary.operators.enrich import cascade_lookup, pending_keys, repair_unmatched
from granary.operators.geometry import area_class, to_wgs84, within_join
from granary.operators.joins import fanout_check, left_join_na
from granary.operators.linkage import apply_threshold, link, weak_matches


@query(
    "enr_pending",
    "select distinct source from documents d left join labels l on d.doc_id = l.doc_id where quality is null",
)
def enr_pending(t):
    joined = left_join_na(t.documents.select("doc_id", "source"), t.labels, "doc_id")
    return pending_keys(joined, "source", F.col("quality").isNull())


@query(
    "enr_cascade",
    """
    select d.doc_id, coalesce(l.quality, b.quality, c.quality) as quality,
        case when l.quality is not null then 'labels' when b.quality is not null then 'lines'
             when c.quality is not null then 'conversations' end as source
    from documents d left join labels l on d.doc_id = l.doc_id
    left join (select l_orderkey as doc_id, cast(min(l_linenumber) as int) as quality from lineitem
               where l_linenumber > 2 group by 1) b on d.doc_id = b.doc_id
    left join (select conv_id as doc_id, cast(min(turn) as int) as quality from conversations group by 1) c on d.doc_id = c.doc_id
    """,
)
def enr_cascade(t):
    lines = t.lineitem.where("l_linenumber > 2").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("quality")
    )
    talks = t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("quality"))
    sources = [("labels", t.labels), ("lines", lines), ("conversations", talks)]
    return cascade_lookup(t.documents.select("doc_id"), "doc_id", ["quality"], sources)


@query(
    "enr_repair",
    """
    with c as (select c_custkey, c_mktsegment, case when c_acctbal > 3000 then c_nationkey end as nation from customer),
    fixed as (
        select c_custkey, c_mktsegment, coalesce(nation, s_nationkey) as nation from c
        left join supplier on c_custkey = s_suppkey)
    select c_custkey, c_mktsegment, nation, n_name from fixed left join nation n on fixed.nation = n_nationkey
    """,
)
def enr_repair(t):
    return _repaired(t)[1]


@query(
    "enr_repair_count",
    "select count(*) as n_before, count(*) as n_after, true as is_unchanged from customer",
)
def enr_repair_count(t):
    return fanout_check(*_repaired(t))


def _repaired(t):
    customers = t.customer.select(
        "c_custkey", "c_mktsegment", F.when(F.col("c_acctbal") > 3000, F.col("c_nationkey")).alias("nation")
    )
    fallback = t.supplier.select(F.col("s_suppkey").alias("c_custkey"), F.col("s_nationkey").alias("nation"))
    names = t.nation.select(F.col("n_nationkey").alias("nation"), "n_name")
    return customers, repair_unmatched(customers, "c_custkey", "nation", fallback, names)


@query(
    "geo_to_wgs84",
    """
    select o_orderkey, round(degrees(o_totalprice * 10 / 6378137e0), 9) as lon,
           round(degrees(2 * atan(exp(dayofyear(o_orderdate) * 10000 / 6378137e0)) - pi() / 2), 9) as lat
    from orders
    """,
)
def geo_to_wgs84(t):
    lon, lat = to_wgs84(F.col("o_totalprice") * 10, F.dayofyear("o_orderdate") * 10000)
    return t.orders.select("o_orderkey", F.round(lon, 9).alias("lon"), F.round(lat, 9).alias("lat"))


@query(
    "geo_area_class",
    f"""
    with {WITHIN_SQL}
    select p.o_orderkey, case when tract_fips is not null then 'urban'
        when n_name in ('NATION_3', 'NATION_8') then 'isolated' else 'rural' end as area_type
    from points p join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
    left join hits h on p.o_orderkey = h.o_orderkey
    """,
)
def geo_area_class(t):
    located = (
        points(t)
        .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("o_orderkey", "lon", "lat", F.col("n_name").alias("state_code"))
    )
    placed = within_join(located, polygon_table(t, "ua_id"), "ua_id", "lon", "lat")
    return placed.select("o_orderkey", area_class("ua_id", "state_code", ["NATION_3", "NATION_8"]).alias("area_type"))


def _two_sources(t):
    """Names as plain numbers, so that they differ in few characters."""
    suppliers = t.supplier.select(
        "s_suppkey", F.regexp_replace("s_name", "^Supplier#0*", "S").alias("name"), F.col("s_nationkey").alias("nation")
    )
    customers = t.customer.select(
        "c_custkey", F.regexp_replace("c_name", "^Customer#0*", "S").alias("name"), F.col("c_nationkey").alias("nation")
    )
    return suppliers, customers


LINK_SQL = """
    s as (select s_suppkey, regexp_replace(s_name, '^Supplier#0*', 'S') as a, s_nationkey as nation from supplier),
    c as (select c_custkey, regexp_replace(c_name, '^Customer#0*', 'S') as b, c_nationkey as nation from customer),
    pairs as (
        select s_suppkey, c_custkey, a, b, s.nation = c.nation as same,
               1 - levenshtein(a, b) / greatest(length(a), length(b)) as sim
        from s join c on s.nation = c.nation or s.nation not in (select nation from c)
    ),
    best as (
        select s_suppkey, c_custkey, sim, same from
        (select *, row_number() over (partition by s_suppkey order by sim desc, b, c_custkey) as r from pairs)
        where r = 1
    ),
    links as (
        select s.s_suppkey, c_custkey, sim as similarity, same as is_exact_equal,
               0.25e0 * sim + 0.75e0 * cast(same as int) as score
        from s left join best on s.s_suppkey = best.s_suppkey
    )
"""


@query(
    "lnk_fuzzy_top1",
    f"with {LINK_SQL} select s_suppkey, c_custkey, round(similarity, 9) as similarity, is_exact_equal, round(score, 9) as score from links",
)
def lnk_fuzzy_top1(t):
    suppliers, customers = _two_sources(t)
    links = link(suppliers, customers, "name", "nation", "s_suppkey", "c_custkey")
    return links.withColumns({c: F.round(c, 9) for c in ("similarity", "score")})


@query(
    "lnk_threshold",
    f"""
    with {LINK_SQL}
    select l.s_suppkey, l.c_custkey, case when similarity >= 0.8 then c_acctbal else 0 end as amount,
           coalesce(similarity < 0.8, true) as is_weak, coalesce(c_name, s_name) as name
    from links l join supplier s on l.s_suppkey = s.s_suppkey left join customer c on l.c_custkey = c.c_custkey
    """,
)
def lnk_threshold(t):
    return _thresholded(t).select(
        "s_suppkey", "c_custkey", "amount", "is_weak", F.coalesce("c_name", "s_name").alias("name")
    )


@query(
    "lnk_weak",
    f"""
    with {LINK_SQL}
    select l.s_suppkey, l.c_custkey, round(similarity, 9) as similarity, s_name, c_name, c_acctbal as amount_raw
    from links l join supplier s on l.s_suppkey = s.s_suppkey left join customer c on l.c_custkey = c.c_custkey
    where coalesce(similarity < 0.8, true)
    """,
)
def lnk_weak(t):
    weak = weak_matches(_thresholded(t), ["s_suppkey", "c_custkey", "similarity", "s_name", "c_name", "amount_raw"])
    return weak.withColumn("similarity", F.round("similarity", 9))


def _thresholded(t):
    suppliers, customers = _two_sources(t)
    links = link(suppliers, customers, "name", "nation", "s_suppkey", "c_custkey")
    amounts = t.customer.select("c_custkey", F.col("c_acctbal").alias("amount"), "c_name")
    joined = left_join_na(links, amounts, "c_custkey")
    named = left_join_na(joined, t.supplier.select("s_suppkey", "s_name"), "s_suppkey")
    return apply_threshold(named, "amount", 0.8)


@query(
    "qc_verify",
    """
    select o_orderkey, o_orderstatus from orders
    where not coalesce(nullif(o_orderstatus, 'P') = 'F' or o_totalprice > 400000, false)
    """,
)
def qc_verify(t):
    status = F.nullif("o_orderstatus", F.lit("P"))
    return violations(t.orders, (status == "F") | (F.col("o_totalprice") > 400000)).select("o_orderkey", "o_orderstatus")


@query(
    "qc_control_total",
    """
    select (select sum(l_quantity) from lineitem) as total_raw,
           (select sum(l_quantity) from lineitem join orders on l_orderkey = o_orderkey where o_orderstatus <> 'P') as total_processed,
           (select sum(l_quantity) from lineitem) -
           (select sum(l_quantity) from lineitem join orders on l_orderkey = o_orderkey where o_orderstatus <> 'P') as difference
    """,
)
def qc_control_total(t):
    kept = t.lineitem.join(t.orders.where("o_orderstatus <> 'P'"), F.col("l_orderkey") == F.col("o_orderkey"))
    return control_total(t.lineitem, F.sum("l_quantity"), kept, F.sum("l_quantity"))


@query(
    "qc_expected_rows",
    """
    select count(*) as n_actual, count(distinct l_suppkey) as n_grants, count(distinct l_linenumber) as n_months,
           count(distinct l_suppkey) * count(distinct l_linenumber) * 2 as n_expected,
           count(*) = count(distinct l_suppkey) * count(distinct l_linenumber) * 2 as is_complete
    from (select distinct l_suppkey, l_linenumber, l_linestatus from lineitem)
    """,
)
def qc_expected_rows(t):
    rows = t.lineitem.select("l_suppkey", "l_linenumber", "l_linestatus").distinct()
    sizes = {"n_grants": F.count_distinct("l_suppkey"), "n_months": F.count_distinct("l_linenumber")}
    return expected_rows(rows, sizes, 2)


def _order_values(t):
    model = t.lineitem.groupBy(F.col("l_orderkey").alias("award")).agg(F.sum("l_quantity").alias("amount"))
    actual = t.orders.select(F.col("o_orderkey").alias("award"), F.floor("o_totalprice").cast("double").alias("amount"))
    return model, actual


DIFF_SQL = """
    select award, amount_model, amount_actual, amount_actual - amount_model as difference from
    (select l_orderkey as award, sum(l_quantity) as amount_model from lineitem group by 1)
    join (select o_orderkey as award, floor(o_totalprice) as amount_actual from orders) using (award)
"""


@query(
    "qc_source_diff",
    f"""
    with d as ({DIFF_SQL}),
    detail as (select o_orderpriority as grp, sum(difference) as difference_detail from d join orders on award = o_orderkey group by 1),
    m as (select o_orderpriority as grp, sum(l_quantity) as q from lineitem join orders on l_orderkey = o_orderkey group by 1),
    a as (select o_orderpriority as grp, sum(floor(o_totalprice)) as p from orders group by 1)
    select grp, difference_detail, p - q as difference_summary, difference_detail = p - q as is_equal
    from detail left join m using (grp) left join a using (grp)
    """,
)
def qc_source_diff(t):
    model, actual = _order_values(t)
    detail = source_difference(model, actual, ["award"], "amount")
    groups = t.orders.select(F.col("o_orderkey").alias("award"), F.col("o_orderpriority").alias("grp"))
    by_group = left_join_na(detail, groups, "award")
    model_sum = left_join_na(model, groups, "award").groupBy("grp").agg(F.sum("amount").alias("amount"))
    actual_sum = left_join_na(actual, groups, "award").groupBy("grp").agg(F.sum("amount").alias("amount"))
    summary = source_difference(model_sum, actual_sum, ["grp"], "amount")
    return rolled_difference(by_group, "grp", summary)


@query("qc_source_pairs", DIFF_SQL)
def qc_source_pairs(t):
    model, actual = _order_values(t)
    return source_difference(model, actual, ["award"], "amount")


@query(
    "qc_coverage",
    """
    select c_mktsegment, count(*) as n, round(count(*) / sum(count(*)) over (), 9) as pct
    from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 450000) group by 1
    """,
)
def qc_coverage(t):
    large = t.orders.where("o_totalprice > 450000")
    counts = uncovered(t.customer, "c_custkey", large, "c_mktsegment", reference_key="o_custkey")
    return counts.withColumn("pct", F.round("pct", 9))


@query(
    "qc_remove_ids",
    "select o_orderkey, nullif(o_custkey, 5) as o_custkey from orders where coalesce(nullif(o_custkey, 5) not in (1, 2, 3), true)",
)
def qc_remove_ids(t):
    rows = t.orders.select("o_orderkey", F.nullif("o_custkey", F.lit(5)).alias("o_custkey"))
    return remove_ids(rows, "o_custkey", [1, 2, 3]).select("o_orderkey", "o_custkey")
