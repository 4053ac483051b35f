"""Joins, sorts and set operations."""

from pyspark.sql import functions as F

from granary.catalog.registry import query
from granary.catalog.standins import WITHIN_SQL, points, polygon_table
from granary.operators.geometry import within_join
from granary.operators.joins import (
    anti_join,
    fanout_check,
    join_checked,
    join_coalesce,
    left_join_na,
    natural_left_join,
    semi_join,
)
from granary.operators.sets import (
    align,
    duplicates,
    first_per_key,
    union_by_name,
    union_literals,
    value_difference,
)
from granary.operators.windows import ordering


def _segments(t):
    """Customers and per-segment facts, BUILDING made a missing key on both sides."""
    key = F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment")
    people = t.customer.select("c_custkey", key)
    facts = t.customer.groupBy(key).agg(F.count(F.lit(1)).alias("n_segment"))
    return people, facts


@query(
    "jn_left",
    """
    with f as (select nullif(c_mktsegment, 'BUILDING') as segment, count(*) as n_segment from customer group by 1)
    select o_orderkey, p.segment, n_segment from orders
    left join (select c_custkey, nullif(c_mktsegment, 'BUILDING') as segment from customer) p on o_custkey = c_custkey
    left join f on f.segment is not distinct from p.segment
    """,
)
def jn_left(t):
    people, facts = _segments(t)
    orders = t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return left_join_na(left_join_na(orders, people, "c_custkey"), facts, "segment").drop("c_custkey")


@query(
    "jn_left_renamed_key",
    "select o_orderkey, o_custkey, c_name from orders left join customer on o_custkey = c_custkey",
)
def jn_left_renamed_key(t):
    return left_join_na(
        t.orders.select("o_orderkey", "o_custkey"), t.customer.select("c_custkey", "c_name"), {"o_custkey": "c_custkey"}
    )


@query(
    "jn_natural",
    "select l.doc_id, quality, toxic, lang, source from labels l left join documents d on l.doc_id = d.doc_id",
)
def jn_natural(t):
    return natural_left_join(t.labels, t.documents.select("doc_id", "lang", "source"))


@query(
    "jn_coalesce_sides",
    """
    with l as (select doc_id, 1 - quality as flag from labels),
         d as (select doc_id, case when n_chars > 1000 then 7 end as flag, lang from documents)
    select d.doc_id, coalesce(d.flag, l.flag) as flag, lang from d left join l on d.doc_id = l.doc_id
    """,
)
def jn_coalesce_sides(t):
    left = t.documents.select("doc_id", F.when(F.col("n_chars") > 1000, 7).alias("flag"), "lang")
    right = t.labels.select("doc_id", (1 - F.col("quality")).alias("flag"))
    return join_coalesce(left, right, "doc_id", ["flag"])


BUSY_SQL = "select o_custkey from orders where o_totalprice > 480000"


def _busy(t):
    return t.orders.where(F.col("o_totalprice") > 480000)


@query("jn_anti", f"select c_custkey, c_name from customer where c_custkey not in ({BUSY_SQL})")
def jn_anti(t):
    return anti_join(t.customer.select("c_custkey", "c_name"), _busy(t), {"c_custkey": "o_custkey"})


@query("jn_semi", f"select c_custkey, c_name from customer where c_custkey in ({BUSY_SQL})")
def jn_semi(t):
    return semi_join(t.customer.select("c_custkey", "c_name"), _busy(t), {"c_custkey": "o_custkey"})


@query(
    "jn_one_to_one",
    """
    select c_nationkey as state, n_customers, n_suppliers
    from (select c_nationkey, count(*) as n_customers from customer group by 1)
    left join (select s_nationkey, count(*) as n_suppliers from supplier group by 1) on c_nationkey = s_nationkey
    """,
)
def jn_one_to_one(t):
    customers = t.customer.groupBy(F.col("c_nationkey").alias("state")).agg(F.count(F.lit(1)).alias("n_customers"))
    suppliers = t.supplier.groupBy(F.col("s_nationkey").alias("state")).agg(F.count(F.lit(1)).alias("n_suppliers"))
    return join_checked(customers, suppliers, ["state"], "one-to-one")


@query(
    "jn_fanout_check",
    """
    select n_before, n_after, n_before = n_after as is_unchanged
    from (select count(*) as n_before from orders),
         (select count(*) as n_after from orders left join customer on o_custkey = c_custkey)
    """,
)
def jn_fanout_check(t):
    joined = left_join_na(t.orders.select("o_custkey"), t.customer.select("c_custkey"), {"o_custkey": "c_custkey"})
    return fanout_check(t.orders, joined)


@query(
    "jn_dim_broadcast",
    "select s_suppkey, s_nationkey, n_name from supplier left join nation on s_nationkey = n_nationkey",
)
def jn_dim_broadcast(t):
    return left_join_na(
        t.supplier.select("s_suppkey", "s_nationkey"),
        t.nation.select("n_nationkey", "n_name"),
        {"s_nationkey": "n_nationkey"},
    )


@query(
    "geo_within",
    f"with {WITHIN_SQL} select p.o_orderkey, tract_fips from points p left join hits h on p.o_orderkey = h.o_orderkey",
)
def geo_within(t):
    placed = within_join(points(t), polygon_table(t), "tract_fips", "lon", "lat")
    return placed.select("o_orderkey", "tract_fips")


@query(
    "srt_multi",
    """
    select nullif(o_orderstatus, 'P') as status, o_orderpriority, o_totalprice, o_orderkey from orders
    """,
)
def srt_multi(t):
    rows = t.orders.select(
        F.nullif("o_orderstatus", F.lit("P")).alias("status"), "o_orderpriority", "o_totalprice", "o_orderkey"
    )
    return rows.orderBy(*ordering(["status", "o_orderpriority", "-o_totalprice", "o_orderkey"]))


@query(
    "srt_limit",
    "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25",
)
def srt_limit(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(*ordering(["-o_totalprice", "o_orderkey"])).limit(25)


@query(
    "set_union_by_name",
    """
    select c_name as name, c_nationkey as state, c_mktsegment as segment, null::double as balance from customer
    union all select s_name, s_nationkey, null, s_acctbal from supplier
    """,
)
def set_union_by_name(t):
    customers = t.customer.selectExpr("c_name as name", "c_nationkey as state", "c_mktsegment as segment")
    suppliers = t.supplier.selectExpr("s_nationkey as state", "s_acctbal as balance", "s_name as name")
    return union_by_name(customers, suppliers)


@query(
    "set_align",
    """
    select c_custkey as key, c_name as name, c_acctbal as balance, c_mktsegment as segment from customer
    union all select s_suppkey, s_name, s_acctbal, null from supplier
    """,
)
def set_align(t):
    customers = t.customer.selectExpr(
        "c_custkey as key", "c_name as name", "c_acctbal as balance", "c_mktsegment as segment"
    )
    suppliers = t.supplier.selectExpr("s_name as name", "cast(s_suppkey as string) as key", "s_acctbal as balance")
    return customers.union(align(suppliers, customers))


@query("set_distinct", "select distinct l_suppkey, l_returnflag, l_linestatus from lineitem")
def set_distinct(t):
    return t.lineitem.select("l_suppkey", "l_returnflag", "l_linestatus").distinct()


@query(
    "set_first_per_key",
    """
    select user_id, event_id, event_type, value from
    (select *, row_number() over (partition by user_id order by ts, event_id) as r from events) where r = 1
    """,
)
def set_first_per_key(t):
    first = first_per_key(t.events, ["user_id"], ["ts", "event_id"])
    return first.select("user_id", "event_id", "event_type", "value")


@query(
    "set_difference",
    """
    select distinct c_nationkey from customer where c_acctbal < 500
    and c_nationkey not in (select s_nationkey from supplier where s_acctbal > 7000)
    """,
)
def set_difference(t):
    poor, rich = t.customer.where("c_acctbal < 500"), t.supplier.where("s_acctbal > 7000")
    return value_difference(poor, "c_nationkey", rich, "s_nationkey")


@query(
    "set_union_literals",
    "select n_name from nation where n_regionkey = 1 union select unnest(['NATION_1', 'NATION_99'])",
)
def set_union_literals(t):
    return union_literals(t.nation.where("n_regionkey = 1"), "n_name", ["NATION_1", "NATION_99"])


@query(
    "set_duplicates",
    "select o_custkey, o_orderpriority, count(*) as n from orders group by all having count(*) > 1",
)
def set_duplicates(t):
    return duplicates(t.orders, "o_custkey", "o_orderpriority")
