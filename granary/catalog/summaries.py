"""Aggregation and windows."""

from pyspark.sql import functions as F

from granary.catalog.registry import query
from granary.functions import mean_r, n_distinct_r, sum_r
from granary.operators.aggregate import (
    add_totals_row,
    consolidate,
    count_by_group,
    count_rows,
    distinct_if,
    histogram,
    listed,
    null_counts,
    numeric_summary,
    stacked_counts,
    sum_if,
)
from granary.operators.columns import across, aggs, fiscal_year_of
from granary.operators.joins import left_join_na
from granary.operators.quantiles import group_quantiles, quantile_table
from granary.operators.sets import union_by_name
from granary.operators.windows import (
    add_entity_id,
    fill_down,
    number_rows,
    row_key,
    share_within,
    top_k,
    top_k_ties,
)


def rounded(df, digits, *names):
    return df.withColumns(across(names, lambda c: F.round(c, digits)))


@query(
    "agg_count_by_group",
    """
    select o_orderpriority, o_orderstatus, count(*) as n, round(count(*) / sum(count(*)) over (), 9) as pct
    from orders group by all
    """,
)
def agg_count_by_group(t):
    counts = count_by_group(t.orders, "o_orderpriority", "o_orderstatus")
    return rounded(counts, 9, "pct")


@query("agg_count", "select l_suppkey, l_returnflag, count(*) as n from lineitem group by all")
def agg_count(t):
    return count_rows(t.lineitem, "l_suppkey", "l_returnflag")


@query(
    "agg_sum_na",
    """
    select user_id, case when count(*) = count(v) then round(sum(v), 4) end as total,
           round(coalesce(sum(v), 0), 4) as total_known, round(coalesce(sum(w), 0), 4) as total_none
    from (select user_id, case when value >= 0.5 then value end as v, case when value > 1e9 then value end as w from events)
    group by 1
    """,
)
def agg_sum_na(t):
    holes = t.events.select(
        "user_id",
        F.when(F.col("value") >= 0.5, F.col("value")).alias("v"),
        F.when(F.col("value") > 1e9, F.col("value")).alias("w"),
    )
    sums = holes.groupBy("user_id").agg(
        sum_r("v").alias("total"), sum_r("v", True).alias("total_known"), sum_r("w", True).alias("total_none")
    )
    return rounded(sums, 4, "total", "total_known", "total_none")


@query(
    "agg_mean_share",
    """
    select l_suppkey, round(avg(l_quantity), 6) as mean_quantity,
           round(avg(cast(l_returnflag = 'R' as int)), 9) as share_returned,
           case when count(*) = count(nullif(l_discount, 0.1)) then round(avg(nullif(l_discount, 0.1)), 6) end as mean_all,
           round(avg(nullif(l_discount, 0.1)), 6) as mean_known
    from lineitem group by 1
    """,
)
def agg_mean_share(t):
    discount = F.nullif("l_discount", F.lit(0.1))
    means = t.lineitem.groupBy("l_suppkey").agg(
        F.round(mean_r("l_quantity"), 6).alias("mean_quantity"),
        F.round(mean_r((F.col("l_returnflag") == "R").cast("int")), 9).alias("share_returned"),
        F.round(mean_r(discount), 6).alias("mean_all"),
        F.round(mean_r(discount, na_rm=True), 6).alias("mean_known"),
    )
    return means


@query(
    "agg_n_distinct",
    """
    select lang, count(distinct quality) + max(case when quality is null then 1 else 0 end) as n_values,
           count(distinct quality) as n_known
    from documents d left join labels l on d.doc_id = l.doc_id group by 1
    """,
)
def agg_n_distinct(t):
    joined = left_join_na(t.documents.select("doc_id", "lang"), t.labels, "doc_id")
    return joined.groupBy("lang").agg(
        n_distinct_r("quality").alias("n_values"), n_distinct_r("quality", na_rm=True).alias("n_known")
    )


@query(
    "agg_cond_distinct",
    """
    select l_suppkey, count(distinct case when l_returnflag = 'R' then l_partkey end) as n_returned,
           count(distinct case when l_returnflag = 'R' then l_partkey end) +
               max(case when l_returnflag = 'R' then 0 else 1 end) as n_returned_or_other
    from lineitem group by 1
    """,
)
def agg_cond_distinct(t):
    returned = F.col("l_returnflag") == "R"
    return t.lineitem.groupBy("l_suppkey").agg(
        distinct_if(returned, "l_partkey").alias("n_returned"),
        distinct_if(returned, "l_partkey", na_rm=False).alias("n_returned_or_other"),
    )


@query(
    "agg_cond_sum",
    """
    select l_suppkey, round(sum(case when l_returnflag = 'R' then l_quantity else 0 end), 4) as quantity_returned,
           count(*) filter (l_quantity > 40) as n_large,
           case when count(*) = count(nullif(l_discount, 0.07))
                then round(sum(case when l_returnflag = 'R' then nullif(l_discount, 0.07) else 0 end), 4) end as discount_returned
    from lineitem group by 1
    """,
)
def agg_cond_sum(t):
    returned = F.col("l_returnflag") == "R"
    return t.lineitem.groupBy("l_suppkey").agg(
        F.round(sum_if(returned, "l_quantity"), 4).alias("quantity_returned"),
        F.count_if(F.col("l_quantity") > 40).alias("n_large"),
        F.round(sum_if(returned, F.nullif("l_discount", F.lit(0.07))), 4).alias("discount_returned"),
    )


@query(
    "agg_quantiles",
    """
    select o_orderpriority, round(median(o_totalprice), 4) as median_price,
           round(quantile_cont(o_totalprice, 0.25), 4) as p25, round(quantile_cont(o_totalprice, 0.75), 4) as p75,
           round(quantile_cont(o_totalprice, 0.95), 4) as p95
    from orders group by 1
    """,
)
def agg_quantiles(t):
    names = {"median_price": 0.5, "p25": 0.25, "p75": 0.75, "p95": 0.95}
    wide = group_quantiles(t.orders, ["o_orderpriority"], {n: ("o_totalprice", p) for n, p in names.items()})
    return rounded(wide, 4, *names)


@query(
    "agg_quantile_table",
    " union all ".join(
        f"select {q}::double as q, round(quantile_cont(l_extendedprice, {q}), 4) as x from lineitem"
        for q in (0.25, 0.5, 0.75, 0.95)
    ),
)
def agg_quantile_table(t):
    return rounded(quantile_table(t.lineitem, "l_extendedprice", [0.25, 0.5, 0.75, 0.95]), 4, "x")


@query(
    "agg_summary",
    """
    select round(min(v), 4) as min, round(quantile_cont(v, 0.25), 4) as q1, round(median(v), 4) as median,
           round(avg(v), 6) as mean, round(quantile_cont(v, 0.75), 4) as q3, round(max(v), 4) as max,
           count(*) - count(v) as n_missing
    from (select case when c_acctbal > 0 then c_acctbal end as v from customer)
    """,
)
def agg_summary(t):
    holes = t.customer.select(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("v"))
    return rounded(rounded(numeric_summary(holes, "v"), 4, "min", "q1", "median", "q3", "max"), 6, "mean")


@query(
    "agg_null_counts",
    """
    select count(*) - count(lang) as lang, count(*) - count(quality) as quality, count(*) - count(toxic) as toxic
    from documents d left join labels l on d.doc_id = l.doc_id
    """,
)
def agg_null_counts(t):
    joined = left_join_na(t.documents.select("doc_id", "lang"), t.labels, "doc_id")
    return null_counts(joined, ["lang", "quality", "toxic"])


@query(
    "agg_min_max",
    """
    select o_custkey, max(case when o_totalprice < 100000 then o_totalprice end) as largest_small,
           min(nullif(o_orderpriority, '1-URGENT')) as first_priority, max(o_orderdate)::date as last_day
    from orders group by 1
    """,
)
def agg_min_max(t):
    small = F.when(F.col("o_totalprice") < 100000, F.col("o_totalprice"))
    return t.orders.groupBy("o_custkey").agg(
        F.max(small).alias("largest_small"),
        F.min(F.nullif("o_orderpriority", F.lit("1-URGENT"))).alias("first_priority"),
        F.to_date(F.max("o_orderdate")).alias("last_day"),
    )


@query(
    "agg_bool_or",
    "select l_orderkey, bool_or(l_returnflag = 'R' and l_quantity > 30) as any_large_return from lineitem group by 1",
)
def agg_bool_or(t):
    flag = (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 30)
    return t.lineitem.groupBy("l_orderkey").agg(F.bool_or(flag).alias("any_large_return"))


@query(
    "agg_listagg",
    """
    select l_orderkey, coalesce(string_agg(nullif(l_returnflag, 'N'), ' / ' order by l_linenumber, l_returnflag), '') as flags
    from lineitem group by 1
    """,
)
def agg_listagg(t):
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber", F.nullif("l_returnflag", F.lit("N")).alias("flag"), "l_returnflag"
    )
    return rows.groupBy("l_orderkey").agg(listed("flag", " / ", ["l_linenumber", "l_returnflag"]).alias("flags"))


@query(
    "agg_consolidate",
    """
    select l_orderkey, l_linestatus, coalesce(string_agg(l_returnflag, ' & ' order by l_returnflag), '') as flags,
           max(l_extendedprice) as price, min(l_shipdate)::date as first_day, bool_or(l_tax > 0.05) as is_taxed,
           round(coalesce(sum(nullif(l_quantity, 50)), 0), 4) as quantity
    from lineitem group by 1, 2
    """,
)
def agg_consolidate(t):
    rows = t.lineitem.select(
        "l_orderkey",
        "l_linestatus",
        F.col("l_returnflag").alias("flags"),
        F.col("l_extendedprice").alias("price"),
        F.to_date("l_shipdate").alias("first_day"),
        (F.col("l_tax") > 0.05).alias("is_taxed"),
        F.nullif("l_quantity", F.lit(50.0)).alias("quantity"),
    )
    rules = {"flags": "list: & ", "price": "max", "first_day": "min", "is_taxed": "any", "quantity": "sum"}
    return rounded(consolidate(rows, ["l_orderkey", "l_linestatus"], rules, ["flags"]), 4, "quantity")


@query(
    "agg_totals_row",
    """
    with s as (select o_orderstatus as status, count(*) as n, count(distinct o_custkey) as n_grantees,
               round(sum(o_totalprice), 2) as amount from orders group by 1)
    select * from s union all select 'Total', cast(sum(n) as bigint), cast(sum(n_grantees) as bigint), round(sum(amount), 2) from s
    """,
)
def agg_totals_row(t):
    summary = t.orders.groupBy(F.col("o_orderstatus").alias("status")).agg(
        F.count(F.lit(1)).alias("n"),
        n_distinct_r("o_custkey").alias("n_grantees"),
        F.sum("o_totalprice").alias("amount"),
    )
    return rounded(add_totals_row(summary, "status"), 2, "amount")


@query(
    "agg_drilldown",
    """
    select c_nationkey as state, o_orderpriority as risk_type, count(*) as n_locations,
           count(distinct o_custkey) as n_grantees, count(distinct c_mktsegment) as n_programs,
           cast(sum(cast(o_orderstatus = 'F' as int)) as bigint) as n_federal, round(sum(o_totalprice), 2) as amount
    from orders join customer on o_custkey = c_custkey group by 1, 2
    """,
)
def agg_drilldown(t):
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(F.col("c_nationkey").alias("state"), F.col("o_orderpriority").alias("risk_type")).agg(
        F.count(F.lit(1)).alias("n_locations"),
        n_distinct_r("o_custkey").alias("n_grantees"),
        n_distinct_r("c_mktsegment").alias("n_programs"),
        sum_r((F.col("o_orderstatus") == "F").cast("int")).alias("n_federal"),
        F.round(sum_r("o_totalprice"), 2).alias("amount"),
    )


@query(
    "agg_duration",
    """
    select user_id, event_type, cast(count(*) as int) as duration, round(sum(value), 4) as total,
           min(day(ts)) as first_day, min(day(ts)) + cast(count(*) as int) - 1 as last_nth
    from events group by 1, 2
    """,
)
def agg_duration(t):
    spans = t.events.groupBy("user_id", "event_type").agg(
        F.count(F.lit(1)).cast("int").alias("duration"),
        F.round(sum_r("value"), 4).alias("total"),
        F.min(F.dayofmonth("ts")).alias("first_day"),
    )
    return spans.withColumn("last_nth", fiscal_year_of("first_day", "duration"))


@query(
    "agg_stack_summaries",
    """
    select 'Overall' as label, o_orderpriority, count(*) as n from orders group by 2
    union all select concat('At-risk for ', o_orderpriority), o_orderpriority, count(*) from orders
    where o_totalprice > 250000 group by 2
    """,
)
def agg_stack_summaries(t):
    overall = count_rows(t.orders, "o_orderpriority").withColumn("label", F.lit("Overall"))
    risky = count_rows(t.orders.where("o_totalprice > 250000"), "o_orderpriority")
    named = risky.withColumn("label", F.concat(F.lit("At-risk for "), "o_orderpriority"))
    return union_by_name(overall, named)


@query(
    "agg_histogram",
    """
    select cast(ceil(o_totalprice / 10000 - 0.5) as bigint) * 10000e0 as bin, count(*) as n from orders group by 1
    """,
)
def agg_histogram(t):
    return histogram(t.orders, "o_totalprice", 10000.0)


@query(
    "agg_stacked_counts",
    """
    select l_returnflag, l_linenumber, count(*) as n,
           round(count(*) / sum(count(*)) over (partition by l_returnflag), 9) as pct
    from lineitem group by 1, 2
    """,
)
def agg_stacked_counts(t):
    return rounded(stacked_counts(t.lineitem, "l_returnflag", "l_linenumber"), 9, "pct")


LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
LINE_ORDER_SQL = ", ".join(LINE_ORDER)


@query(
    "win_entity_id",
    f"""
    select l_orderkey, l_linenumber, l_partkey, l_extendedprice,
        l_orderkey || '-' || row_number() over (partition by l_orderkey order by {LINE_ORDER_SQL}) as location_id
    from lineitem
    """,
)
def win_entity_id(t):
    numbered = add_entity_id(t.lineitem, "l_orderkey", LINE_ORDER, "location_id")
    return numbered.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "location_id")


@query(
    "win_dummy_filter",
    f"""
    select l_orderkey, l_linenumber, l_partkey, l_extendedprice,
        row_number() over (partition by l_orderkey order by {LINE_ORDER_SQL}) as dummy_filter
    from lineitem
    """,
)
def win_dummy_filter(t):
    numbered = number_rows(t.lineitem, ["l_orderkey"], LINE_ORDER, "dummy_filter")
    return numbered.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.col("dummy_filter").cast("long").alias("dummy_filter")
    )


@query(
    "win_row_key",
    "select n_name, cast(row_number() over (order by n_name) as varchar) as pk from nation",
)
def win_row_key(t):
    return row_key(t.nation.select("n_name"), ["n_name"], "pk")


@query(
    "win_share",
    """
    select o_orderpriority, o_orderstatus, count(*) as n,
           round(count(*) / sum(count(*)) over (partition by o_orderpriority), 9) as pct
    from orders group by 1, 2
    """,
)
def win_share(t):
    counts = count_rows(t.orders, "o_orderpriority", "o_orderstatus")
    return rounded(share_within(counts, "n", "o_orderpriority"), 9, "pct")


@query(
    "win_fill_down",
    """
    select event_id, user_id, last_value(nullif(event_type, 'view') ignore nulls) over
        (partition by user_id order by event_id rows unbounded preceding) as event_type
    from events
    """,
)
def win_fill_down(t):
    holes = t.events.select("event_id", "user_id", F.nullif("event_type", F.lit("view")).alias("event_type"))
    return fill_down(holes, ["user_id"], ["event_id"], ["event_type"])


@query(
    "win_top_k",
    """
    with s as (select c_nationkey, o_custkey, count(*) as n from orders join customer on o_custkey = c_custkey group by 1, 2)
    select * exclude (r) from (select *, row_number() over (partition by c_nationkey order by n desc, o_custkey) as r from s)
    where r <= 5
    """,
)
def win_top_k(t):
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return top_k(count_rows(joined, "c_nationkey", "o_custkey"), ["c_nationkey"], ["-n", "o_custkey"], 5)


@query(
    "win_top_k_ties",
    """
    select l_returnflag, l_orderkey, l_linenumber, l_quantity from
    (select *, rank() over (partition by l_returnflag order by l_quantity desc) as r from lineitem) where r <= 10
    """,
)
def win_top_k_ties(t):
    rows = t.lineitem.select("l_returnflag", "l_orderkey", "l_linenumber", "l_quantity")
    return top_k_ties(rows, ["l_returnflag"], "-l_quantity", 10)
