"""Projection, renaming, conditional columns and filters."""

from pyspark.sql import functions as F

from granary.catalog.registry import query
from granary.functions import (
    coalesce_in,
    detect,
    first_known,
    if_else,
    is_in,
    not_in,
    replace_first,
    row_count_if,
    row_sum,
    yes_no,
    yes_no_text,
    zero_to_null,
)
from granary.operators.columns import (
    across,
    aggs,
    band,
    clean_names,
    cols,
    fiscal_year_of,
    impute,
    level_rank,
    recode,
    rename_with,
    score_label,
    select_as,
)
from granary.operators.joins import left_join_na
from granary.operators.windows import rank_by

LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query(
    "prj_select_rename",
    "select l_suppkey as program, l_partkey as recipient, l_extendedprice as amount, l_orderkey as award_id from lineitem",
)
def prj_select_rename(t):
    return select_as(
        t.lineitem, program="l_suppkey", recipient="l_partkey", amount="l_extendedprice", award_id="l_orderkey"
    )


@query(
    "prj_selectors",
    f"select {LINE}, l_shipdate::date as l_shipdate, l_returnflag, l_linestatus, l_tax from lineitem",
)
def prj_selectors(t):
    df = t.lineitem
    names = [
        *cols(df, ends_with="KEY"),
        *cols(df, contains="number"),
        *cols(df, matches="(flag|status)$"),
        *cols(df, any_of=["l_tax", "l_absent"]),
        *cols(df, span=("l_linestatus", "l_shipdate"), but_not=["l_linestatus"]),
    ]
    return df.select(*names).withColumn("l_shipdate", F.to_date("l_shipdate"))


@query(
    "prj_across",
    f"select {LINE}, l_quantity, l_extendedprice, l_quantity * 2 as l_quantity_twice, l_extendedprice * 2 as l_extendedprice_twice from lineitem",
)
def prj_across(t):
    names = ["l_quantity", "l_extendedprice"]
    df = t.lineitem.withColumns(across(names, lambda c: c * 2, "{col}_twice"))
    return df.select(*KEYS, *names, *[f"{c}_twice" for c in names])


@query(
    "prj_rename_with",
    "select p_partkey as xey, p_name as xme, p_brand as xnd, p_type as p_type, p_size as p_size, p_retailprice as xce from part",
)
def prj_rename_with(t):
    named = rename_with(t.part, ["p_partkey", "p_name", "p_brand", "p_retailprice"], lambda c: f"x{c[-2:].lower()}")
    return named


@query(
    "prj_clean_names",
    """select c_custkey as customer_key, c_name as customer_name, c_acctbal as acct_bal_usd,
    c_mktsegment as market_segment, c_nationkey as market_segment_2 from customer""",
)
def prj_clean_names(t):
    messy = select_as(
        t.customer,
        **{
            "Customer Key": "c_custkey",
            "customerName": "c_name",
            "Acct.Bal (USD)": "c_acctbal",
            "Market\r\nSegment": "c_mktsegment",
            "market_segment": "c_nationkey",
        },
    )
    return clean_names(messy)


@query(
    "prj_case_when",
    """
    select o_orderkey, case when o_totalprice >= 300000 then 'large' when o_totalprice > 100000 then 'middle'
        when nullif(o_orderstatus, 'P') = 'F' then 'small closed' else 'small' end as size,
        case when o_orderstatus = 'F' then 'Closed' when o_orderstatus = 'O' then 'Open' end as state
    from orders
    """,
)
def prj_case_when(t):
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    known = F.nullif(status, F.lit("P"))
    size = (
        F.when(price >= 300000, "large")
        .when(price > 100000, "middle")
        .when(known == "F", "small closed")
        .otherwise("small")
    )
    state = F.when(status == "F", "Closed").when(status == "O", "Open")
    return t.orders.select("o_orderkey", size.alias("size"), state.alias("state"))


@query(
    "prj_if_else",
    """
    select c_custkey, case when nullif(c_mktsegment, 'BUILDING') is null then null
        when c_mktsegment = 'MACHINERY' then 'machines' else 'other' end as kind
    from customer
    """,
)
def prj_if_else(t):
    segment = F.nullif("c_mktsegment", F.lit("BUILDING"))
    return t.customer.select(
        "c_custkey", if_else(segment == "MACHINERY", F.lit("machines"), F.lit("other")).alias("kind")
    )


@query(
    "prj_yes_no",
    """
    select o_orderkey, case o_orderstatus when 'F' then true when 'O' then false end as is_closed,
        case o_orderstatus when 'F' then 'Yes' when 'O' then 'No' end as closed_text
    from orders
    """,
)
def prj_yes_no(t):
    flagged = t.orders.select("o_orderkey", yes_no("o_orderstatus", "F", "O").alias("is_closed"))
    return flagged.withColumn("closed_text", yes_no_text("is_closed"))


@query(
    "prj_member_substitute",
    """
    select n_nationkey, case when n_name in ('NATION_1', 'NATION_7') then n_nationkey * 10 else n_regionkey end as rating
    from nation
    """,
)
def prj_member_substitute(t):
    rated = t.nation.withColumn("loss", F.col("n_nationkey") * 10)
    substitute = F.when(is_in("n_name", ["NATION_1", "NATION_7"]), F.col("loss")).otherwise(F.col("n_regionkey"))
    return rated.select("n_nationkey", substitute.alias("rating"))


@query(
    "prj_recode",
    """
    select p_partkey, case p_type when 'ECONOMY' then 'Economy class' when 'PROMO' then 'Promotion'
        when 'STANDARD' then 'Standard class' else p_type end as p_type
    from part
    """,
)
def prj_recode(t):
    names = {"ECONOMY": "Economy class", "PROMO": "Promotion", "STANDARD": "Standard class"}
    return recode(t.part.select("p_partkey", "p_type"), "p_type", names)


@query(
    "prj_fillna",
    """
    select event_id, coalesce(nullif(event_type, 'error'), 'Missing Data') as event_type,
        case when value < 10 then 0 else value end as value
    from events
    """,
)
def prj_fillna(t):
    holes = t.events.select(
        "event_id",
        F.nullif("event_type", F.lit("error")).alias("event_type"),
        F.when(F.col("value") >= 10, F.col("value")).alias("value"),
    )
    return holes.fillna({"event_type": "Missing Data", "value": 0.0})


@query(
    "prj_zero_to_null",
    f"select {LINE}, nullif(l_discount, 0) as l_discount, nullif(l_tax, 0) as l_tax from lineitem",
)
def prj_zero_to_null(t):
    return t.lineitem.withColumns(across(["l_discount", "l_tax"], zero_to_null)).select(*KEYS, "l_discount", "l_tax")


@query(
    "prj_coalesce",
    f"select {LINE}, coalesce(nullif(l_discount, 0), nullif(l_tax, 0), l_quantity) as first_value from lineitem",
)
def prj_coalesce(t):
    value = first_known(zero_to_null("l_discount"), zero_to_null("l_tax"), "l_quantity")
    return t.lineitem.select(*KEYS, value.alias("first_value"))


@query(
    "prj_row_sum",
    f"""
    select {LINE}, l_quantity + l_linenumber as total,
        cast(l_quantity > 4 as int) + cast(l_linenumber > 4 as int) as n_over_four
    from lineitem
    """,
)
def prj_row_sum(t):
    names = ["l_quantity", "l_linenumber"]
    return t.lineitem.select(
        *KEYS, row_sum(names).alias("total"), row_count_if(names, lambda c: c > 4).alias("n_over_four")
    )


@query(
    "prj_impute",
    f"""
    select {LINE}, case when year(l_shipdate) >= 1998 and l_linenumber > 1 and nullif(l_discount, 0) is null
        then l_tax else nullif(l_discount, 0) end as amount
    from lineitem
    """,
)
def prj_impute(t):
    late = (F.year("l_shipdate") >= 1998) & (F.col("l_linenumber") > 1)
    return t.lineitem.select(*KEYS, impute(zero_to_null("l_discount"), late, "l_tax").alias("amount"))


@query(
    "prj_band",
    """
    select o_orderkey,
        case when o_totalprice >= 400000 then 'top' when o_totalprice > 200000 then 'upper'
             when o_totalprice > 50000 then 'lower' else 'none' end as price_band,
        case when month(o_orderdate) < 4 then 'Q1' when month(o_orderdate) < 7 then 'Q2'
             when month(o_orderdate) < 10 then 'Q3' end as quarter_band
    from orders
    """,
)
def prj_band(t):
    price = [(">=", 400000, "top"), (">", 200000, "upper"), (">", 50000, "lower")]
    quarter = [("<", 4, "Q1"), ("<", 7, "Q2"), ("<", 10, "Q3")]
    return t.orders.select(
        "o_orderkey",
        band("o_totalprice", price, "none").alias("price_band"),
        band(F.month("o_orderdate"), quarter).alias("quarter_band"),
    )


@query(
    "prj_score_label",
    f"""
    select {LINE}, case cast(l_quantity < 18 as int) + cast(l_partkey < 1000 as int)
        when 0 then 'neither' when 1 then 'one' else 'both' end as label
    from lineitem
    """,
)
def prj_score_label(t):
    score = row_count_if(["l_quantity"], lambda c: c < 18) + row_count_if(["l_partkey"], lambda c: c < 1000)
    return t.lineitem.select(*KEYS, score_label(score, "neither", "one", "both").alias("label"))


@query(
    "prj_levels",
    """
    select o_orderkey, o_orderpriority, case o_orderpriority when '1-URGENT' then 1 when '2-HIGH' then 2
        when '3-MEDIUM' then 3 when '5-LOW' then 4 end as priority_level
    from orders
    """,
)
def prj_levels(t):
    levels = ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]
    return t.orders.select(
        "o_orderkey", "o_orderpriority", level_rank("o_orderpriority", levels).alias("priority_level")
    )


@query(
    "prj_reorder",
    """
    with s as (select l_returnflag, l_suppkey, sum(l_quantity) as total from lineitem group by all)
    select l_returnflag, l_suppkey, total, dense_rank() over (partition by l_returnflag order by total desc) as place
    from s
    """,
)
def prj_reorder(t):
    totals = t.lineitem.groupBy("l_returnflag", "l_suppkey").agg(F.sum("l_quantity").alias("total"))
    return rank_by(totals, totals, ["l_suppkey"], ["-total"], part=["l_returnflag"], name="place")


@query(
    "prj_fiscal_year",
    """
    select o_orderkey, year(o_orderdate) + month(o_orderdate) - 1 as fy_disbursed from orders
    """,
)
def prj_fiscal_year(t):
    return t.orders.select(
        "o_orderkey", fiscal_year_of(F.year("o_orderdate"), F.month("o_orderdate")).alias("fy_disbursed")
    )


@query(
    "flt_predicates",
    f"""
    select {LINE} from lineitem
    where nullif(l_returnflag, 'N') <> 'R' and (l_quantity > 45 or l_linestatus = 'F') and l_tax > 0
    """,
)
def flt_predicates(t):
    flag = F.nullif("l_returnflag", F.lit("N"))
    kept = t.lineitem.where(
        (flag != "R") & ((F.col("l_quantity") > 45) | (F.col("l_linestatus") == "F")) & (F.col("l_tax") > 0)
    )
    return kept.select(*KEYS)


@query(
    "flt_nulls",
    """
    select d.doc_id, quality is null as is_missing from documents d left join labels l on d.doc_id = l.doc_id
    where quality is null or toxic is not null
    """,
)
def flt_nulls(t):
    joined = left_join_na(t.documents.select("doc_id"), t.labels, "doc_id")
    kept = joined.where(F.col("quality").isNull() | F.col("toxic").isNotNull())
    return kept.select("doc_id", F.col("quality").isNull().alias("is_missing"))


@query("flt_in", "select o_orderkey from orders where o_orderpriority in ('1-URGENT', '3-MEDIUM')")
def flt_in(t):
    return t.orders.where(is_in("o_orderpriority", ["1-URGENT", "3-MEDIUM"])).select("o_orderkey")


@query(
    "flt_not_in_keep_null",
    """
    select event_id, nullif(event_type, 'view') as event_type from events
    where event_type not in ('click', 'error')
    """,
)
def flt_not_in_keep_null(t):
    holes = t.events.select("event_id", F.nullif("event_type", F.lit("view")).alias("event_type"))
    return holes.where(not_in("event_type", ["click", "error"]))


@query("flt_regex", "select p_partkey, p_name from part where regexp_matches(p_name, '^(blue|red) [a-c]')")
def flt_regex(t):
    return t.part.where(detect("p_name", "^(blue|red) [a-c]")).select("p_partkey", "p_name")


@query(
    "flt_dropna",
    "select d.doc_id, lang, quality, toxic from documents d join labels l on d.doc_id = l.doc_id",
)
def flt_dropna(t):
    return left_join_na(t.documents.select("doc_id", "lang"), t.labels, "doc_id").dropna("any")
