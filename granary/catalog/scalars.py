"""Scalar functions on text, dates, numbers and JSON."""

from pyspark.sql import functions as F

from granary.catalog.projection import KEYS, LINE
from granary.catalog.registry import query
from granary.functions import (
    clamp,
    detect,
    extract,
    half_even,
    in_months_after,
    inclusive_months,
    known,
    parse_date,
    paste,
    ratio,
    replace_all,
    replace_first,
    right,
    title,
    to_number,
)
from granary.operators.columns import split_suffix_type
from granary.operators.joins import left_join_na
from granary.plans.disbursement import program_of_number


@query("str_replace_first", "select p_partkey, regexp_replace(p_name, '[aeiou]', '_') as name from part")
def str_replace_first(t):
    return t.part.select("p_partkey", replace_first("p_name", "[aeiou]", "_").alias("name"))


@query(
    "str_replace_all",
    "select doc_id, regexp_replace(text, '[#\\(\\)]+', '', 'g') as text from documents",
)
def str_replace_all(t):
    return t.documents.select("doc_id", replace_all("text", r"[#\(\)]+", "").alias("text"))


@query(
    "str_detect",
    "select p_partkey, contains(p_name, 'ring') as is_ring, regexp_matches(p_brand, '#1[0-9]$') as is_teen from part",
)
def str_detect(t):
    return t.part.select(
        "p_partkey", F.col("p_name").contains("ring").alias("is_ring"), detect("p_brand", "#1[[:digit:]]$").alias("is_teen")
    )


@query(
    "str_extract",
    """
    select p_partkey, regexp_extract(p_brand, '[0-9]+') as number, regexp_extract(p_brand, '\\p{L}+') as word,
           nullif(regexp_extract(p_brand, '2[0-9]'), '') as twenties
    from part
    """,
)
def str_extract(t):
    return t.part.select(
        "p_partkey",
        extract("p_brand", "[[:digit:]]+").alias("number"),
        extract("p_brand", "[[:alpha:]]+").alias("word"),
        extract("p_brand", "2[[:digit:]]").alias("twenties"),
    )


@query("str_right", "select c_custkey, right(c_name, 2) as last_two, right(c_name, 1) as last_one from customer")
def str_right(t):
    return t.customer.select("c_custkey", right("c_name", 2).alias("last_two"), right("c_name", 1).alias("last_one"))


@query(
    "str_case_trim",
    """
    select p_partkey, lower(p_brand) as brand, trim('  ' || p_type || ' ') as type,
           upper(left(split_part(p_name, ' ', 1), 1)) || lower(substr(split_part(p_name, ' ', 1), 2)) || ' ' ||
           upper(left(split_part(p_name, ' ', 2), 1)) || lower(substr(split_part(p_name, ' ', 2), 2)) as name
    from part
    """,
)
def str_case_trim(t):
    padded = F.concat(F.lit("  "), "p_type", F.lit(" "))
    return t.part.select(
        "p_partkey", F.lower("p_brand").alias("brand"), F.trim(padded).alias("type"), title("p_name").alias("name")
    )


@query(
    "str_paste",
    """
    select c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'NA') || '-' || n_name as code,
           nullif(c_mktsegment, 'BUILDING') || '-' || n_name as code_or_null
    from customer join nation on c_nationkey = n_nationkey
    """,
)
def str_paste(t):
    joined = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    segment = F.nullif("c_mktsegment", F.lit("BUILDING"))
    return joined.select(
        "c_custkey",
        paste(segment, "n_name", sep="-").alias("code"),
        paste(segment, "n_name", sep="-", na=None).alias("code_or_null"),
    )


@query(
    "str_suffix_type",
    """
    select p_partkey,
        case when p_brand <> 'Brand#1' then 'County' when p_name = 'red ring' then 'Borough'
             when contains(p_name, ' ring') then 'Ring' when contains(p_name, ' bolt') then 'Bolt' end as place_type,
        case when p_name = 'blue bolt' then 'Bolt of Blue' when p_brand = 'Brand#1'
             then regexp_replace(regexp_replace(p_name, ' ring', ''), ' bolt', '') else p_name end as p_name
    from part
    """,
)
def str_suffix_type(t):
    return split_suffix_type(
        t.part.select("p_partkey", "p_name", "p_brand"),
        "p_name",
        [(" ring", "Ring"), (" bolt", "Bolt")],
        "place_type",
        only=F.col("p_brand") == "Brand#1",
        otherwise="County",
        fixed_type={"red ring": "Borough"},
        fixed_name=[(F.col("p_name") == "blue bolt", "Bolt of Blue")],
    ).select("p_partkey", "place_type", "p_name")


@query(
    "str_address",
    """
    select c_custkey, regexp_replace(c_name || ', ' || coalesce(nullif(c_mktsegment, 'BUILDING'), 'NA') || ', ' ||
           coalesce(n_name, 'NA') || ' ' || c_nationkey, '[#\\(\\)]+', '', 'g') as address
    from customer left join nation on c_nationkey = n_nationkey
    """,
)
def str_address(t):
    joined = left_join_na(t.customer, t.nation.select("n_nationkey", "n_name"), {"c_nationkey": "n_nationkey"})
    street = paste("c_name", F.nullif("c_mktsegment", F.lit("BUILDING")), "n_name", sep=", ")
    address = replace_all(paste(street, "c_nationkey", sep=" "), r"[#\(\)]+", "")
    return joined.select("c_custkey", address.alias("address"))


@query(
    "str_prefix_code",
    """
    select p_partkey, case when contains(p_brand, '#1') then 'SEDS' when contains(p_brand, '#2') then 'EMI' end as program
    from part
    """,
)
def str_prefix_code(t):
    return t.part.select("p_partkey", program_of_number("p_brand", {"#1": "SEDS", "#2": "EMI"}).alias("program"))


@query(
    "dt_parse",
    """
    select o_orderkey, date_trunc('month', o_orderdate)::date as month, o_orderdate::date as day, null::date as bad
    from orders
    """,
)
def dt_parse(t):
    return t.orders.select(
        "o_orderkey",
        parse_date(F.date_format("o_orderdate", "MMM yyyy"), "yyyy-MM-dd", "MMM yyyy").alias("month"),
        parse_date(F.date_format("o_orderdate", "yyyy-MM-dd"), "yyyy-MM-dd", "MMM yyyy").alias("day"),
        parse_date(F.col("o_orderpriority"), "yyyy-MM-dd", "MMM yyyy").alias("bad"),
    )


@query(
    "dt_month_count",
    """
    select o_custkey, cast(date_diff('month', date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate))) + 1 as int) as n_months
    from orders group by 1
    """,
)
def dt_month_count(t):
    spans = t.orders.groupBy("o_custkey").agg(
        F.trunc(F.min(F.to_date("o_orderdate")), "MM").alias("first"),
        F.trunc(F.max(F.to_date("o_orderdate")), "MM").alias("last"),
    )
    return spans.select("o_custkey", inclusive_months("first", "last").alias("n_months"))


@query(
    "dt_within_12m",
    """
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderdate::date + interval 3 month <= l_shipdate as is_late,
           l_shipdate >= o_orderdate and l_shipdate < o_orderdate + interval 1 month as is_within_month
    from lineitem join orders on l_orderkey = o_orderkey
    """,
)
def dt_within_12m(t):
    joined = t.lineitem.join(
        t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("ordered")), F.col("l_orderkey") == F.col("o_orderkey")
    ).withColumn("shipped", F.to_date("l_shipdate"))
    return joined.select(
        *KEYS,
        (F.add_months("ordered", 3) <= F.col("shipped")).alias("is_late"),
        in_months_after("shipped", "ordered", 1).alias("is_within_month"),
    )


@query("dt_cutoff", f"select {LINE} from lineitem where l_shipdate <= date '1998-09-30'")
def dt_cutoff(t):
    return t.lineitem.where(F.col("l_shipdate") <= F.lit("1998-09-30").cast("date")).select(*KEYS)


@query(
    "mth_clamp",
    """
    select c_custkey, case when c_acctbal <> 73 then least(greatest(c_acctbal, 0), 1000) end as clamped,
           case when c_acctbal < 5000 then null else greatest(c_acctbal, 6000) end as guarded
    from customer
    """,
)
def mth_clamp(t):
    balance = F.nullif("c_acctbal", F.lit(73.0))
    rich = F.when(F.col("c_acctbal") >= 5000, F.col("c_acctbal"))
    return t.customer.select(
        "c_custkey", clamp(balance, 0.0, 1000.0).alias("clamped"), clamp(rich, low=6000.0).alias("guarded")
    )


@query(
    "mth_ratio",
    f"""
    select {LINE}, l_tax / l_discount as ratio,
        case when isnan(l_tax / l_discount) then null else l_tax / l_discount > 1 end as is_over
    from lineitem
    """,
)
def mth_ratio(t):
    share = t.lineitem.withColumn("ratio", ratio("l_tax", "l_discount"))
    return share.select(*KEYS, "ratio", (known("ratio") > 1).alias("is_over"))


@query(
    "mth_round",
    f"""
    select {LINE}, cast(ceil(l_extendedprice / 1000) as bigint) as thousands, round_even(l_quantity / 2, 0) as half
    from lineitem
    """,
)
def mth_round(t):
    return t.lineitem.select(
        *KEYS, F.ceil(F.col("l_extendedprice") / 1000).alias("thousands"), half_even(F.col("l_quantity") / 2).alias("half")
    )


@query(
    "mth_try_cast",
    """
    select p_partkey, try_cast(p_type as double) as type_number, try_cast(regexp_extract(p_brand, '[0-9]+') as double) as brand_number
    from part
    """,
)
def mth_try_cast(t):
    return t.part.select(
        "p_partkey",
        to_number("p_type").alias("type_number"),
        to_number(extract("p_brand", "[[:digit:]]+")).alias("brand_number"),
    )


@query(
    "jsn_path",
    """
    select event_id, json_extract_string(props, '$.k') as k,
           json_extract_string(json_object('result', json_object('Census Tracts', json_array(json_object('GEOID', event_id)))),
                               '$.result."Census Tracts"[0].GEOID') as geoid,
           json_extract_string(props, '$.missing') as absent
    from events
    """,
)
def jsn_path(t):
    body = F.concat(F.lit('{"result": {"Census Tracts": [{"GEOID": '), F.col("event_id"), F.lit("}]}}"))
    return t.events.select(
        "event_id",
        F.get_json_object("props", "$.k").alias("k"),
        F.get_json_object(body, "$.result['Census Tracts'][0].GEOID").alias("geoid"),
        F.get_json_object("props", "$.missing").alias("absent"),
    )
