"""Reshaping: long, wide, split columns, multi-row headers, transpose."""

from pyspark.sql import functions as F

from granary.catalog.projection import KEYS, LINE
from granary.catalog.registry import query
from granary.functions import replace_first
from granary.operators.reshape import (
    pivot_longer,
    pivot_wider,
    pivot_wider_unique,
    split_columns,
    tidy_multi_header,
    transpose,
)
from granary.sources.literals import literal_table


@query(
    "rsh_longer",
    f"""
    select {LINE}, 'l_discount' as name, nullif(l_discount, 0) as value from lineitem
    union all select {LINE}, 'l_tax', nullif(l_tax, 0) from lineitem
    """,
)
def rsh_longer(t):
    wide = t.lineitem.select(
        *KEYS, F.nullif("l_discount", F.lit(0)).alias("l_discount"), F.nullif("l_tax", F.lit(0)).alias("l_tax")
    )
    return pivot_longer(wide, ["l_discount", "l_tax"])


@query(
    "rsh_longer_pattern",
    f"""
    select {LINE}, 'hs' as program_type, l_quantity as slots from lineitem
    union all select {LINE}, 'ehs', l_extendedprice from lineitem
    """,
)
def rsh_longer_pattern(t):
    wide = t.lineitem.select(*KEYS, F.col("l_quantity").alias("hs_slots"), F.col("l_extendedprice").alias("ehs_slots"))
    long = pivot_longer(wide, ["hs_slots", "ehs_slots"], "program_type", "slots")
    return long.withColumn("program_type", replace_first("program_type", "_slots$", ""))


@query(
    "rsh_wider_agg",
    """
    select o_custkey, round(coalesce(sum(o_totalprice) filter (o_orderstatus = 'F'), 0), 4) as f_slots,
           round(coalesce(sum(o_totalprice) filter (o_orderstatus = 'O'), 0), 4) as o_slots,
           round(coalesce(sum(o_totalprice) filter (o_orderstatus = 'P'), 0), 4) as p_slots
    from orders group by 1
    """,
)
def rsh_wider_agg(t):
    rows = t.orders.select("o_custkey", F.lower("o_orderstatus").alias("type"), "o_totalprice")
    wide = pivot_wider(rows, ["o_custkey"], "type", "o_totalprice", ["f", "o", "p"], F.sum, 0.0, "{name}_slots")
    return wide.select("o_custkey", *[F.round(c, 4).alias(c) for c in ("f_slots", "o_slots", "p_slots")])


@query(
    "rsh_wider",
    """
    select l_orderkey, max(q) filter (f = 'A') as amt_A, max(q) filter (f = 'N') as amt_N, max(q) filter (f = 'R') as amt_R
    from (select l_orderkey, l_returnflag as f, sum(l_quantity) as q from lineitem group by 1, 2) group by 1
    """,
)
def rsh_wider(t):
    cells = t.lineitem.groupBy("l_orderkey", "l_returnflag").agg(F.sum("l_quantity").alias("q"))
    return pivot_wider_unique(cells, ["l_orderkey"], "l_returnflag", "q", ["A", "N", "R"], "amt_{name}")


@query(
    "rsh_split_cols",
    """
    select p_partkey, split_part(p_name, ' ', 1) as colour, split_part(p_name, ' ', 2) as thing from part
    """,
)
def rsh_split_cols(t):
    return split_columns(t.part.select("p_partkey", "p_name"), "p_name", ["colour", "thing"], " ")


def header_cells():
    """Names, and the three header rows, of (flag, status) x (quantity, rows)."""
    names, top, middle, bottom = [], [], [], []
    for i, flag in enumerate("ANR"):
        for j, status in enumerate("FO"):
            for k, metric in enumerate(["quantity", "rows"]):
                names.append(f"x{len(names) + 1}")
                # merged cells: only the first column of a run has the text
                top.append(flag if j == 0 and k == 0 else None)
                middle.append(status if k == 0 else None)
                bottom.append(metric)
    return names, [top, middle, bottom]


@query(
    "rsh_multi_header",
    """
    select cast(p as varchar) as supplier, flag, status, quantity, rows from
    (select l_suppkey as p, f as flag, s as status from (select distinct l_suppkey from lineitem),
        (values ('A'), ('N'), ('R')) as a(f), (values ('F'), ('O')) as b(s))
    left join (select l_suppkey, l_returnflag, l_linestatus, cast(cast(sum(l_quantity) as bigint) as varchar) as quantity,
               cast(count(*) as varchar) as rows from lineitem group by 1, 2, 3)
    on p = l_suppkey and flag = l_returnflag and status = l_linestatus
    """,
)
def rsh_multi_header(t):
    names, header = header_cells()
    cells = []
    for n, (flag, status, metric) in zip(names, [(f, s, m) for f in "ANR" for s in "FO" for m in ("quantity", "rows")]):
        here = (F.col("l_returnflag") == flag) & (F.col("l_linestatus") == status)
        value = F.sum(F.when(here, F.col("l_quantity"))) if metric == "quantity" else F.nullif(F.count_if(here), F.lit(0))
        cells.append(value.cast("bigint").cast("string").alias(n))
    body = t.lineitem.groupBy(F.col("l_suppkey").cast("string").alias("supplier")).agg(*cells)
    top = literal_table(
        t.spark,
        [(i + 1, "Grant Number" if i == 2 else None, *row) for i, row in enumerate(header)],
        [("row", "int"), ("supplier", "string"), *[(n, "string") for n in names]],
    )
    sheet = top.unionByName(body.withColumn("row", F.lit(4)))
    return tidy_multi_header(sheet, "row", 3, ["supplier"], names, ["flag", "status", "metric"], ["quantity", "rows"])


@query(
    "rsh_transpose",
    """
    select 'n' as metric, count(*) filter (o_orderstatus = 'F')::double as F, count(*) filter (o_orderstatus = 'O')::double as O,
           count(*) filter (o_orderstatus = 'P')::double as P from orders
    union all select 'n_grantees', count(distinct o_custkey) filter (o_orderstatus = 'F'),
           count(distinct o_custkey) filter (o_orderstatus = 'O'), count(distinct o_custkey) filter (o_orderstatus = 'P') from orders
    """,
)
def rsh_transpose(t):
    summary = t.orders.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("n_grantees")
    )
    return transpose(summary, "o_orderstatus", ["F", "O", "P"], ["n", "n_grantees"])
