"""Network of suppliers (programs) sharing parts (recipients)."""

from pyspark.sql import functions as F

from granary.catalog.registry import query
from granary.operators.network import (
    connected_nodes,
    cooccurrence,
    endpoints,
    heavy_edges,
    incidence,
    isolated_nodes,
    named_pairs,
    weight_quantiles,
)
from granary.session import cut_lineage

PAIRS_SQL = "pairs as (select distinct l_suppkey as item, l_partkey as via from lineitem)"
EDGES_SQL = f"""
    {PAIRS_SQL},
    edges as (select a.item as src, b.item as dst, count(*) as weight from pairs a join pairs b
              on a.via = b.via and a.item < b.item group by 1, 2),
    heavy as (select * from edges where weight >= (select quantile_cont(weight::double, 0.95) from edges)),
    nodes as (select s_suppkey as name from supplier)
"""


def pairs(t):
    return t.lineitem.select(F.col("l_suppkey").alias("item"), F.col("l_partkey").alias("via"))


def nodes(t):
    return t.supplier.select(F.col("s_suppkey").alias("name"))


@query(
    "gph_incidence",
    """
    with i as (select l_suppkey, min_by(s_name, l_orderkey) as item from lineitem join supplier on l_suppkey = s_suppkey group by 1),
         v as (select distinct l_partkey, p_name || ' ' || p_brand as via from lineitem join part on l_partkey = p_partkey)
    select distinct item, via from lineitem join i using (l_suppkey) join v using (l_partkey)
    """,
)
def gph_incidence(t):
    awards = (
        t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t.part, F.col("l_partkey") == F.col("p_partkey"))
        .withColumn("p_title", F.concat_ws(" ", "p_name", "p_brand"))
    )
    return incidence(named_pairs(awards, "l_suppkey", "s_name", "l_partkey", "p_title", ["l_orderkey", "l_linenumber"]))


def edges(t):
    """All edges, made once: their weights give the threshold, then the edges above it are taken."""
    return cut_lineage(cooccurrence(pairs(t)))


@query("gph_cooccurrence", f"with {EDGES_SQL} select * from edges")
def gph_cooccurrence(t):
    return cooccurrence(pairs(t))


@query(
    "gph_weight_quantiles",
    f"with {EDGES_SQL} "
    + " union all ".join(
        f"select {q}::double as q, round(quantile_cont(weight::double, {q}), 6) as x from edges" for q in (0.25, 0.5, 0.75, 0.95)
    ),
)
def gph_weight_quantiles(t):
    return weight_quantiles(cooccurrence(pairs(t))).withColumn("x", F.round("x", 6))


@query(
    "gph_strong_nodes",
    f"with {EDGES_SQL} select count(distinct name) as n from (select src as name from heavy union all select dst from heavy)",
)
def gph_strong_nodes(t):
    return endpoints(heavy_edges(edges(t))).agg(F.count(F.lit(1)).alias("n"))


@query(
    "gph_isolated",
    f"""
    with {EDGES_SQL},
    heaviest as (select * from edges where weight >= (select quantile_cont(weight::double, 0.999) from edges))
    select name from nodes where name not in (select src from heaviest union select dst from heaviest)
    """,
)
def gph_isolated(t):
    return isolated_nodes(nodes(t), heavy_edges(edges(t), 0.999))


@query(
    "gph_subgraph",
    f"""
    with {EDGES_SQL} select name, null::bigint as other, null::bigint as weight from nodes
    where name in (select src from heavy union select dst from heavy)
    union all select src, dst, weight from heavy
    """,
)
def gph_subgraph(t):
    heavy = heavy_edges(edges(t))
    kept = connected_nodes(nodes(t), heavy)
    strong = heavy.select(F.col("src").alias("name"), F.col("dst").alias("other"), "weight")
    return kept.unionByName(strong, allowMissingColumns=True)
