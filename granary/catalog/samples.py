"""Samples."""

from pyspark.sql import functions as F

from granary.catalog.registry import query
from granary.operators.sampling import (
    random_rows,
    rows_of_sample,
    sample_balance,
    strata_sizes,
    stratified_sample,
)

SEED = 20230803

SAMPLE_SQL = f"""
    sizes as (select lang, count(*) as n, count(*) / sum(count(*)) over () as pct,
              cast(ceil(count(*) / sum(count(*)) over () * 400) as bigint) as n_sample from documents group by 1),
    drawn as (
        select doc_id, lang, n_sample from
        (select doc_id, d.lang, n_sample, row_number() over (partition by d.lang order by md5(doc_id || '|{SEED}'), doc_id) as r
         from documents d join sizes s on d.lang = s.lang) where r <= n_sample
    )
"""


def drawn(t):
    return stratified_sample(t.documents.select("doc_id", "lang"), "lang", "doc_id", 400, SEED)


@query("smp_stratified", f"with {SAMPLE_SQL} select * from drawn")
def smp_stratified(t):
    return drawn(t).select("doc_id", "lang", "n_sample")


@query(
    "smp_balance",
    f"""
    with {SAMPLE_SQL},
    s as (select lang, count(*) / sum(count(*)) over () as pct_sample from drawn group by 1)
    select lang, round(pct_sample, 9) as pct_sample, round(pct, 9) as pct_population, round(pct_sample - pct, 9) as pct_diff
    from s join sizes using (lang)
    """,
)
def smp_balance(t):
    sizes = strata_sizes(t.documents, "lang", 400)
    balance = sample_balance(drawn(t), sizes, "lang")
    return balance.select("lang", *[F.round(c, 9).alias(c) for c in ("pct_sample", "pct_population", "pct_diff")])


@query(
    "smp_random",
    f"select c_custkey, c_name from customer order by md5(c_custkey || '|{SEED}'), c_custkey limit 10",
)
def smp_random(t):
    return random_rows(t.customer.select("c_custkey", "c_name"), "c_custkey", 10, SEED)


@query(
    "smp_rows",
    f"""
    select o_orderkey, o_custkey from orders where o_totalprice < 200000 and o_custkey in
    (select c_custkey from customer order by md5(c_custkey || '|{SEED}'), c_custkey limit 100)
    """,
)
def smp_rows(t):
    sample = random_rows(t.customer.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", 100, SEED)
    orders = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    rows = rows_of_sample(orders, sample, "o_custkey", F.col("o_totalprice") < 200000)
    return rows.select("o_orderkey", "o_custkey")
