"""Survey estimates."""

from pyspark.sql import functions as F

from granary.catalog.registry import query
from granary.operators.survey import Design, margin_band, moe_shares, survey_total, two_step_threshold, with_moe

N_REPS = 80
DESIGN = Design("l_quantity", tuple(f"repwt{r}" for r in range(1, N_REPS + 1)))
GROUPS = ["l_suppkey", "l_returnflag"]


def weighted(t):
    """Line items with replicate weights near the base weight."""
    seed = ((F.col("l_orderkey") * 31 + F.col("l_linenumber") * 17) % 11).cast("int")
    # eleven different weights, of which each replicate takes one
    steps = F.array(*[F.col("l_quantity") * (1 + (i - 5) / 100) for i in range(11)])
    based = t.lineitem.withColumns({"_seed": seed, "_steps": steps})
    weights = [F.get("_steps", (F.col("_seed") + r * 7 % 11) % 11).alias(f"repwt{r}") for r in range(1, N_REPS + 1)]
    return based.select(*t.lineitem.columns, *weights)


def total_sql(by: str, source: str = "lineitem", name: str = "estimate") -> str:
    """Replicate totals written out, one sum per replicate."""
    weight = "l_quantity * (1 + ((l_orderkey * 31 + l_linenumber * 17 + {r} * 7) % 11 - 5) / 100e0)"
    squares = " + ".join(
        f"power(sum({weight.format(r=r)}) - sum(l_quantity), 2)" for r in range(1, N_REPS + 1)
    )
    return f"""
    select {by}, sum(l_quantity) as {name}, sqrt(0.05e0 * ({squares})) as {name}_se, count(*) as n
    from {source} group by {by}
    """


def total(t):
    return survey_total(weighted(t), GROUPS, DESIGN)


@query(
    "svy_total_se",
    f"select l_suppkey, l_returnflag, estimate, round(estimate_se, 5) as estimate_se, n from ({total_sql('l_suppkey, l_returnflag')})",
)
def svy_total_se(t):
    return total(t).withColumn("estimate_se", F.round("estimate_se", 5))


@query(
    "svy_moe",
    f"""
    select l_suppkey, l_returnflag, round(estimate_se * 1.645e0, 4) as estimate_moe,
           round(estimate_se * 1.645e0 / estimate, 8) as estimate_moe_rel from ({total_sql('l_suppkey, l_returnflag')})
    """,
)
def svy_moe(t):
    return with_moe(total(t)).select(
        *GROUPS, F.round("estimate_moe", 4).alias("estimate_moe"), F.round("estimate_moe_rel", 8).alias("estimate_moe_rel")
    )


@query(
    "svy_moe_shares",
    f"""
    select round(avg(cast(estimate_se * 1.645e0 / estimate > 0.008e0 as int)), 9) as over_low,
           round(avg(cast(estimate_se * 1.645e0 / estimate > 0.01e0 as int)), 9) as over_high
    from ({total_sql('l_suppkey, l_returnflag')})
    """,
)
def svy_moe_shares(t):
    shares = moe_shares(with_moe(total(t)), "estimate_moe_rel", {"over_low": 0.008, "over_high": 0.01})
    return shares.select(F.round("over_low", 9).alias("over_low"), F.round("over_high", 9).alias("over_high"))


@query(
    "svy_band",
    """
    with s as (select c_custkey, (c_custkey % 101) / 100e0 as mid, cast(floor(abs(c_acctbal)) as bigint) % 31 / 100e0 as moe from customer)
    select c_custkey, round(greatest(mid - moe, 0), 9) as low, round(least(mid + moe, 1), 9) as high,
           case when mid <> 0 then round(moe / mid, 9) end as relative
    from s
    """,
)
def svy_band(t):
    shares = t.customer.select(
        "c_custkey",
        ((F.col("c_custkey") % 101) / 100).alias("mid"),
        (F.floor(F.abs("c_acctbal")) % 31 / 100).alias("moe"),
    )
    return shares.select("c_custkey", *[F.round(c, 9).alias(n) for n, c in margin_band("mid", "moe").items()])


@query(
    "svy_two_step_threshold",
    """
    with p as (select o_orderpriority, quantile_cont(o_totalprice, 0.75) as p75 from orders group by 1),
    r as (select o.*, p75, o_totalprice / (1 + o_custkey) as rel from orders o join p using (o_orderpriority)),
    q as (select o_orderpriority, quantile_cont(rel, 0.25) as p25 from r where o_totalprice > p75 group by 1)
    select o_orderkey, r.o_orderpriority, o_totalprice from r join q using (o_orderpriority)
    where o_totalprice >= p75 and rel <= p25
    """,
)
def svy_two_step_threshold(t):
    rows = t.orders.select(
        "o_orderkey", "o_orderpriority", "o_totalprice", (F.col("o_totalprice") / (1 + F.col("o_custkey"))).alias("rel")
    )
    kept = two_step_threshold(rows, "o_orderpriority", "o_totalprice", "rel")
    return kept.select("o_orderkey", "o_orderpriority", "o_totalprice")
