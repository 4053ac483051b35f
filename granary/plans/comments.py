"""Comments: topics by region and status, and a sample for manual coding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import not_in
from granary.operators.aggregate import count_by_group
from granary.operators.joins import left_join_na
from granary.operators.sampling import rows_of_sample, sample_balance, strata_sizes, stratified_sample
from granary.operators.topics import ROUNDS, beta, document_terms, fit_topics, gamma, mean_by_group, top_terms, topic_map

# Regions left out of the sample.
EXCLUDED_REGIONS = ["Totals", "12", "13"]


def comment_topics(
    comments: DataFrame, id: str, text: str, by: Sequence[str], k: int = 6, seed: int = 1234,
    stopwords: DataFrame | None = None, rounds: int = ROUNDS,
) -> dict[str, DataFrame]:
    """Topic model of comments: terms, mixes, map, top terms, means by group."""
    texts, terms = fit_topics(document_terms(comments, id, text, stopwords), id, [k], seed, rounds)
    betas, gammas = beta(terms, [k]).drop("k"), gamma(texts, id, [k]).drop("k")
    return {
        "beta": betas,
        "gamma": gammas,
        "map": topic_map(comments, id, text, gammas, k),
        "top_terms": top_terms(betas, "topic", "beta", 10),
        **{f"by_{g}": mean_by_group(comments, id, g, gammas) for g in by},
    }


def grant_sample(grants: DataFrame, n: int = 400, seed: int = 20230803, excluded: Sequence[str] = EXCLUDED_REGIONS) -> DataFrame:
    return stratified_sample(grants.where(not_in("region", excluded)), "region", "grant_id", n, seed)


def grant_sample_balance(grants: DataFrame, sample: DataFrame, n: int = 400, excluded: Sequence[str] = EXCLUDED_REGIONS) -> DataFrame:
    sizes = strata_sizes(grants.where(not_in("region", excluded)), "region", n)
    return sample_balance(sample, sizes, "region")


def comment_sample(comments: DataFrame, sample: DataFrame, under_enrolled: Column | None = None) -> DataFrame:
    """Comments of sampled grants in months with fewer reported than funded, by region, grant and month.

    The region is the grant's, from the sample; ``comments`` needs none.
    """
    if under_enrolled is None:
        under_enrolled = F.col("slots_pct_reported_over_funded") < 1
    regions = sample.select("grant_id", "region").dropDuplicates(["grant_id"])
    kept = left_join_na(rows_of_sample(comments.drop("region"), sample, "grant_id", under_enrolled), regions, "grant_id")
    return kept.orderBy(F.asc_nulls_last("region"), F.asc_nulls_last("grant_id"), F.asc_nulls_last("report_month"))


def sample_by_region(sample: DataFrame) -> DataFrame:
    """Comments of the sample and their share, per region."""
    return count_by_group(sample, "region")
