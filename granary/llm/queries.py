"""Registered queries of this package, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from granary.llm import decontaminate, html_text, language, line_rules, lm, near_dups, packing, prefix_trie, quality, secrets, spelling, substrings, toxicity
from granary.llm.common import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark, folder):
            return fn(prepare(spark), folder)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


@query("op1_lm_scores")
def op1(spark, folder):
    return lm.scores(table(spark, folder, "documents"))


@query("op2_packing")
def op2(spark, folder):
    return packing.packed(table(spark, folder, "documents"))


@query("op3_line_rules", line_rules.ORACLE)
def op3(spark, folder):
    return line_rules.line_rules(table(spark, folder, "documents"))


@query("op4_decontamination")
def op4(spark, folder):
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op5_near_dups", near_dups.ORACLE)
def op5(spark, folder):
    return near_dups.near_duplicates(table(spark, folder, "documents"), size=2)


@query("op6_language")
def op6(spark, folder):
    return language.languages(table(spark, folder, "documents"))


@query("op7_substring_dedup", substrings.ORACLE)
def op7(spark, folder):
    return substrings.substring_dedup(table(spark, folder, "documents"))


@query("op8_secret_scan")
def op8(spark, folder):
    return secrets.secret_digest(table(spark, folder, "documents"))


@query("op9_html_text")
def op9(spark, folder):
    return html_text.extract(table(spark, folder, "pages"))


@query("op10_quality")
def op10(spark, folder):
    return quality.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op11_spelling", spelling.ORACLE)
def op11(spark, folder):
    return spelling.spelling_variants(table(spark, folder, "documents"))


@query("op12_prefix_trie", prefix_trie.ORACLE)
def op12(spark, folder):
    return prefix_trie.prefix_trie(table(spark, folder, "conversations"))


@query("op13_toxicity")
def op13(spark, folder):
    return toxicity.toxicity_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))
