"""From raw documents to packed training sequences, in stages that can be run one by one.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, to be written as Parquet and read again as the
next one's ``docs``. All but the last return the columns of ``documents``.

Every stage takes NULLs in any column, empty and very long texts, ties, repeated rows, an empty table and further
columns; what it does with them is said at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import decontaminate, near_dups, packing, quality, secrets
from granary.llm.common import crc_mod, prepare
from granary.session import cut_lineage


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Decided row by row on the whole text: a NULL or empty text has the features of a text without words, repeated rows
    share their fate, a missing id does not matter. Without labels of both kinds every row has the one score.
    """
    labels = prepare(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.train(docs, labels, crc_mod("doc_id", 5) != 0))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is alike on shingles of five words: that of the smallest id.

    Texts without words, NULL texts and rows without an id are alike with nothing and stay; of rows with the same id
    one stays, the smallest text.
    """
    prepare(spark)
    return near_dups.drop_near_duplicates(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage.

    NULL and empty texts have none and stay, as does everything where the benchmark is empty; repeated rows share
    their fate; a long text is searched to its end.
    """
    return decontaminate.drop_contaminated(docs, prepare(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark; ``n_chars`` follows the text.

    NULL and empty texts stay as they are, and repeated rows stay repeated.
    """
    prepare(spark)
    clean = secrets.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of several lengths that hold all tokens of all documents.

    NULL and empty texts have no tokens; repeated rows are packed again; a text longer than a sequence is cut into
    several.
    """
    prepare(spark)
    return packing.packed(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack),
]

# the classifier and the near-duplicate search are no SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what each returns is written to the shared folder and read again."""
    out = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, out, sf_dir)
        if k + 1 < len(STAGES):
            out = cut_lineage(out)
    return out
