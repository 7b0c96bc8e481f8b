"""From raw documents to a training order, in five stages.

Each stage takes all documents that the one before it kept, and its result is written before the next one reads it. All
stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from colwright.llm import decontaminate, jaccard, language, mixing, secrets
from colwright.llm.common import small_batches, table
from colwright.storage import cut_lineage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the language models reject, and those without letters. The model learns from all labelled rows."""
    small_batches(spark)
    model = language.train(docs, "lang", "text")
    limits = language.calibrate(model, docs, "lang", "text") if model else []
    *_, rejected = language.identify(model, limits)
    return docs.withColumn("__rejected", rejected).filter(~F.col("__rejected")).drop("__rejected")


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest id."""
    small_batches(spark)
    return jaccard.one_per_group(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that share a passage with the benchmark."""
    small_batches(spark)
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts by their kind; all documents stay."""
    small_batches(spark)
    masked = secrets.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training order: one row per document and pass that the mix takes, by position."""
    assigned = mixing.assign(docs, carry=("lang",))
    order = mixing.training_order(assigned.withColumnRenamed("__carry_0", "lang"))
    return order.select("position", "pass", "doc_id", "lang", "source", "words")


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", join_near_duplicates),
    ("decontaminate", remove_contaminated),
    ("secrets", mask_secrets),
    ("mix", mix_sources),
]

#: Language models and the masking of texts are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return docs
