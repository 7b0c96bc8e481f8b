"""Registered queries of the corpus operators, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from colwright.llm import (
    decontaminate,
    jaccard,
    language,
    main_text,
    manifest,
    mixing,
    neighbours,
    periodic,
    secrets,
    simhash,
    substring,
    token_counts,
    toxicity,
)
from colwright.llm.common import crc_fold, small_batches, table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; documents are the repositories, sources their owners."""
    return secrets.summary(secrets.graded_spans(table(spark, sf_dir, "documents")))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two of three folds."""
    docs = table(spark, sf_dir, "documents")
    fold = crc_fold(F.col("doc_id"), 3)
    learned = docs.filter(fold != 1)
    model = language.train(learned, "lang", "text")
    limits = language.calibrate(model, learned, "lang", "text") if model else []
    slim = docs.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "text")
    return slim.select("doc_id", "held_out", *language.identify(model, limits))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of every document without long sequences that a smaller id has."""
    cleaned = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest vectors of every fiftieth."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from three of four folds."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = crc_fold(F.col("doc_id"), 4)
    weights, bias = toxicity.train(docs.filter(fold != 2), labels.filter(fold != 2))
    scored = docs.select(
        "doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), toxicity.scored(docs, weights, bias).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the curriculum takes of every document."""
    return mixing.mix_summary(mixing.assign(table(spark, sf_dir, "documents")))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return main_text.extract(table(spark, sf_dir, "pages"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document."""
    rows, spans = decontaminate.shared_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.contamination(rows, spans)


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near duplicates among all documents."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals of the corpus for every length that occurs, as context limit."""
    return token_counts.suffix_sums(token_counts.length_histogram(table(spark, sf_dir, "documents")))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents with near fingerprints."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents; of every other id the line breaks of the text are deleted before its proof is folded."""
    even = crc_fold(F.col("doc_id"), 2) == 0
    return manifest.document_manifest(table(spark, sf_dir, "documents"), F.when(even, F.replace("text", F.lit("\n"), F.lit(""))))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document; of every tenth the end is overwritten with a repeated part."""
    code = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return periodic.run_digests(periodic.periodic_runs(table(spark, sf_dir, "documents"), code=code, arrange=periodic.periodic_tail))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline, one after the other."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _over_texts(query):
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return query(spark, sf_dir)

    return run


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_secret_scan, op2_language_id, op3_substring_dedup, op4_nearest_neighbours, op5_toxicity, op6_source_mix,
        op7_main_text, op8_decontaminate, op9_ngram_jaccard, op10_token_counts, op11_simhash, op12_manifest,
        op13_periodic_runs, pipeline,
    )
    return {f.__name__: _over_texts(f) for f in ops}


def all_sql() -> dict[str, str]:
    return {"op6_source_mix": mixing.SQL, "op12_manifest": manifest.SQL}
