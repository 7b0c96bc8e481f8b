"""Exact token counts of a corpus from one histogram of encoded lengths.

Documents are encoded once, with a public vocabulary; what leaves the tasks is the number of documents per length. All
answers come from sums over that histogram: ``n`` documents of length ``l`` hold ``n * l`` tokens, and cut at a context
limit ``c`` they hold ``sum of n * l below c`` plus ``c`` times the number of documents from ``c`` on, a suffix sum.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from colwright.llm.common import slices
from colwright.storage import cut_lineage

#: Where the vocabulary lies; any file of "base64 rank" lines will do.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published split pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Lengths per block of the running sums.
BLOCK_LENGTHS = 1024


def read_vocabulary(spark: SparkSession, path: str) -> bytes:
    """The file's bytes, read with Spark, so that any store will do; a vocabulary is a few MB, whatever the corpus."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def encoder(vocabulary: bytes, pattern: str = PATTERN):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def with_lengths(df: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """One column ``length``: tokens of each row's whole text; 0 for NULL and empty texts."""
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(df.sparkSession, vocabulary))

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared.value, pattern).encode_ordinary
        for batch in slices(batches):
            counts = [len(encode(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(counts, pa.int64())], names=["length"])

    return df.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(lengths, "length bigint")


def length_histogram(df: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """Documents per encoded length: (length, n_docs). Counts are summed in the tasks before they move."""
    return with_lengths(df, text_col, vocabulary, pattern).groupBy("length").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(histogram: DataFrame, block: int = BLOCK_LENGTHS) -> DataFrame:
    """Per length of the histogram: documents and tokens from there on, up to there, and the total cut at that length.

    Sums run inside blocks of lengths; the totals of the blocks, one row each, give what lies before and after.
    """
    own = histogram.withColumn("block", F.floor(F.col("length") / block)).withColumn("n_tokens", F.col("n_docs") * F.col("length"))
    own = cut_lineage(own, "histogram")
    per_block = own.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = per_block.select(
        "block",
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("docs", "tokens")],
        *[F.sum(c).over(every).alias(f"{c}_all") for c in ("docs", "tokens")],
    )
    inside = Window.partitionBy("block").orderBy("length")
    upto = own.withColumns({c: F.sum(f"n_{c}").over(inside) for c in ("docs", "tokens")}).join(offsets, "block")
    docs, tokens = F.col("docs_before") + F.col("docs"), F.col("tokens_before") + F.col("tokens")
    docs_from = F.col("docs_all") - docs + F.col("n_docs")
    return upto.select(
        "length",
        "n_docs",
        docs.alias("docs_upto"),
        tokens.alias("tokens_upto"),
        docs_from.alias("docs_from"),
        (F.col("tokens_all") - tokens + F.col("n_tokens")).alias("tokens_from"),
        (tokens - F.col("n_tokens") + docs_from * F.col("length")).alias("tokens_cut_here"),
        (docs / F.col("docs_all")).alias("share_upto"),
    )


def truncated_totals(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """Tokens that remain if every document is cut at ``limit``, for any limits, with the documents that lose some."""
    limits = sorted({int(x) for x in limits})
    n, l = F.col("n_docs"), F.col("length")
    # one pass with one pair of sums per limit: the lengths below it count in full, the rest as the limit
    kept = [F.sum(n * F.least(l, F.lit(c))).alias(f"kept_{c}") for c in limits]
    cut = [F.sum(F.when(l > c, n).otherwise(0)).alias(f"cut_{c}") for c in limits]
    rows = [F.struct(F.lit(c).alias("limit"), F.col(f"kept_{c}").alias("tokens"), F.col(f"cut_{c}").alias("docs_cut")) for c in limits]
    return sums.agg(*kept, *cut).select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def quantiles(sums: DataFrame, shares: Sequence[float]) -> DataFrame:
    """The least length that at least the given share of documents do not exceed."""
    wanted = [F.min(F.when(F.col("share_upto") >= q, F.col("length"))).alias(f"q{i}") for i, q in enumerate(shares)]
    one = sums.agg(*wanted)
    return one.select(F.explode(F.array(*[F.struct(F.lit(float(q)).alias("share"), F.col(f"q{i}").alias("length")) for i, q in enumerate(shares)])).alias("x")).select("x.*")
