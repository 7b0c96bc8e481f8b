"""Benchmark decontamination by winnowing.

Texts are cut into lower-cased words. Every run of ``k`` words has a hash, and of each ``w = window - k + 1``
neighbouring hashes the least is a fingerprint, so two texts that share ``window`` words share a fingerprint inside them:
no sufficiently long shared span is missed. Benchmark fingerprints are joined with those of the documents, and each hit
is extended word by word to both sides; the extended run counts if it reaches ``window`` words. A benchmark item with
fewer words is one fingerprint of its own length, looked up at every place of a document.

Documents first pass a bit array of fixed size that holds the benchmark's fingerprints, so only likely hits are shuffled,
with the few words around them. The array is the only thing sent to all tasks; a benchmark of any size fits, a fuller
array lets more rows through to the join and changes no result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType

from colwright.llm.common import (
    Words,
    binary_column,
    bit_filter,
    covered,
    gram_hashes,
    letters_and_digits_split,
    passes,
    signed,
    slices,
    to_batch,
    winnow,
    word_batches,
)
from colwright.storage import cut_lineage

WINDOW = 10
GRAM = 8
#: Bits of the filter, as a power of two: 2 MB.
FILTER_BITS = 24

_SHORT = np.uint64(0x5851F42D4C957F2D)
_HIT = pa.struct([("print", pa.int64()), ("place", pa.int32()), ("words", pa.list_(pa.binary())), ("at", pa.int32())])
_HIT_DDL = "array<struct<print:bigint,place:int,words:array<binary>,at:int>>"


def fingerprints(words: Words, window: int, gram: int, short: tuple[int, ...]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(words a match needs, words per print, prints, places): the winnowed k-grams, and all runs of the shorter lengths."""
    text = words.text_of()
    grams = gram_hashes(words.hashes, gram)
    places = winnow(grams, window - gram + 1)
    places = np.unique(places[text[: len(places)] == text[window - 1 :][: len(places)]])
    yield window, gram, grams[places], places
    for n in short:
        whole = gram_hashes(words.hashes, n) ^ _SHORT  # apart from k-grams of that length
        places = np.flatnonzero(text[: len(whole)] == text[n - 1 :][: len(whole)])
        yield n, n, whole[places], places


def _around(words: Words, lo: int, hi: int, place: int, gram: int, window: int) -> tuple[list[bytes], int]:
    """The words that a window around the print at ``place`` can hold, inside its text, and the print's place among them."""
    lo, hi = max(lo, place - (window - gram)), min(hi, place + window)
    return [words.word(i) for i in range(lo, hi)], place - lo


def item_prints(items: DataFrame, id_col: str, text_col: str, window: int, gram: int) -> DataFrame:
    """(print, item_id, words around it, its place there, length of the item's windows), one row per fingerprint."""
    schema = pa.schema([("print", pa.int64()), ("item", pa.string()), ("item_words", pa.list_(pa.binary())), ("item_at", pa.int32()), ("need", pa.int32())])

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for item, text in zip(batch.column("item").to_pylist(), binary_column(batch, "text"), strict=True):
                for _, words in word_batches([text], letters_and_digits_split(), lower=True):
                    count = len(words.starts)
                    need = min(window, count)
                    if not need:
                        continue
                    short = (need,) if need < window else ()
                    for reach, n, values, places in fingerprints(words, window, gram, short):
                        if reach == need:
                            for v, p in zip(signed(values).tolist(), places.tolist(), strict=True):
                                around, at = _around(words, 0, count, p, n, need)
                                rows.append((v, item, around, at, need))
            yield to_batch(schema, list(zip(*rows, strict=True)) if rows else [[]] * 5)

    slim = items.select(F.col(f"`{id_col}`").cast("string").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return slim.mapInArrow(prints, "print bigint, item string, item_words array<binary>, item_at int, need int")


def likely_hits(docs: DataFrame, filter_: bytes, window: int, gram: int, short: tuple[int, ...]) -> DataFrame:
    """Per row of (doc_id, text): its text's digest, number of words, and the prints that pass the filter."""
    shared = docs.sparkSession.sparkContext.broadcast(filter_)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = binary_column(batch, "text")
            hits: list[list[dict]] = [[] for _ in texts]
            counts = np.zeros(len(texts), np.int64)
            for begin, words in word_batches(texts, letters_and_digits_split(), lower=True):
                first = words.first
                counts[begin : begin + len(first) - 1] = np.diff(first)
                for reach, n, values, places in fingerprints(words, window, gram, short):
                    for i in np.flatnonzero(passes(values, shared.value)).tolist():
                        place = int(places[i])
                        t = int(np.searchsorted(first, place, "right")) - 1
                        around, at = _around(words, int(first[t]), int(first[t + 1]), place, n, reach)
                        hit = {"print": int(signed(values[i : i + 1])[0]), "place": place - int(first[t]), "words": around, "at": at}
                        hits[begin + t].append(hit)
            digests = [hashlib.md5(t or b"").digest() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(digests, pa.binary()), pa.array(counts), pa.array(hits, pa.list_(_HIT))],
                names=["doc_id", "digest", "n_words", "hits"],
            )

    return docs.mapInArrow(find, f"doc_id {kind}, digest binary, n_words bigint, hits {_HIT_DDL}")


def _extended(pairs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Extend each joined print to both sides; keep runs that reach the needed number of words."""
    schema = pa.schema([("row", pa.int64()), ("item", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])
    names = ("row", "item", "place", "words", "at", "item_words", "item_at", "need")
    for batch in pairs:
        rows = []
        for row, item, place, words, at, item_words, item_at, need in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
            left = 0
            while left < min(at, item_at) and words[at - left - 1] == item_words[item_at - left - 1]:
                left += 1
            right = 0
            while right < min(len(words) - at, len(item_words) - item_at) and words[at + right] == item_words[item_at + right]:
                right += 1
            if right and left + right >= need:
                rows.append((row, item, place - left, place + right))
        yield to_batch(schema, list(zip(*rows, strict=True)) if rows else [[]] * 4)


def shared_spans(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
    bits: int = FILTER_BITS,
) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): all documents with ``row``, ``doc_id``, ``digest``, ``n_words``; and (row, item, start, stop), in words.

    A span is part of the document that equals part of the item, at least ``window`` words long, or the whole item if that
    is shorter. Longer shared passages appear as overlapping spans. NULL and empty texts have no words and no spans, items
    without words match nothing. Items with a NULL id match like others; their spans have a NULL item.
    """
    prints = cut_lineage(item_prints(items, item_col, item_text_col, window, gram), "prints")
    # the lengths of short items: fewer than `window` rows
    short = tuple(sorted(r[0] for r in prints.filter(F.col("need") < window).select("need").distinct().collect()))
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = likely_hits(slim, bit_filter(prints.select("print"), bits), window, gram, short)
    found = cut_lineage(found.withColumn("row", F.monotonically_increasing_id()), "hits")
    hits = found.select("row", F.explode("hits").alias("h")).select("row", "h.*")
    pairs = hits.join(prints, "print").select("row", "item", "place", "words", "at", "item_words", "item_at", "need")
    spans = pairs.mapInArrow(_extended, "row bigint, item string, start int, stop int")
    return found.select("row", "doc_id", "digest", "n_words"), spans


@F.pandas_udf(LongType())
def _words_hit(starts: pd.Series, stops: pd.Series) -> pd.Series:
    return pd.Series([int(covered(list(zip(s, e, strict=True)), int(max(e))).sum()) for s, e in zip(starts, stops, strict=True)])


def contamination(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Per document: words, words inside a shared span, and the items it shares them with, without a NULL id."""
    distinct = spans.distinct()
    per_row = distinct.groupBy("row").agg(
        F.collect_set("item").alias("items"), F.collect_list(F.struct("start", "stop")).alias("spans")
    )
    hit = per_row.select("row", F.array_sort("items").alias("items"), _words_hit(F.col("spans.start"), F.col("spans.stop")).alias("n_hit"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return (
        rows.join(hit, "row", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.size(items).cast("long").alias("n_items"),
            F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        )
    )


def without_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose text shares no span with any item, with their columns. NULL and empty texts stay."""
    rows, spans = shared_spans(docs, items, text_col=text_col, **options)
    bad = cut_lineage(rows.join(spans.select("row").distinct(), "row", "left_semi").select("digest").distinct(), "contaminated")
    bad = bad.select(F.col("digest").alias("__contaminated"))
    own = F.unhex(F.md5(F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary")))
    return docs.join(bad, own == F.col("__contaminated"), "left_anti")
