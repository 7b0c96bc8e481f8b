"""Toxicity scores by non-negative positive-unlabelled learning.

Only confirmed toxic texts carry a label in training; the corpus as a whole is unlabelled and holds toxic texts at the class
prior. A linear classifier on hashed words minimises

    prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)])

the class-prior-corrected risk. Whenever its second part, the risk on clean texts, falls below zero, the step reverses that
part, which stops the classifier from fitting the unlabelled toxic texts as clean. Only words that are clearly commoner in
toxic texts get a weight, so that a long text is not judged by the sum of many small weights.

Training draws a bounded sample by a hash of the id (``POSITIVE_ROWS`` and ``UNLABELLED_ROWS``, about); scoring reads every
word of every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from colwright.llm.common import binary_column, letters_and_digits_split, slices, word_batches

POSITIVE_ROWS = 6_000
UNLABELLED_ROWS = 18_000
#: Words are hashed to so many bits.
WORD_BITS = 18
STEPS = 300
RATE = 0.05
#: Weight of the squared weights.
PENALTY = 1e-4
#: A word takes part if it is so many times, and so many standard errors, commoner in toxic texts.
LIFT = 2.0
DEVIATIONS = 6.0
#: Scores from here on count as toxic.
THRESHOLD = 0.3


def word_slots(texts: list[bytes | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Lower-cased words as slots, for some texts at a time: first text, number of texts, text of each word, slot of each word."""
    for begin, words in word_batches(texts, letters_and_digits_split(), lower=True):
        yield begin, len(words.first) - 1, words.text_of(), (words.hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sets = []
        for _, n, text, slots in word_slots(binary_column(batch, "text")):
            both = np.unique((text << WORD_BITS) | slots)
            cuts = np.searchsorted(both >> WORD_BITS, np.arange(1, n))
            sets += [(s & ((1 << WORD_BITS) - 1)).astype(np.int32) for s in np.split(both, cuts)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("positive"), pa.array(sets, pa.list_(pa.int32()))],
            names=["doc_id", "positive", "slots"],
        )


def _drawn(df: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` rows, chosen by a hash of the id; all of a smaller table."""
    share = min(1.0, rows / max(1, df.count()))
    return df.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)


def telling_slots(positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> np.ndarray:
    """Slots of words that are clearly commoner in toxic texts: by ``LIFT`` times, and by ``DEVIATIONS`` standard errors."""
    size, n_p, n_u = 1 << WORD_BITS, len(positive), len(unlabelled)
    in_p = np.bincount(np.concatenate(positive), minlength=size)
    in_u = np.bincount(np.concatenate(unlabelled), minlength=size)
    rate_p, rate_u, rate = in_p / n_p, in_u / n_u, (in_p + in_u) / (n_p + n_u)
    error = np.sqrt(rate * (1 - rate) * (1 / n_p + 1 / n_u) + 1e-12)
    return np.flatnonzero((rate_p - rate_u > DEVIATIONS * error) & (rate_p + 1 / n_p > LIFT * (rate_u + 1 / n_u)))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights per word slot and intercept: logistic loss, Adam steps on the risk of all given texts at once."""
    size = 1 << WORD_BITS
    weights, bias = np.zeros(size), float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return weights.astype(np.float32), bias
    kept = telling_slots(positive, unlabelled)
    place = np.full(size, -1)
    place[kept] = np.arange(len(kept))
    sets = [at[at >= 0] for at in (place[s] for s in positive + unlabelled)]
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    n_p, n_u = len(positive), len(unlabelled)
    is_p = np.arange(len(sets)) < n_p
    w = np.append(np.zeros(len(kept)), bias)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = np.bincount(row, weights=w[flat], minlength=len(sets)) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        clean_risk = np.logaddexp(0, z[n_p:]).mean() - prior * np.logaddexp(0, z[:n_p]).mean()
        toxic_part = np.where(is_p, prior * (p - 1) / n_p, 0.0)
        clean_part = np.where(is_p, -prior * p / n_p, p / n_u)
        slope = toxic_part + clean_part if clean_risk >= 0 else -clean_part
        grad = np.append(np.bincount(flat, weights=slope[row], minlength=len(kept)), slope.sum())
        grad[:-1] += PENALTY * w[:-1]
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad**2
        w -= RATE * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    weights[kept] = w[:-1]
    return weights.astype(np.float32), float(w[-1])


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    positive_rows: int = POSITIVE_ROWS,
    unlabelled_rows: int = UNLABELLED_ROWS,
) -> tuple[np.ndarray, float]:
    """Learn from the given rows: positives are ids labelled 1 (in any of their rows), all documents are unlabelled ones.

    The class prior is the share of 1 among labelled ids (0.1 without labels), the share of toxic texts in general.
    """
    marks = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("y")).dropna()
    marks = marks.groupBy("doc_id").agg(F.max("y").alias("y"))
    counts = marks.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("y") == 1).cast("int")).alias("p")).first()
    prior = min(0.9, max(0.001, (counts["p"] or 0) / counts["n"])) if counts["n"] else 0.1
    positive = _drawn(marks.filter("y = 1").select("doc_id"), positive_rows).withColumn("positive", F.lit(True))
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    # the unlabelled are drawn from all documents, so that toxic ones are among them at the class prior
    unlabelled = _drawn(slim.select("doc_id").dropna().distinct(), unlabelled_rows).withColumn("positive", F.lit(False))
    drawn = positive.unionByName(unlabelled)
    # about positive_rows + unlabelled_rows ids, whatever the size of the corpus
    sample = slim.join(F.broadcast(drawn), "doc_id").mapInArrow(_features, "doc_id bigint, positive boolean, slots array<int>")
    rows = sample.toArrow().sort_by([("positive", "descending"), ("doc_id", "ascending")])
    slots = rows["slots"].combine_chunks()
    sets = np.split(slots.values.to_numpy()[slots.offsets[0].as_py() :], (slots.offsets.to_numpy()[1:-1] - slots.offsets[0].as_py())) if rows.num_rows else []
    n_p = sum(rows["positive"].to_pylist())
    return fit(list(sets[:n_p]), list(sets[n_p:]), prior)


def scored(docs: DataFrame, weights: np.ndarray, bias: float, text_col: str = "text") -> Column:
    """Score from 0 to 1 of a text; NULL, empty and wordless texts get the score of a text without known words."""
    shared = docs.sparkSession.sparkContext.broadcast((weights, bias))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        weights, bias = shared.value
        out = np.full(len(texts), bias, np.float64)
        for begin, n, text, slots in word_slots([t.encode("utf-8", "surrogatepass") for t in texts]):
            known = np.flatnonzero(weights[slots])
            both = np.unique((text[known] << WORD_BITS) | slots[known])
            values = weights[both & ((1 << WORD_BITS) - 1)]
            out[begin : begin + n] += np.bincount(both >> WORD_BITS, weights=values, minlength=n)
        return pd.Series(1 / (1 + np.exp(-np.clip(out, -30, 30))))

    return score(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
