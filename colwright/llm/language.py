"""Language identification with interpolated Kneser-Ney character models.

A text is folded to lower-case letters with single blanks for everything else, and cut into runs of ``ORDER`` characters.
Their counts per language are taken over all training documents: each task counts its runs with numpy, Spark adds the
counts up. All lower orders of a Kneser-Ney model follow from these counts by grouping (a lower-order count is the number
of distinct characters seen before a run), so the corpus is read once for training.

The model holds, per order, a sorted array of runs with one discounted probability per language, and a sorted array of
contexts with one back-off weight per language. Look-ups compare the whole run, so a run that was never seen always backs
off. The arrays grow with the number of different runs, not with the length of the corpus. A text gets the language of the lowest
cross-entropy per character. Its cross-entropy is compared with that of training texts of like length: texts far above
are rejected as being none of the languages.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, functions as F

from colwright.llm.common import slices
from colwright.storage import cut_lineage

ORDER = 4
#: Training rows that a length class needs for a threshold of its own.
CLASS_ROWS = 30
#: A text is rejected if it lies so many standard deviations, and so many nats per character, above training texts.
REJECT_DEVIATIONS = 8.0
REJECT_NATS = 1.25
#: Characters that count towards the certainty of a score, at most.
SCORE_CHARS = 40
UNKNOWN = "und"
_BLANK = 32


def fold_table() -> np.ndarray:
    """16-bit symbol of each character of the basic plane: itself if it is a letter, else a blank."""
    out = np.full(1 << 16, _BLANK, np.uint16)
    for c in range(1 << 16):
        if unicodedata.category(chr(c))[0] == "L":
            out[c] = c
    return out


def folded(text: str, table: np.ndarray) -> np.ndarray:
    """Symbols of the text by the ``fold_table``, blanks merged, with a blank at both ends; empty if it has no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    high = codes >= 1 << 16
    symbols = table[np.where(high, 0, codes)]
    if high.any():  # letters of other planes share the symbols of the private area
        places = np.flatnonzero(high)
        letters = np.array([unicodedata.category(chr(c))[0] == "L" for c in codes[places].tolist()])
        symbols[places[letters]] = (0xE000 + codes[places[letters]] % 6400).astype(np.uint16)
    blank = symbols == _BLANK
    if blank.all():
        return np.empty(0, np.uint16)
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    symbols = symbols[keep]
    symbols = symbols[1:] if symbols[0] == _BLANK else symbols
    symbols = symbols[:-1] if len(symbols) and symbols[-1] == _BLANK else symbols
    return np.concatenate(([_BLANK], symbols, [_BLANK])).astype(np.uint16)


def run_codes(symbols: np.ndarray, order: int) -> np.ndarray:
    """One code per character: the character in the lowest 16 bits, the ``order - 1`` before it above."""
    padded = np.concatenate((np.full(order - 2, _BLANK, np.uint16), symbols)).astype(np.uint64)
    n = len(symbols) - 1
    out = np.zeros(n, np.uint64)
    for j in range(order):
        out = (out << np.uint64(16)) | padded[j : j + n]
    return out


#: Runs that a task holds before it adds equal ones up, and different ones that it holds before it hands them on.
_RUNS_HELD = 1 << 21


def _added_up(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, place = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return codes, np.bincount(place, weights=np.concatenate([n for _, n in parts])).astype(np.int64)


def _count_runs(order: int):
    schema = pa.schema([("lang", pa.string()), ("code", pa.int64()), ("n", pa.int64())])

    def rows(lang: str, codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes.view(np.int64)), pa.array(n)], schema=schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        table = fold_table()
        for batch in slices(batches, 128):
            by_lang: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                symbols = folded(text, table)
                if len(symbols):
                    by_lang.setdefault(lang, []).append(run_codes(symbols, order))
            for lang, codes in by_lang.items():
                own = held.setdefault(lang, [])
                own.append(np.unique(np.concatenate(codes), return_counts=True))
                if sum(len(c) for c, _ in own) > _RUNS_HELD:
                    own[:] = [_added_up(own)]
                    if len(own[0][0]) > _RUNS_HELD // 2:
                        yield rows(lang, *own.pop())
        for lang, own in held.items():
            if own:
                yield rows(lang, *_added_up(own))

    return count


def count_runs(docs: DataFrame, order: int) -> DataFrame:
    """(lang, code, n) over all rows of (lang, text)."""
    return docs.mapInArrow(_count_runs(order), "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))


class Model:
    """Sorted arrays of runs per order, shortest runs first."""

    def __init__(self, langs: list[str], order: int, tables: list[tuple], base: float):
        self.langs, self.order, self.tables, self.base = langs, order, tables, base
        self.fold = fold_table()

    def probabilities(self, codes: np.ndarray, k: int | None = None) -> np.ndarray:
        """P(character | characters before it), one row per code and one column per language."""
        k = self.order if k is None else k
        if k == 0:
            return np.full((len(codes), len(self.langs)), self.base, np.float32)
        runs, terms, contexts, weights, final = self.tables[k - 1]
        if not len(codes):
            return np.empty((0, len(self.langs)), np.float32)
        at, known = _look_up(runs, codes & _mask(k))
        if final is None:
            out = np.zeros((len(codes), len(self.langs)), np.float32)
            out[known] = terms[at[known]]
            rest = np.arange(len(codes))
        else:
            out = final[at]
            rest = np.flatnonzero(~known)
            out[rest] = 0
        if len(rest):
            lower = self.probabilities(codes[rest], k - 1)
            place, seen = _look_up(contexts, (codes[rest] & _mask(k)) >> np.uint64(16))
            backoff = np.ones_like(lower)
            backoff[seen] = weights[place[seen]]
            out[rest] += backoff * lower
        return out

    def finish(self) -> Model:
        """Interpolate all known runs once, so that scoring looks up one row per known run."""
        for k in range(1, self.order + 1):
            runs, terms, contexts, weights, _ = self.tables[k - 1]
            final = self.probabilities(runs, k)
            self.tables[k - 1] = (runs, None, contexts, weights, final)
        return self

    def entropies(self, text: str) -> tuple[int, np.ndarray | None]:
        """Characters scored, and the cross-entropy per character (in nats) of each language."""
        symbols = folded(text, self.fold)
        if not len(symbols):
            return 0, None
        total, n = np.zeros(len(self.langs)), len(symbols) - 1
        step = max(1 << 12, (1 << 22) // len(self.langs))
        for lo in range(0, n, step):  # bounds the memory of a long text
            codes = run_codes(symbols[max(0, lo - self.order) : lo + step + 1], self.order)
            codes = codes[len(codes) - min(step, n - lo) :]
            total += np.log(self.probabilities(codes)).sum(axis=0, dtype=np.float64)
        return n, -total / n


def _mask(k: int) -> np.uint64:
    return np.uint64((1 << (16 * k)) - 1)


def _look_up(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def train(docs: DataFrame, lang_col: str, text_col: str, order: int = ORDER) -> Model | None:
    """Learn from all rows with a language and a text; None if there are none."""
    slim = docs.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    counts = cut_lineage(count_runs(slim.dropna(), order), "runs")
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())  # one row per language
    if not langs:
        return None
    index = {l: i for i, l in enumerate(langs)}

    tables, grams = [], counts
    for k in range(order, 0, -1):
        if k < order:
            # each run counts once per distinct character before it
            short = F.col("code").bitwiseAND(F.lit((1 << (16 * k)) - 1))
            grams = cut_lineage(grams.groupBy("lang", short.alias("code")).agg(F.count(F.lit(1)).alias("n")), "runs")
        tables.append(_order_table(grams, index))
    tables.reverse()
    base = 1.0 / (len(tables[0][0]) + 1)
    return Model(langs, order, tables, base).finish()


def _order_table(grams: DataFrame, index: dict[str, int]) -> tuple:
    once = grams.groupBy("lang").agg(F.sum((F.col("n") == 1).cast("long")).alias("n1"), F.sum((F.col("n") == 2).cast("long")).alias("n2"))
    discount = {r["lang"]: (r["n1"] / (r["n1"] + 2 * r["n2"]) if r["n1"] and r["n2"] else 0.5) for r in once.collect()}
    # the shift must not carry the sign of codes whose first symbol is above 0x7FFF
    context = F.shiftrightunsigned("code", 16)
    by_context = grams.groupBy("lang", context.alias("context")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
    joined = grams.withColumn("context", context).join(by_context, ["lang", "context"])
    rate = F.element_at(F.create_map(*[F.lit(x) for pair in discount.items() for x in pair]), F.col("lang"))
    terms = joined.select("code", "lang", (F.greatest(F.col("n") - rate, F.lit(0.0)) / F.col("total")).alias("p"))
    runs, values = _arrays(terms, index, 0.0)
    weights = by_context.select(F.col("context").alias("code"), "lang", (rate * F.col("kinds") / F.col("total")).alias("p"))
    contexts, backoffs = _arrays(weights, index, 1.0)
    return runs, values, contexts, np.minimum(backoffs, 1.0), None


def _arrays(rows: DataFrame, index: dict[str, int], missing: float) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes, and one column of values per language. A row per different run and language reaches the driver."""
    flat = rows.toArrow()
    keys, inverse = np.unique(flat["code"].to_numpy().view(np.uint64), return_inverse=True)
    values = np.full((len(keys), len(index)), missing, np.float32)
    values[inverse, [index[l] for l in flat["lang"].to_pylist()]] = flat["p"].to_numpy()
    return keys, values


_SCORED = "struct<chars:bigint,best:int,nats:double,score:double>"


def scored(model: Model, text: Column) -> Column:
    """Per text the number of characters, the best language, its cross-entropy and a score from 0 to 1."""
    # plain values: executors need no copy of this package to read them
    shared = SparkContext.getOrCreate().broadcast((model.langs, model.order, model.tables, model.base))

    @F.pandas_udf(_SCORED)
    def score(texts: pd.Series) -> pd.DataFrame:
        m, rows = Model(*shared.value), []
        for t in texts:
            n, nats = m.entropies(t or "")
            if not n:
                rows.append((0, -1, None, 0.0))
                continue
            best = int(np.argmin(nats))
            odds = np.exp(-(nats - nats[best]) * min(n, SCORE_CHARS))
            rows.append((n, best, float(nats[best]), float(1.0 / odds.sum())))
        return pd.DataFrame(rows, columns=["chars", "best", "nats", "score"])

    return score(text)


def calibrate(model: Model, docs: DataFrame, lang_col: str, text_col: str) -> list[float]:
    """Rejection thresholds per length class (powers of two of the characters), infinite only if there are no training texts.

    Fitted on all training documents that get their own language: mean cross-entropy plus the larger of
    ``REJECT_DEVIATIONS`` standard deviations and ``REJECT_NATS``, the highest of a class and its two neighbours. Where none of
    the three has ``CLASS_ROWS`` rows, the nearest class that has them counts, with deviations for the length: those of a mean
    grow with the square root as texts get shorter. If no class has so many, all rows count as one class of the shortest.
    """
    slim = docs.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text")).dropna()
    langs = F.array(*[F.lit(x) for x in model.langs])
    own = slim.select("lang", scored(model, F.col("text")).alias("s")).filter("s.chars > 0 AND s.best >= 0")
    own = own.filter(F.element_at(langs, F.col("s.best") + 1) == F.col("lang"))
    size = F.floor(F.log2("s.chars")).cast("int").alias("size")
    measures = F.count(F.lit(1)).alias("n"), F.avg("s.nats").alias("mean"), F.stddev_pop("s.nats").alias("sd")
    rows = own.groupBy(size).agg(*measures, F.avg(F.col("s.nats") * F.col("s.nats")).alias("square")).collect()  # at most 63 rows
    return thresholds({r["size"]: (r["n"], r["mean"], r["sd"], r["square"]) for r in rows})


def thresholds(classes: dict[int, tuple[int, float, float, float]]) -> list[float]:
    """The threshold of each length class, from (rows, mean, standard deviation, mean square) of the classes that have rows."""
    if not classes:
        return [float("inf")] * 64
    large = {size: (mean, sd) for size, (n, mean, sd, _) in classes.items() if n >= CLASS_ROWS}
    if not large:
        n = sum(c[0] for c in classes.values())
        mean, square = (sum(c[0] * c[i] for c in classes.values()) / n for i in (1, 3))
        large = {min(classes): (mean, max(0.0, square - mean * mean) ** 0.5)}

    def limit(size: int, of: int) -> float:
        mean, sd = large[of]
        wider = 2.0 ** max(0.0, (of - size) / 2) if abs(of - size) > 1 else 1.0
        return mean + max(REJECT_DEVIATIONS * sd * wider, REJECT_NATS)

    limits = []
    for size in range(64):
        far = max(1, min(abs(of - size) for of in large))
        limits.append(max(limit(size, of) for of in large if abs(of - size) <= far))
    return limits


def identify(model: Model | None, limits: list[float], text_col: str = "text") -> list[Column]:
    """Columns ``lang_pred``, ``score``, ``nats`` and ``rejected`` for a table with a text column.

    ``lang_pred`` is a learned language, or ``und`` for NULL texts and texts without letters (score 0, rejected). With no
    model every text is ``und``. Equal cross-entropies go to the language that comes first by name. Texts of any length are
    scored whole.
    """
    if model is None:
        return [F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("nats"), F.lit(True).alias("rejected")]
    s = scored(model, F.col(f"`{text_col}`").cast("string"))
    langs = F.array(*[F.lit(x) for x in model.langs])
    limit = F.element_at(F.array(*[F.lit(x) for x in limits]), F.floor(F.log2(s["chars"])).cast("int") + 1)
    return [
        F.when(s["best"] >= 0, F.element_at(langs, F.greatest(s["best"], F.lit(0)) + 1)).otherwise(UNKNOWN).alias("lang_pred"),
        s["score"].alias("score"),
        s["nats"].alias("nats"),
        F.when(s["best"] >= 0, s["nats"] > limit).otherwise(True).alias("rejected"),
    ]
