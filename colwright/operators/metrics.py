"""Scores of predictions and of features. Higher is better; errors are negated."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from colwright.functions import numeric as num
from colwright.operators.quantiles import packed_quantiles, unpacked_columns
from colwright.storage import cut_lineage


def accuracy(y: Column, predicted: Column) -> Column:
    """Share of rows with a known class that are predicted right; a row without a prediction is predicted wrong."""
    return F.avg(F.when(y.isNotNull(), F.coalesce(y == predicted, F.lit(False)).cast("double")))


def negative_rmse(y: Column, predicted: Column) -> Column:
    error = y.cast("double") - predicted.cast("double")
    return -F.sqrt(F.avg(error * error))


def fold_scores(
    predictions: DataFrame,
    metric: str,
    y: str,
    predicted: str,
    by: Sequence[str],
    train_spread: DataFrame | None = None,
    unscored: str = "raise",
) -> DataFrame:
    """(by, score, n, n_scored) per group: ``accuracy``, ``rmse``, or ``nrmse`` relative to the training target.

    ``n`` counts the rows with a known target and ``n_scored`` those with a prediction as well. An error cannot be taken
    over rows without a prediction: they stop the job, or with ``unscored="skip"`` show in the counts only. For ``nrmse``,
    ``train_spread`` has the same keys and ``spread``, the population deviation of the train target.
    """
    a, b = F.col(y), F.col(predicted)
    if metric not in ("accuracy", "rmse", "nrmse"):
        raise ValueError(f"unknown metric {metric}")
    score = accuracy(a, b) if metric == "accuracy" else negative_rmse(a, b)
    counts = [F.count(a).alias("n"), F.count(F.when(a.isNotNull(), b)).alias("n_scored")]
    scores = predictions.groupBy(*by).agg(score.alias("score"), *counts)
    if metric != "accuracy" and unscored == "raise":
        missing = F.raise_error(F.concat_ws(" ", F.col("n") - F.col("n_scored"), F.lit("rows have no prediction"))).cast("double")
        scores = scores.withColumn("score", F.when(F.col("n_scored") < F.col("n"), missing).otherwise(F.col("score")))
    if metric == "nrmse":
        joined = scores.join(F.broadcast(train_spread), list(by))
        return joined.withColumn("score", num.ratio(F.col("score"), F.col("spread"))).drop("spread")
    return scores


def train_spread(df: DataFrame, y: str, fold: str, folds: int, ordered: bool = False) -> DataFrame:
    """(fold, spread): population deviation of the target over the rows each fold trains on.

    Count, sum and sum of squares are taken once per fold label; a fold's training rows are then sums over labels.
    """
    v = F.col(y).cast("double")
    centre = df.agg(F.avg(v).alias("__m"))
    centred = df.crossJoin(F.broadcast(centre)).select(F.col(fold).alias("__part"), (v - F.col("__m")).alias("__v"))
    parts = centred.groupBy("__part").agg(
        F.count("__v").alias("n"), F.sum("__v").alias("s"), F.sum(F.col("__v") * F.col("__v")).alias("ss")
    )
    ids = df.sparkSession.range(folds).select(F.col("id").cast("int").alias(fold))
    rule = F.col("__part") < F.col(fold) if ordered else F.col("__part") != F.col(fold)
    sums = parts.join(F.broadcast(ids), rule).groupBy(fold).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    mean = F.col("s") / F.col("n")
    return sums.select(fold, F.sqrt(F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0))).alias("spread"))


def mean_scores(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    return scores.groupBy(*by).agg(F.avg("score").alias("score"))


# --- scores of single features, all candidates in one pass ---------------------------------------------------------


def correlations(df: DataFrame, features: Sequence[str], y: str) -> DataFrame:
    """(feature, n, correlation) for every feature, from one aggregate."""
    v = F.col(y).cast("double")
    cells = []
    aggs = []
    for i, name in enumerate(features):
        x = num.finite(F.col(f"`{name}`"))
        both = x.isNotNull() & v.isNotNull()
        aggs += [F.count(F.when(both, x)).alias(f"n{i}"), num.correlation(x, v).alias(f"r{i}")]
        cells.append(
            F.struct(
                F.lit(name).alias("feature"),
                F.col(f"n{i}").alias("n"),
                num.finite(F.col(f"r{i}")).alias("correlation"),
            )
        )
    return df.agg(*aggs).select(F.inline(F.array(*cells)))


_SUMS = ("n", "x", "y", "xx", "yy", "xy")
#: What a row of a written table of features stands for: rows, rows with a known target, and sums of the centred target.
_MEASURES = ("__w", "__n", "__y", "__yy")


def measured(df: DataFrame, target: str, by: Sequence[str] | None = None) -> DataFrame:
    """``df`` with the measures of a numeric target; with ``by``, rows that agree in these columns are one."""
    y = F.col(f"`{target}`").cast("double")
    centred = y - F.lit(df.agg(F.avg(y)).first()[0] or 0.0)
    if by is None:
        known = y.isNotNull()
        sums = (F.lit(1), known.cast("long"), F.when(known, centred).otherwise(0.0), F.when(known, centred * centred).otherwise(0.0))
        return df.withColumns({m: c.cast("double" if "y" in m else "long") for m, c in zip(_MEASURES, sums, strict=True)})
    sums = (F.count(F.lit(1)), F.count(y), F.coalesce(F.sum(centred), F.lit(0.0)), F.coalesce(F.sum(centred * centred), F.lit(0.0)))
    return cut_lineage(df.groupBy(*by).agg(*[c.alias(m) for m, c in zip(_MEASURES, sums, strict=True)]), "cells")


def counted(df: DataFrame, label: str, by: Sequence[str] | None = None) -> DataFrame:
    """``df`` with the class of each row and 1 as its weight; with ``by``, rows that agree in these columns and the class are one."""
    rows = df.withColumn("__y", F.col(f"`{label}`"))
    if by is None:
        return rows.withColumn("__w", F.lit(1).cast("long"))
    return cut_lineage(rows.groupBy(*by, "__y").agg(F.count(F.lit(1)).alias("__w")), "cells")


def written_features(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The features of a ``measured`` or ``counted`` table as columns x0, x1, … of a written one.

    Passes over it read plain columns of numbers; values of a feature that repeat take hardly any room in its files.
    """
    values = [F.col(f"`{f}`").cast("double").alias(f"x{i}") for i, f in enumerate(features)]
    return cut_lineage(df.select(*keep, *[m for m in _MEASURES if m in df.columns], *values), "features")


def _edges(rows: DataFrame, xs: Sequence[str], bins: int) -> np.ndarray:
    """Exact quantiles of each column that cut it into ``bins``; a column without known values has no edges, which are NaN here."""
    found = packed_quantiles(rows, xs, [i / bins for i in range(1, bins)], weight="__w")
    edges = np.full((len(xs), bins - 1), np.nan)
    for r in found.collect():  # one row per feature
        edges[r["f"]] = r["q"]
    return edges


def _bins(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The bin of each value, from 1; missing values are in bin 0."""
    return np.where(np.isnan(x), 0, np.searchsorted(edges, x, "left") + 1)


def _named(scores: DataFrame, features: Sequence[str]) -> DataFrame:
    names = F.array(*[F.lit(f) for f in features])
    return scores.withColumn("feature", names[F.col("f")]).drop("f")


def feature_information(df: DataFrame, features: Sequence[str], label: str, bins: int = 10) -> DataFrame:
    """(feature, mutual_information) between the bins of numeric features and the class."""
    return information_of(written_features(counted(df, label), features), features, bins)


def information_of(rows: DataFrame, features: Sequence[str], bins: int = 10) -> DataFrame:
    """``feature_information`` of a table, or some of its rows, that ``counted`` and ``written_features`` gave."""
    xs = [f"x{i}" for i in range(len(features))]
    edges = _edges(rows, xs, bins)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, w = batch.column("__y").dictionary_encode(), batch.column("__w").to_numpy()
            codes = labels.indices.to_numpy(zero_copy_only=False).astype(np.int64) * (bins + 1)
            for f, x in enumerate(unpacked_columns(batch, xs)):
                cell, place = np.unique(codes + _bins(x, edges[f]), return_inverse=True)
                c = np.bincount(place, w, len(cell)).astype(np.int64)
                y = labels.dictionary.take(pa.array(cell // (bins + 1)))
                numbers = [pa.array(i.astype(np.int32)) for i in (np.full(len(cell), f), cell % (bins + 1))]
                yield pa.RecordBatch.from_arrays([*numbers, y, pa.array(c)], ["feature", "bin", "__y", "c"])

    kind = rows.schema["__y"].dataType.simpleString()
    known = rows.filter(F.col("__y").isNotNull()).select("__w", "__y", *xs)
    cells = known.mapInArrow(summed, f"feature int, bin int, __y {kind}, c long")
    cells = cut_lineage(cells.groupBy("feature", "bin", "__y").agg(F.sum("c").alias("c")), "cells")
    return _named(_information(cells, "__y").withColumnRenamed("feature", "f"), features)


def feature_scores(df: DataFrame, features: Sequence[str], y: str, bins: int = 10) -> DataFrame:
    """(feature, n, correlation, eta_squared) of numeric features, from one aggregate per (feature, bin)."""
    return scores_of(written_features(measured(df, y), features), features, bins)


def scores_of(rows: DataFrame, features: Sequence[str], bins: int = 10) -> DataFrame:
    """``feature_scores`` of a table, or some of its rows, that ``measured`` and ``written_features`` gave.

    Every numeric feature is cut at its exact quantiles; missing values form a bin of their own. Each task adds its rows to plain
    sums of centred values per (feature, bin), so a row is read once for both scores and only sums are shuffled. Features are
    centred by their median edge; there is one row of edges per feature.
    """
    xs = [f"x{i}" for i in range(len(features))]
    edges = _edges(rows, xs, bins)
    centres = np.nan_to_num(edges[:, (bins - 1) // 2])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(_SUMS), len(xs), bins + 1))
        for batch in batches:
            n, v, vv = (batch.column(m).to_numpy() for m in _MEASURES[1:])
            for f, x in enumerate(unpacked_columns(batch, xs)):
                cell, d = _bins(x, edges[f]), np.nan_to_num(x - centres[f])
                nd = n * d
                for i, term in enumerate((n, nd, v, nd * d, vv, d * v)):
                    sums[i, f] += np.bincount(cell, term, bins + 1)
        f, cell = np.nonzero(sums[0])
        n, *rest = sums[:, f, cell]
        places = [f.astype(np.int32), (cell - 1).astype(np.int32), n.astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*places, *rest)], ["f", "bin", *_SUMS])

    added = rows.select(*_MEASURES, *xs).mapInArrow(summed, f"f int, bin int, n long, {', '.join(f'{c} double' for c in _SUMS[1:])}")
    cells = added.groupBy("f", "bin").agg(*[F.sum(c).alias(c) for c in _SUMS])
    known = F.col("bin") >= 0

    def total(name: str, of_known: bool = False) -> Column:
        return F.sum(F.when(known, F.col(name))) if of_known else F.sum(name)

    sums = cells.groupBy("f").agg(
        F.coalesce(total("n", True), F.lit(0)).alias("n"),
        *[total(c, True).alias(f"k{c}") for c in ("x", "y", "xx", "yy", "xy")],
        (total("yy") - total("y") * total("y") / total("n")).alias("all_y"),
        (F.sum(F.col("y") * F.col("y") / F.col("n")) - total("y") * total("y") / total("n")).alias("between"),
    )
    n = F.when(F.col("n") > 0, F.col("n"))
    cxy = F.col("kxy") - F.col("kx") * F.col("ky") / n
    cxx = F.greatest(F.col("kxx") - F.col("kx") * F.col("kx") / n, F.lit(0.0))
    cyy = F.greatest(F.col("kyy") - F.col("ky") * F.col("ky") / n, F.lit(0.0))
    scores = sums.select(
        "f",
        "n",
        num.ratio(cxy, F.sqrt(cxx) * F.sqrt(cyy)).alias("correlation"),
        num.ratio(F.greatest(F.col("between"), F.lit(0.0)), F.col("all_y")).alias("eta_squared"),
    )
    return _named(scores, features)


def category_bins(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Rows (keep…, feature, bin) with the category itself as the bin; missing values are the bin NULL."""
    cells = [F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`").cast("string").alias("bin")) for f in features]
    return df.select(*keep, F.inline(F.array(*cells)))


def explained_variance(bins: DataFrame, y: str) -> DataFrame:
    """(feature, eta_squared): between-bin over total variance of the target."""
    v = F.col(y).cast("double")
    per_bin = bins.groupBy("feature", "bin").agg(
        F.count(v).alias("n"), F.avg(v).alias("m"), (F.var_pop(v) * F.count(v)).alias("within")
    )
    per_bin = cut_lineage(per_bin, "bins")
    total = per_bin.groupBy("feature").agg(
        F.sum("within").alias("w"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand")
    )
    off = F.col("m") - F.col("grand")
    between = F.sum(F.col("n") * off * off)
    joined = per_bin.join(F.broadcast(total), ["feature"]).groupBy("feature").agg(between.alias("b"), F.max("w").alias("w"))
    return joined.select("feature", num.ratio(F.col("b"), F.col("b") + F.col("w")).alias("eta_squared"))


def mutual_information(bins: DataFrame, label: str) -> DataFrame:
    """(feature, mutual_information) in nats between the bin and the class, over the rows with a known class.

    With counts c of (bin, class), b of bins and l of classes, it is ln n + (sum c ln c - sum b ln b - sum l ln l) / n. The
    table is counted once; bins, classes and totals are sums over those counts, so no bin is ever joined.
    """
    known = bins.filter(F.col(label).isNotNull())
    return _information(cut_lineage(known.groupBy("feature", "bin", label).agg(F.count(F.lit(1)).alias("c")), "cells"), label)


def _information(cells: DataFrame, label: str) -> DataFrame:
    """``mutual_information`` of a written table of counts ``c`` by feature, bin and class."""

    def weighed(counts: DataFrame, name: str) -> DataFrame:
        return counts.groupBy("feature").agg(F.sum(F.col("c") * F.log("c")).alias(name), F.sum("c").alias(f"n_{name}"))

    joint = weighed(cells, "joint")
    of_bins = weighed(cells.groupBy("feature", "bin").agg(F.sum("c").alias("c")), "bins")
    of_classes = weighed(cells.groupBy("feature", label).agg(F.sum("c").alias("c")), "classes")
    # one row per feature
    joined = joint.join(F.broadcast(of_bins), "feature").join(F.broadcast(of_classes), "feature")
    gain = F.log("n_joint") + (F.col("joint") - F.col("bins") - F.col("classes")) / F.col("n_joint")
    return joined.select("feature", F.greatest(gain, F.lit(0.0)).alias("mutual_information"))


def drop_uninformative(df: DataFrame, scores: DataFrame, least: float, score: str = "score") -> DataFrame:
    """``df`` without the features whose absolute score is missing or below ``least``; one score per feature."""
    weak = scores.filter(F.coalesce(F.abs(score), F.lit(0.0)) < least).select("feature").collect()
    return df.drop(*[row["feature"] for row in weak])
