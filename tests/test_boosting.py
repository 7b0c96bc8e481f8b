"""Trees of many models against one model at a time, grown by a plain version on whole arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colwright.operators import boosting, folds, models


def noisy(n=900, seed=3):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"id": range(n), "a": rng.normal(size=n), "b": rng.normal(size=n), "c": rng.choice(["u", "v", "w"], n), "d": rng.integers(0, 4, n)})
    pdf["y"] = pdf.a * 3 + np.sin(pdf.b * 2) + (pdf.c == "u") * 2 + rng.normal(size=n) / 2
    pdf["label"] = np.digitize(pdf.y + rng.normal(size=n) / 2, [-1.5, 1.5]).astype(float)
    pdf.loc[::17, "b"] = np.nan
    return pdf


def plain(train, test, y, classes, rounds, depth):
    """Predictions for ``test`` by trees that are grown node by node over exact bins; columns are numbers."""
    edges = [np.unique(np.quantile(x[~np.isnan(x)], [i / boosting.BINS for i in range(boosting.BINS)])) for x in train.T]

    def binned(xs):
        return np.column_stack([np.where(np.isnan(x), 0, np.searchsorted(e, x) + 1) for x, e in zip(xs.T, edges)])

    bins, held, k = binned(train), binned(test), classes or 1
    raw, out = np.zeros((len(train), k)), np.zeros((len(test), k))
    scale = 1.0 if classes else np.abs(y).max()
    quantum = scale * 2.0**-20

    def grow(rows, mine, g, h, level, step, into_rows, into_mine, col):
        if not len(rows):
            return
        smooth = boosting.SMOOTHING if classes else 0.0
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = None
        if level < depth:
            for f in range(bins.shape[1]):
                for b in range(boosting.BINS + 1):
                    left = rows[bins[rows, f] <= b]
                    if 0 < len(left) < len(rows):
                        lg, lh = g[left].sum(), h[left].sum()
                        gain = lg**2 / (lh + smooth) + (total_g - lg) ** 2 / (total_h - lh + smooth) - total_g**2 / (total_h + smooth)
                        if best is None or gain > best[0] + 1e-9 * abs(best[0]):
                            best = (gain, f, b)
        if best is None or best[0] <= 4 * len(rows) * quantum**2:
            value = step * ((k - 1) / k if classes else 1.0) * total_g / (total_h + smooth)
            into_rows[rows, col] += value
            into_mine[mine, col] += value
            return
        _, f, b = best
        for low in (True, False):
            grow(rows[(bins[rows, f] <= b) == low], mine[(held[mine, f] <= b) == low], g, h, level + 1, step, into_rows, into_mine, col)

    for turn in range(rounds):
        if classes:
            e = np.exp(raw - raw.max(axis=1, keepdims=True))
            p = e / e.sum(axis=1, keepdims=True)
            g, h = (np.arange(k) == y[:, None]) - p, p * (1 - p)
        else:
            g, h = y[:, None] - raw, np.ones_like(raw)
        step = boosting.OF_CLASSES if classes else boosting.FIRST if turn == 0 else boosting.LATER
        g, h = np.rint(g / quantum) * quantum, (np.rint(h / quantum) * quantum if classes else h)
        added, seen = np.zeros_like(raw), np.zeros_like(out)
        for c in range(k):
            grow(np.arange(len(train)), np.arange(len(test)), g[:, c], h[:, c], 0, step, added, seen, c)
        raw, out = raw + added, out + seen
    return out.argmax(axis=1).astype(float) if classes else out[:, 0]


@pytest.mark.parametrize("target, classes", [("y", None), ("label", 3)])
def test_noisy_targets_equal_the_plain_version(spark, target, classes):
    pdf = noisy()
    df = folds.shuffled_folds(spark.createDataFrame(pdf).withColumn("b", F.when(~F.isnan("b"), F.col("b"))), ["id"], 3)
    df = df.withColumn("copy", F.col("id")).cache()
    candidates = {"both": ["a", "b", "c"], "one": ["b", "d"]}
    # the id travels as the target's tag: predictions are matched by (fold, target) rows in order of id
    found = boosting.out_of_fold({j: df for j in range(3)}, candidates, target, "fold", False, classes, rounds=3, depth=3).toPandas()
    fold = df.select("id", "fold").toPandas().set_index("id").fold.reindex(pdf.id).to_numpy()
    code = pdf.c.map({"u": 0.0, "v": 1.0, "w": 2.0})
    for name, columns in candidates.items():
        xs = np.column_stack([code if c == "c" else pdf[c].astype(float) for c in columns])
        for j in range(3):
            mine = found[(found.candidate == name) & (found.fold == j)]
            want = plain(xs[fold != j], xs[fold == j], pdf[target].to_numpy()[fold != j], classes, 3, 3)
            pairs = sorted(zip(pdf[target].to_numpy()[fold == j], want))
            got = sorted(zip(mine[target], mine.prediction))
            assert len(got) == len(pairs)
            np.testing.assert_allclose(got, pairs, atol=1e-5)


def test_jobs_do_not_grow_with_the_models(spark):
    pdf = noisy(300)
    df = folds.shuffled_folds(spark.createDataFrame(pdf[["id", "a", "d", "y"]]), ["id"], 2).cache()
    tracker = spark.sparkContext.statusTracker()
    counts = []
    for candidates in ({"a": ["a"]}, {f"c{i}": ["a", "d"][: 1 + i % 2] for i in range(8)}):
        group = f"fit {len(candidates)}"
        spark.sparkContext.setJobGroup(group, group)
        boosting.out_of_fold({0: df, 1: df}, candidates, "y", "fold", False, rounds=2, depth=2).count()
        counts.append(len(tracker.getJobIdsForGroup(group)))
    spark.sparkContext.setJobGroup("rest", "rest")
    assert counts[1] <= counts[0] + 4


def test_scores_are_near_those_of_the_library(spark):
    pdf = noisy(600)
    df = folds.shuffled_folds(spark.createDataFrame(pdf[["id", "a", "d", "y"]]), ["id"], 2)
    mine = [r["score"] for r in models.cross_validate(df, ["a", "d"], "y", "fold", 2, "regression", rounds=5).orderBy("fold").collect()]
    for j, score in enumerate(mine):
        model = models.fit_regressor(df.filter(F.col("fold") != j), ["a", "d"], "y", rounds=5)
        error = models.predict(model, df.filter(F.col("fold") == j)).agg(F.sqrt(F.avg(F.pow(F.col("y") - F.col("prediction"), 2)))).first()[0]
        assert -score == pytest.approx(error, rel=0.1)


def test_rows_without_target_or_values(spark):
    rows = [(i, None if i % 5 == 0 else float(i % 2), None if i % 7 == 0 else float(i % 2), None, i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, y double, x double, nothing double, fold int")
    found = boosting.out_of_fold({0: df, 1: df}, {"m": ["x", "nothing"]}, "y", "fold", False, rounds=2).collect()
    assert len(found) == 80 and all(r["prediction"] is not None for r in found)
