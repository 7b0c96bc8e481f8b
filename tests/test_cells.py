"""Trees on cells of equal rows, and exact quantiles of packed columns."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from colwright.operators import boosting, folds, models, quantiles
from test_boosting import noisy


@pytest.mark.parametrize("target, classes", [("y", None), ("label", 3)])
def test_one_task_and_passes_grow_the_same_trees(spark, target, classes):
    df = folds.shuffled_folds(spark.createDataFrame(noisy(400)).withColumn("b", F.when(~F.isnan("b"), F.col("b"))), ["id"], 2).cache()
    candidates = {"both": ["a", "b", "c"], "one": ["d"]}

    def found(at_once):
        out = boosting.out_of_fold({0: df, 1: df}, candidates, target, "fold", False, classes, rounds=3, depth=2, at_once=at_once)
        return sorted(map(tuple, out.collect()))

    assert found(boosting.CELLS_AT_ONCE) == found(0)


def test_equal_rows_are_one_cell(spark):
    rows = spark.range(6000).select(F.lit(0).alias("run"), (F.col("id") % 3).cast("double").alias("y"), F.expr("unhex(hex(id % 2))").alias("bins"))
    model = boosting.Trees(0, np.array([0]), 1, scale=2.0)
    cells = boosting.cells_of(rows, [model]).collect()
    assert sorted(r["n"] for r in cells) == [3000, 3000]
    assert sum(r["s"] for r in cells) == 6000 * 2**19


def test_jobs_do_not_grow_with_rounds_and_classes(spark):
    rows = spark.range(200).select("id", (F.col("id") % 7).cast("double").alias("x"), F.concat(F.lit("c"), F.col("id") % 3).alias("label"))
    df = folds.stratified_folds(rows, "label", ["id"], 2).cache()
    spark.sparkContext.setJobGroup("classes", "classes")
    models.cross_validate(df, ["x"], "label", "fold", 2, "classification").collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("classes"))
    spark.sparkContext.setJobGroup("rest", "rest")
    assert jobs < 100


def test_a_fold_without_training_rows_is_refused(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0)] * 4, "x double, y double, fold int")
    with pytest.raises(ValueError, match="no rows to train on"):
        boosting.out_of_fold({0: df}, {"m": ["x"]}, "y", "fold", False)


@pytest.mark.parametrize("chunk, points", [(1 << 16, 1 << 11), (100, 20), (7, 2)])
def test_packed_quantiles_are_exact(spark, chunk, points):
    rng = np.random.default_rng(5)
    n = 1500
    xs = [rng.normal(size=n), rng.integers(0, 4, n) * 1.0, np.where(rng.random(n) < 0.3, np.nan, rng.exponential(size=n)), np.full(n, np.nan)]
    xs, run = np.column_stack(xs), rng.integers(0, 2, n)
    rows = [(int(j), [None if np.isnan(v) else float(v) for v in x]) for j, x in zip(run, xs)]
    df = spark.createDataFrame(rows, "run int, xs array<double>").repartition(4).cache()
    probs = [0, 0.1, 0.25, 0.5, 0.77, 1]
    got = {(r["run"], r["f"]): r["q"] for r in quantiles.packed_quantiles(df, "xs", probs, "run", chunk, points).collect()}
    assert set(got) == {(j, f) for j in range(2) for f in range(3)}
    for (j, f), q in got.items():
        x = xs[run == j, f]
        np.testing.assert_allclose(q, np.quantile(x[~np.isnan(x)], probs), rtol=1e-12)
