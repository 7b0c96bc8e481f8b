"""Filter scores of equal rows that are counted once, and of features that are the same in all folds."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colwright.operators import metrics, quantiles
from colwright.plans import protocol, review, search
from colwright.plans.spec import spec, with_features


def _rows(n=4000):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"id": np.arange(n), "a": rng.integers(0, 7, n).astype(float), "b": rng.integers(0, 5, n), "g": rng.choice(list("xyz"), n)})
    pdf["y"] = pdf.a * 2 + rng.normal(size=n)
    pdf["label"] = np.where(pdf.y > 6, "high", "low")
    pdf.loc[::50, "y"] = np.nan
    pdf.loc[::70, "label"] = None
    return pdf.astype({"label": object, "y": object}).where(pdf.notna(), None)


SPECS = [*search.propose(["a", "b"], ["g"]), spec("group_mean", "g", spec("square", "a"))]


@pytest.mark.parametrize("task, target", [("regression", "y"), ("classification", "label")])
def test_cells_give_the_scores_of_rows(spark, monkeypatch, task, target):
    df = spark.createDataFrame(_rows(), "id long, a double, b long, g string, y double, label string")
    train = F.col("id") % 3 != 0

    def scores():
        made = search.filter_scores(df, SPECS, target, task, rows=train, fit_on=train)
        return {r["feature"]: r["score"] for r in made.collect()}

    seen = []
    sizes = metrics.written_features
    monkeypatch.setattr(metrics, "written_features", lambda table, *rest: seen.append(table.count()) or sizes(table, *rest))
    cells = scores()
    monkeypatch.setattr(search, "ROWS_OF_A_CELL", 10**9)
    rows = scores()
    assert seen[0] <= 7 * 5 * 3 * 2 and seen[1] > 2600
    assert len(cells) == len(SPECS) and cells == pytest.approx(rows, nan_ok=True)


def test_statistics_do_not_compute_other_statistics_again(spark):
    df = spark.createDataFrame(_rows(50), "id long, a double, b long, g string, y double, label string")
    counted = []
    whole = df.withColumn("__t", F.lit(1))
    plain = quantiles.group_rank

    def watched(*args):
        counted.append(args[-1].columns)
        return plain(*args)

    quantiles.group_rank = watched
    try:
        made = with_features(whole, [spec("group_mean", "g", "a"), spec("group_rank", "g", "b"), spec("square", "a")])
    finally:
        quantiles.group_rank = plain
    assert counted == [whole.columns]
    assert {r["square(a)"] - r["a"] ** 2 for r in made.collect()} == {0.0}


def test_specs_on_specs_are_made_from_all_rows():
    from colwright.plans.spec import row_inputs

    assert row_inputs([spec("square", spec("group_mean", "g", "a")), spec("frequency", "b")]) == ["a", "b", "g"]
    assert row_inputs([spec("group_mean", "g", spec("frequency", "b"))]) is None
    assert row_inputs([spec("lag", "a", n=1)]) is None


@pytest.mark.parametrize("chunk, points", [(1 << 16, 1 << 11), (64, 4), (7, 2)])
def test_weighted_quantiles_are_those_of_repeated_rows(spark, chunk, points):
    rng = np.random.default_rng(5)
    x, w = rng.normal(size=500).round(1), np.where(rng.random(500) < 0.02, 5000, rng.integers(1, 40, 500))
    df = spark.createDataFrame(pd.DataFrame({"x": x, "w": w})).repartition(3)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = quantiles.packed_quantiles(df, ["x"], probs, chunk=chunk, points=points, weight="w").first()["q"]
    assert got == pytest.approx(np.quantile(np.repeat(x, w), probs).tolist())


def test_round_reads_each_fold_assignment_once(spark):
    df = spark.createDataFrame(_rows(600), "id long, a double, b long, g string, y double, label string")
    calls = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            calls.add(batch.num_rows)
            yield batch

    placed = df.filter("y IS NOT NULL").withColumn("fold", (F.col("id") % 4).cast("int"))
    placed = placed.mapInArrow(count, placed.schema)
    found = search.evaluate_round(placed, SPECS, "y", protocol.protocol_of("bike"), "fold", keep=1).collect()
    assert len(found) == len(SPECS) and sum(r["score"] is not None for r in found) == 1
    assert calls.value == 588


def test_redundancy_counts_rows_that_repeat_once(spark, monkeypatch):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"x": rng.normal(size=60).round(1), "z": rng.integers(0, 3, 60) * 1.0}).loc[np.repeat(np.arange(60), 30)]
    pdf["up"], pdf["lin"] = np.exp(pdf.x), 2 * pdf.x + 1
    df = spark.createDataFrame(pdf).withColumn("z", F.when(F.col("z") > 0, F.col("z")))
    pairs = [("up", "x"), ("lin", "x"), ("z", "x")]
    sizes = {}
    write = review.cut_lineage

    def written(table, label):
        out = write(table, label)
        sizes[label] = out.count()
        return out

    monkeypatch.setattr(review, "cut_lineage", written)

    def found():
        return {r["feature"]: (r["correlation"], r["rank_correlation"], r["linear"], r["monotone"]) for r in review.redundancy(df, pairs).collect()}

    cells = found()
    assert sizes["cells"] <= 60
    monkeypatch.setattr(search, "ROWS_OF_A_CELL", 10**9)
    for feature, rest in found().items():
        assert cells[feature] == pytest.approx(rest)
    known = pdf[pdf.z > 0]
    assert cells["z"][0] == pytest.approx(known.z.corr(known.x)) and cells["lin"][2:] == (True, True) and cells["up"][2:] == (False, True)
