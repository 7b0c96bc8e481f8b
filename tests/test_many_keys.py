"""Statistics of many keys from one expansion, and redundancy of many features, against pandas."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colwright.operators import groups
from colwright.plans import review
from colwright.plans.spec import spec, with_features

SCHEMA = "id long, a string, b string, c long, x double, y double"


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    n = 600
    pdf = pd.DataFrame(
        {
            "id": range(n),
            "a": rng.choice(["p", "q", "r"], n, p=[0.7, 0.2, 0.1]),
            "b": rng.choice(["u", "v"], n),
            "c": rng.integers(0, 9, n),
            "x": rng.integers(-5, 6, n).astype(float),
            "y": rng.normal(0, 1, n),
        }
    )
    pdf["a"] = pdf["a"].where(rng.random(n) > 0.1, None)
    pdf["x"] = pdf["x"].where(rng.random(n) > 0.2, np.nan)
    table = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in pdf.itertuples(index=False)]
    return pdf, spark.createDataFrame(table, SCHEMA)


WANTED = {
    ("a",): {"am": ("mean", "x"), "ad": ("nunique", "x"), "ab": ("nunique", "b")},
    ("b",): {"ba": ("nunique", "a"), "bs": ("std", "x")},
    ("a", "b"): {"abm": ("median", "x"), "abn": ("count", "x")},
    ("b", "a"): {"bax": ("max", "x"), "bac": ("nunique", "c")},
    ("c",): {"cm": ("min", "y")},
}


def test_many_keys_equal_pandas(rows):
    pdf, df = rows
    found = groups.with_statistics_by_keys(df, WANTED).toPandas().sort_values("id")
    assert len(found) == len(pdf)
    for by, outs in WANTED.items():
        for out, (stat, x) in outs.items():
            expected = pdf.groupby(list(by))[x].agg(stat).rename(out).reset_index()
            expected = pdf[["id", *by]].merge(expected, on=list(by), how="left").sort_values("id")[out]
            np.testing.assert_allclose(found[out].astype(float), expected.astype(float), rtol=1e-9, err_msg=out)


def test_many_keys_learn_from_fitted_rows_only(rows):
    pdf, df = rows
    found = groups.statistics_by_keys(df, WANTED, fit_on=F.col("id") < 100)
    counts = {r["a"]: r["ad"] for r in found[("a",)].collect()}
    assert counts == pdf[pdf["id"] < 100].groupby("a")["x"].nunique().to_dict()


def test_many_keys_of_an_empty_table_and_of_unknown_values(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert groups.with_statistics_by_keys(empty, WANTED).count() == 0
    one = spark.createDataFrame([(1, "p", None, 2, None, 1.0)], SCHEMA)
    row = groups.with_statistics_by_keys(one, WANTED).first()
    assert (row["am"], row["ad"], row["ab"], row["ba"], row["bax"], row["cm"]) == (None, 0, 0, None, None, 1.0)


def test_more_keys_than_one_pass_serves(spark, rows, monkeypatch):
    monkeypatch.setattr(groups, "SETS", 2)
    test_many_keys_equal_pandas(rows)


def test_specs_with_several_keys(rows):
    pdf, df = rows
    specs = [
        spec("group_mean", "a", "b", "y", name="both"),
        spec("subtract", "y", spec("group_mean", "c", "y"), name="off"),
        spec("group_nunique", "c", "a", name="kinds"),
    ]
    found = with_features(df, specs).toPandas().sort_values("id").set_index("id")
    np.testing.assert_allclose(found["both"].astype(float), pdf.groupby(["a", "b"])["y"].transform("mean"))
    np.testing.assert_allclose(found["off"], pdf["y"] - pdf.groupby("c")["y"].transform("mean"))
    np.testing.assert_allclose(found["kinds"], pdf.groupby("c")["a"].transform("nunique"))
    with pytest.raises(ValueError, match="keys"):
        spec("group_mean", "y")


PAIRS = [("cube", "x"), ("line", "x"), ("y", "x"), ("x", "x"), ("flat", "x"), ("none", "x"), ("part", "y")]


def _features(df):
    return df.select(
        "x",
        "y",
        (F.col("x") * F.col("x") * F.col("x")).alias("cube"),
        (F.lit(1e6) - 3 * F.col("x")).alias("line"),
        F.lit(2.0).alias("flat"),
        F.lit(None).cast("double").alias("none"),
        F.when(F.col("x") > 0, 1.0).when(F.col("y") > 0, F.col("y")).alias("part"),
    )


@pytest.mark.parametrize("key_rows", [1_000_000, 5])
def test_redundancy_equals_plain_ranks(rows, key_rows):
    wide = _features(rows[1])
    found = {r["feature"]: r for r in review.redundancy(wide, PAIRS, key_rows=key_rows, block_rows=50).collect()}
    pdf = wide.toPandas().astype(float)
    ranks = pdf.rank()
    assert len(found) == len(PAIRS)
    for feature, source in PAIRS:
        r = found[feature]
        for name, table in (("correlation", pdf), ("rank_correlation", ranks)):
            both = table[[feature, source]].dropna()
            varies = len(both) > 1 and (both.nunique() > 1).all()
            if varies:
                assert r[name] == pytest.approx(np.corrcoef(both[feature], both[source])[0, 1] if feature != source else 1, abs=1e-9)
            else:
                assert r[name] is None
    flags = {f: (found[f]["linear"], found[f]["monotone"]) for f, _ in PAIRS}
    assert flags["cube"] == (False, True) and flags["line"] == (True, True) and flags["x"] == (True, True)
    assert all(flags[f] == (False, False) for f in ("y", "flat", "none", "part"))


def test_redundancy_of_an_empty_table(spark):
    empty = _features(spark.createDataFrame([], SCHEMA))
    assert [(r["rank_correlation"], r["linear"], r["monotone"]) for r in review.redundancy(empty, PAIRS).collect()] == [(None, False, False)] * len(PAIRS)
