"""Functions, groups, quantiles, encoders, folds and metrics against pandas or by their properties."""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colwright.functions import custom, dates, numeric as num, programs, text
from colwright.operators import encode, folds, groups, lookup, metrics, models, profile, quantiles
from colwright.plans import seeds
from colwright.plans.spec import spec, with_features
from colwright.sources import metadata, tables


@pytest.fixture(scope="module")
def grouped():
    rng = np.random.default_rng(11)
    n = 500
    pdf = pd.DataFrame(
        {
            "id": range(n),
            "g": rng.choice(["a", "b", "c"], n, p=[0.6, 0.3, 0.1]),
            "x": rng.integers(0, 30, n).astype(float),
            "h": rng.choice(["u", "v"], n),
        }
    )
    pdf.loc[[3, 50], "g"] = None
    pdf.loc[[7, 8, 200], "x"] = np.nan
    pdf.loc[n] = [n, "single", 5.0, "u"]
    return pdf


def _df(spark, pdf):
    return tables.clean(spark.createDataFrame(pdf, "id long, g string, x double, h string"))


def _column(df, name):
    return df.orderBy("id").toPandas()[name].astype(float)


def _same(got, want, **tolerance):
    np.testing.assert_allclose(got.fillna(-9e9), want.astype(float).fillna(-9e9), **(tolerance or {"rtol": 1e-12}))


@pytest.mark.parametrize("stat", ["min", "max", "mean", "median", "std", "nunique"])
def test_group_statistics(spark, grouped, stat):
    df = groups.with_group_statistics(_df(spark, grouped), ["g"], {"v": (stat, "x")})
    want = grouped.groupby("g")["x"].transform(stat)
    want[grouped.g.isna()] = np.nan
    _same(_column(df, "v"), want)


def test_medians_of_large_groups(spark, grouped, monkeypatch):
    monkeypatch.setattr(groups, "GROUP_VALUES", 0)
    monkeypatch.setattr(quantiles, "GROUP_VALUES", 0)
    monkeypatch.setattr(quantiles, "_ACCURACY", (20, 50))
    df = groups.with_group_statistics(_df(spark, grouped), ["g"], {"v": ("median", "x"), "m": ("mean", "x")})
    _same(_column(df, "v"), grouped.groupby("g")["x"].transform("median"))


@pytest.mark.parametrize("accuracy", [20, 100, 10_000])
def test_bracketed_quantiles_are_exact(spark, accuracy):
    rng = np.random.default_rng(accuracy)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b"], 3000, p=[0.9, 0.1]), "x": rng.normal(size=3000).round(2)})
    probs = [0.0, 0.01, 0.25, 0.5, 0.77, 1.0]
    q = quantiles.exact_quantiles(spark.createDataFrame(pdf), "x", probs, ["g"], group_values=0, accuracy=accuracy)
    for row in q.collect():
        want = pdf[pdf.g == row["g"]]["x"].quantile(probs).tolist()
        np.testing.assert_allclose(row["q"], want, atol=1e-12)
    whole = quantiles.exact_quantiles(spark.createDataFrame(pdf), "x", probs, group_values=0, accuracy=accuracy)
    np.testing.assert_allclose(whole.first()["q"], pdf["x"].quantile(probs).tolist(), atol=1e-12)


def test_quantile_bins_like_qcut(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"id": range(300), "x": rng.normal(size=300)})
    got = quantiles.quantile_bins(spark.createDataFrame(pdf), "x", 7, "b").orderBy("id").toPandas()["b"]
    assert got.tolist() == pd.qcut(pdf["x"], 7, labels=False).tolist()
    with pytest.raises(ValueError):
        quantiles.quantile_edges(spark.createDataFrame(pd.DataFrame({"x": [1.0] * 10 + [2.0]})), "x", 4)


@pytest.mark.parametrize("options", [{}, {"key_rows": 0, "block_rows": 5}], ids=["keys", "blocks"])
def test_group_rank(spark, grouped, options):
    df = quantiles.group_rank(_df(spark, grouped), ["g"], "x", "v", **options)
    want = grouped.groupby("g")["x"].transform("rank")
    _same(_column(df, "v"), want)


def test_frequency_and_residual(spark, grouped):
    df = _df(spark, grouped)
    _same(_column(groups.with_frequency(df, "g", "v"), "v"), grouped["g"].map(grouped["g"].value_counts(normalize=True)))
    _same(_column(groups.with_frequency(df, "x", "v", relative=False), "v"), grouped["x"].map(grouped["x"].value_counts()))
    _same(_column(groups.with_residual(df, "x", "v"), "v"), grouped["x"] - grouped["x"].mean(), atol=1e-9)
    both = grouped["g"].fillna("nan").astype(str) + "_" + grouped["h"]
    _same(_column(groups.with_combined_frequency(df, ["g", "h"], "v"), "v"), both.map(both.value_counts(normalize=True)))


def test_statistics_are_learned_from_the_fitted_rows(spark, grouped):
    df = groups.with_group_statistics(_df(spark, grouped), ["g"], {"v": ("mean", "x")}, fit_on=F.col("id") < 100)
    train = grouped[grouped.id < 100].groupby("g")["x"].mean()
    _same(_column(df, "v"), grouped["g"].map(train))


def test_out_of_fold_means(spark, grouped):
    df = _df(spark, grouped).withColumn("fold", (F.col("id") % 3).cast("int"))
    got = groups.with_out_of_fold_mean(df, ["g"], "x", "fold", "v")
    for j in range(3):
        train = grouped[grouped.id % 3 != j].groupby("g")["x"].mean()
        part = got.filter(F.col("fold") == j).orderBy("id").toPandas()
        _same(part["v"], part["g"].map(train), rtol=1e-9)


def test_numeric_edges(spark):
    rows = [(0.0, 0.0), (-2.5, 0.5), (None, 1.0), (float("inf"), 2.0), (float("nan"), None), (0.125, 0.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    out = tables.clean(df).select(
        num.ratio(F.col("a"), F.col("b")).alias("ratio"),
        num.ratio_guarded(F.col("a"), F.col("b")).alias("guarded"),
        num.minimum(F.col("a"), F.col("b")).alias("least"),
        num.round_half_even(F.col("a")).alias("rounded"),
        num.log_plain(F.col("a")).alias("log"),
        num.sqrt_signed(F.col("a")).alias("root"),
        num.square(F.col("a") * 1e200).alias("square"),
    ).collect()
    assert [r["ratio"] for r in out] == [None, -5.0, None, None, None, None]
    assert [r["guarded"] for r in out] == [0.0, -5.0, None, None, None, 0.125]
    assert [r["least"] for r in out] == [0.0, -2.5, None, None, None, 0.0]
    assert [r["rounded"] for r in out] == [0.0, -2.5, None, None, None, 0.12]
    assert out[1]["log"] is None and out[1]["root"] == -math.sqrt(2.5)
    assert out[1]["square"] is None


def test_correlation_with_a_constant_is_missing(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (1.0, 4.0, 5.0), (1.0, 5.0, None)], "c double, x double, y double")
    rows = {r["feature"]: r for r in metrics.correlations(df, ["c", "x"], "y").collect()}
    assert rows["c"]["correlation"] is None and rows["c"]["n"] == 2
    assert rows["x"]["correlation"] == pytest.approx(1.0)


def test_sentence_and_text(spark):
    df = spark.createDataFrame([(1, ' "a." ', None, 3)], "n int, word string, gap string, y int")
    row = df.select(
        text.row_sentence(["n", "word", "gap"]).alias("long"), text.row_sentence(["n", "y"]).alias("short")
    ).first()
    assert row["long"] == "If n is 1, word is a.,  Then gap is nan."
    assert row["short"] == "If n is 1, "


def test_row_function(spark):
    shout = custom.row_function(lambda v: None if v is None else v.upper() + "!", "string")
    df = spark.createDataFrame([("a",), (None,)], "v string")
    assert [r[0] for r in df.select(shout("v")).collect()] == ["A!", None]


def test_magnitudes(spark):
    df = spark.createDataFrame([("1.5K",), ("2M",), ("3,000",), ("0.1B",), ("x",), (None,)], "v string")
    got = [r[0] for r in df.select(dates.parse_magnitude(F.col("v"))).collect()]
    assert got == [1500.0, 2e6, 3000.0, 1e8, None, None]


def test_program_text(spark):
    code = "def f():\n  df_output['a'] = 1\n  df_output[\"b c\"]==2\n  for x in y:\n  z.shift( -1)\n f_v2(x)"
    df = spark.createDataFrame([(code,)], "code string")
    row = df.select(
        programs.assigned_features(F.col("code")).alias("names"),
        programs.has_loop(F.col("code")).alias("loop"),
        programs.looks_ahead(F.col("code")).alias("ahead"),
        programs.calls_ancestor(F.col("code"), "f").alias("ancestor"),
    ).first()
    assert list(row["names"]) == ["a"] and row["loop"] and row["ahead"] and row["ancestor"]


def test_label_codes(spark, grouped):
    df = _df(spark, grouped)
    got = encode.label_encode(df, "g", "v").orderBy("id").toPandas()["v"]
    order = {v: i for i, v in enumerate(sorted(grouped["g"].dropna().unique()))}
    assert got.tolist() == [order.get(v, len(order)) for v in grouped["g"]]
    large = encode.category_codes(df, "g", key_rows=0).orderBy("code").collect()
    assert [(r["value"], r["code"]) for r in large] == sorted(order.items(), key=lambda e: e[1])


def test_train_mappings_give_unseen_values_minus_one(spark, grouped):
    train, test, mappings = encode.train_test_tables(_df(spark, grouped), F.col("id") < 450, ["id"])
    assert train.count() == 450 and test.count() == 51
    last = test.filter("id = 500").first()
    assert last["g"] == -1.0 and last["x"] == 5.0
    assert set(mappings) == {"g", "h"}
    filled, names = encode.impute_for_trees(train, ["x"])
    assert names == ["x", "x__missing"]
    assert filled.filter("x = -999 and x__missing = 1").count() == 3


def test_folds_partition_rows(spark, grouped):
    df = _df(spark, grouped)
    got = folds.stratified_folds(df, "h", ["id"], 4).toPandas()
    assert len(got) == len(grouped) and got["id"].is_unique
    counts = got.groupby(["h", "fold"]).size().unstack()
    assert (counts.max(axis=1) - counts.min(axis=1) <= 1).all()
    again = folds.stratified_folds(df.repartition(5), "h", ["id"], 4).toPandas()
    assert got.set_index("id")["fold"].sort_index().tolist() == again.set_index("id")["fold"].sort_index().tolist()
    sizes = folds.shuffled_folds(df, ["id"], 4).groupBy("fold").count().toPandas()["count"]
    assert sizes.max() - sizes.min() <= 1


def test_time_folds_train_on_the_past(spark, grouped):
    got = folds.time_folds(_df(spark, grouped), ["id"], 4).toPandas().sort_values("id")
    n, size = len(got), len(got) // 5
    want = [-1 if i < n - 4 * size else (i - (n - 4 * size)) // size for i in range(n)]
    assert got["fold"].tolist() == want


def test_sampling_is_repeatable(spark, grouped):
    df = _df(spark, grouped)
    a = {r["id"] for r in folds.sample_rows(df, ["id"], 10).collect()}
    b = {r["id"] for r in folds.sample_rows(df.repartition(7), ["id"], 10).collect()}
    assert a == b and len(a) == 10


def test_feature_scores_match_numpy(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": rng.normal(size=800), "b": rng.normal(size=800) + 1e6, "k": 3.0})
    pdf["y"] = pdf["a"] * 2 + rng.normal(size=800) + 1e5
    pdf["s"] = np.sin(pdf["a"] * 3)
    rows = {r["feature"]: r for r in metrics.feature_scores(spark.createDataFrame(pdf), ["a", "b", "k", "s"], "y").collect()}
    for c in ("a", "b", "s"):
        assert rows[c]["correlation"] == pytest.approx(np.corrcoef(pdf[c], pdf["y"])[0, 1], abs=1e-9)
    assert rows["k"]["correlation"] is None
    assert rows["k"]["eta_squared"] == pytest.approx(0.0, abs=1e-12)
    assert rows["a"]["eta_squared"] > 0.6 > rows["b"]["eta_squared"]


def test_trees_learn(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"id": range(300), "a": rng.normal(size=300), "c": rng.choice(["u", "v"], 300)})
    pdf["y"] = pdf["a"] * 3 + (pdf["c"] == "u") * 5
    pdf["label"] = np.where(pdf["y"] > 2, "high", "low")
    df = folds.shuffled_folds(spark.createDataFrame(pdf), ["id"], 2)
    scores = models.cross_validate(df, ["a", "c"], "y", "fold", 2, "series", rounds=5).collect()
    assert len(scores) == 2 and all(r["score"] > -0.6 for r in scores)
    scores = models.cross_validate(df, ["a", "c"], "label", "fold", 2, "classification", rounds=3).collect()
    assert all(r["score"] > 0.8 for r in scores)


def test_profile(spark, tmp_path):
    pdf = pd.DataFrame({"a_b": [1, 2, 3], "flag": [0, 1, 1], "w": ["x", None, "y"], "Result": [1, 2, 3]})
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a_b int, flag int, w string, Result int")
    kinds = {r["name"]: r["kind"] for r in profile.infer_kinds(profile.column_statistics(df)).collect()}
    assert kinds == {"a_b": "numeric", "flag": "categorical", "w": "categorical", "Result": "categorical"}
    lines = {(r["name"], r["position"]): r["line"] for r in profile.profile_lines(df, target="Result").collect()}
    assert lines == {
        ("a_b", 0): "- a_b: a b (numerical variable within range [1, 3])",
        ("flag", 0): "- flag: flag (categorical variable with categories)",
        ("flag", 1): "0",
        ("flag", 2): "1",
        ("w", 0): "- w: w (categorical variable with categories)",
        ("w", 1): "x",
        ("w", 2): "y",
    }


def test_metadata_files(spark, tmp_path):
    (tmp_path / "flat.json").write_text(json.dumps({"left-weight": "Left weight", "n": "A number"}, indent=1))
    listed = {
        "continuous_features": [{"name": "close", "description": "Price", "context": "daily"}, {"type": "continuous"}],
        "categorical_features": [{"name": "mood", "type": "categorical"}],
        "temporal_features": [{"name": "date", "type": "datetime", "note": "n"}],
    }
    (tmp_path / "listed.json").write_text(json.dumps(listed, indent=1))
    flat = {r["name"]: r["description"] for r in metadata.read_metadata(spark, str(tmp_path / "flat.json")).collect()}
    assert flat == {"left-weight": "Left weight", "n": "A number"}
    rows = {r["name"]: r for r in metadata.read_metadata(spark, str(tmp_path / "listed.json")).collect()}
    assert set(rows) == {"close", "mood", "date"}
    assert rows["close"]["type"] == "continuous" and rows["date"]["note"] == "n"
    told = lookup.describe_columns(
        spark.createDataFrame([("close",), ("Left_Weight",)], "name string"),
        metadata.read_metadata(spark, str(tmp_path / "listed.json")),
    )
    assert {r["name"]: r["description"] for r in told.collect()} == {
        "close": "Price (daily)",
        "Left_Weight": "Left Weight",
    }


def test_csv_with_odd_column_names(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("Unnamed: 0,date,Left-Weight,Right-Weight,now%3F,Class Name\n0,2020-01-01,5,3,1,L\n1,2020-01-02,,4,0,R\n")
    df = tables.drop_stray_columns(tables.read_csv(spark, str(path)))
    features, target = tables.split_features(df)
    assert features.columns == ["Left-Weight", "Right-Weight", "now%3F"] and target.columns == ["Class Name"]
    out = with_features(df, [seeds.SEEDS["balance-scale"]]).orderBy("date").toPandas()
    assert out["weight_difference"][0] == 2.0 and math.isnan(out["weight_difference"][1])
    filled = tables.as_doubles(tables.fill_missing(features))
    assert sorted(r["Left-Weight"] for r in filled.collect()) == [0.0, 5.0]


def test_seed_features(spark):
    assert len(seeds.SEEDS) == 26
    for problem, seed in seeds.SEEDS.items():
        kind = "string" if problem == "tic-tac-toe" else "double"
        schema = ", ".join(f"`{c}` {kind}" for c in seed.inputs)
        row = tuple("x" if kind == "string" else float(i + 2) for i in range(len(seed.inputs)))
        df = spark.createDataFrame([row], schema)
        assert with_features(df, [seed]).first()[seed.name] is not None, problem


def test_equal_specs_are_computed_once(spark):
    a, b = spec("log_safe", "x", name="first"), spec("log_safe", "x", name="second")
    assert a.key == b.key
    df = with_features(spark.createDataFrame([(1.0,)], "x double"), [a, b, spec("square", a, name="third")])
    row = df.first()
    assert df.columns == ["x", "first", "second", "third"]
    assert row["first"] == row["second"] and row["third"] == pytest.approx(math.log(2) ** 2)
    with pytest.raises(ValueError):
        spec("no_such_operator", "x")
