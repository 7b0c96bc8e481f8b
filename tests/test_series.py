"""Series operators against pandas, on keys with gaps, ties and constant stretches, whole and cut into blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colwright.operators import ordered
from colwright.plans import spec as sp
from colwright.plans.spec import spec, with_features


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(7)
    n = 400
    pdf = pd.DataFrame(
        {
            "t": rng.permutation(n),
            "k": np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b"], n)),
            "x": rng.integers(-20, 20, n) / 10,
            "y": rng.normal(size=n),
        }
    )
    pdf.loc[rng.choice(n, 25, replace=False), "x"] = np.nan
    pdf.loc[(pdf.t > 100) & (pdf.t < 130), "x"] = 1.5
    return pdf.sort_values("t").reset_index(drop=True)


def _spark_frame(spark, pdf):
    df = spark.createDataFrame(pdf)
    return df.withColumn("x", F.when(~F.isnan("x"), F.col("x")))


def _specs():
    return {
        "lag": spec("lag", "x", n=2),
        "delta": spec("delta", "x", n=2),
        "mean": spec("rolling_mean", "x", n=5),
        "std": spec("rolling_std", "x", n=5),
        "min": spec("rolling_min", "x", n=5),
        "max": spec("rolling_max", "x", n=5),
        "rank": spec("rolling_rank", "x", n=5),
        "corr": spec("rolling_correlation", "x", "y", n=5),
        "change": sp.rate_of_change("x", 3),
        "ewm": sp.exponential_mean("x", 5),
    }


def _expected(g):
    x = g["x"]
    roll = x.rolling(5)
    known = x.ffill()
    both = x.rolling(5).corr(g["y"].where(x.notna()))
    out = pd.DataFrame(
        {
            "t": g["t"],
            "lag": x.shift(2),
            "delta": x.diff(2),
            "mean": roll.mean(),
            "std": roll.std(),
            "min": roll.min(),
            "max": roll.max(),
            "rank": roll.rank(pct=True),
            "corr": both,
            "change": known / known.shift(3) - 1,
            "ewm": x.ewm(span=5).mean(),
        }
    )
    return out.replace([np.inf, -np.inf], np.nan)


@pytest.mark.parametrize("options", [{}, {"key_rows": 0, "block_rows": 150}], ids=["keys", "blocks"])
@pytest.mark.parametrize("keyed", [True, False])
def test_series_match_pandas(spark, frame, options, keyed):
    specs = [sp.FeatureSpec(s.op, s.inputs, s.params, name) for name, s in _specs().items()]
    df = with_features(_spark_frame(spark, frame), specs, ["k"] if keyed else [], ["t"], **options)
    got = df.select("t", *_specs()).toPandas().sort_values("t").reset_index(drop=True)
    parts = [g for _, g in frame.groupby("k")] if keyed else [frame]
    want = pd.concat([_expected(g) for g in parts]).sort_values("t").reset_index(drop=True)
    for name in _specs():
        a, b = got[name].astype(float), want[name].astype(float)
        if name == "corr":
            # where a frame is almost constant, pandas' running sums leave noise instead of a missing value
            both = a.notna() & b.notna()
            assert both.sum() > 100
            np.testing.assert_allclose(a[both], b[both], atol=1e-6)
            continue
        if name == "std":
            np.testing.assert_allclose(a.fillna(-1), b.fillna(-1), atol=1e-6)
            continue
        np.testing.assert_allclose(a.fillna(-9e9), b.fillna(-9e9), atol=1e-9, err_msg=name)


def test_later_rows_change_nothing(spark, frame):
    specs = [sp.FeatureSpec(s.op, s.inputs, s.params, name) for name, s in _specs().items()]
    whole = with_features(_spark_frame(spark, frame), specs, ["k"], ["t"]).filter("t < 250")
    cut = with_features(_spark_frame(spark, frame[frame.t < 250]), specs, ["k"], ["t"])
    a = whole.select("t", *_specs()).toPandas().sort_values("t").reset_index(drop=True)
    b = cut.select("t", *_specs()).toPandas().sort_values("t").reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b)


@pytest.mark.parametrize("n", [0, -1])
def test_future_rows_are_refused(n):
    with pytest.raises(ValueError):
        spec("lag", "x", n=n)


def test_exponential_mean_over_long_gaps_and_series(spark):
    n = 6000
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"t": np.arange(n), "x": rng.normal(size=n) + 100})
    pdf.loc[1000:4200, "x"] = np.nan
    want = pdf["x"].ewm(span=3).mean()
    for options in ({}, {"key_rows": 0, "block_rows": 700}):
        df = with_features(_spark_frame(spark, pdf), [sp.exponential_mean("x", 3, "e")], [], ["t"], **options)
        got = df.orderBy("t").toPandas()["e"]
        np.testing.assert_allclose(got.astype(float), want, rtol=1e-12)


def test_frames_longer_than_a_block_span_blocks(spark, frame):
    asked = [spec("rolling_mean", "x", n=60, name="m"), spec("lag", "x", n=130, name="l")]
    df = _spark_frame(spark, frame)
    rows = [with_features(df, asked, [], ["t"], **o).orderBy("t").toPandas()[["m", "l"]] for o in ({}, {"key_rows": 0, "block_rows": 50})]
    pd.testing.assert_frame_equal(rows[0], rows[1])


def test_layout_numbers_rows_in_order(spark, frame):
    layout = ordered.lay_out(_spark_frame(spark, frame), ["k"], ["t"], block_rows=64)
    got = layout.table.orderBy(ordered.POS).select("k", "t", ordered.POS, ordered.BLOCK).toPandas()
    want = frame.sort_values(["k", "t"]).reset_index(drop=True)
    assert got["t"].tolist() == want["t"].tolist()
    assert got[ordered.POS].tolist() == list(range(len(want)))
    assert (got[ordered.BLOCK] == got[ordered.POS] // 64).all()


def test_running_values_match_with_and_without_blocks(spark, frame):
    df = _spark_frame(spark, frame)
    columns = {
        "total": ("sum", F.coalesce("x", F.lit(0.0))),
        "best": ("max", F.col("x")),
        "last_known": ("last", F.col("x")),
    }
    a = ordered.running(df, ["k"], ["t"], columns).orderBy("t").toPandas()
    b = ordered.running(df, ["k"], ["t"], columns, key_rows=0, block_rows=37).orderBy("t").toPandas()
    pd.testing.assert_frame_equal(a[["t", *columns]], b[["t", *columns]], check_exact=False)


def test_null_keys_are_one_series(spark):
    pdf = pd.DataFrame({"t": range(60), "k": [None if i % 2 else "a" for i in range(60)], "x": np.arange(60.0)})
    df = spark.createDataFrame(pdf, "t long, k string, x double")
    for options in ({}, {"key_rows": 0, "block_rows": 7}):
        got = ordered.running(df, ["k"], ["t"], {"s": ("sum", F.col("x"))}, **options).orderBy("t").toPandas()["s"]
        want = pdf.groupby("k", dropna=False)["x"].cumsum()
        assert got.tolist() == want.tolist()


def _every_spec():
    """One spec per operator of the registry, nested operators included."""
    one = ("absolute", "log_safe", "log", "sqrt", "signed_sqrt", "sigmoid", "square", "round", "linear")
    two = ("minimum", "maximum", "add", "subtract", "absolute_difference", "multiply", "mean", "ratio", "ratio_guarded")
    specs = [spec(op, "x") for op in one] + [spec(op, "x", "y") for op in two]
    specs += [spec("power", "x", exponent=2), spec("clip", "x", low=-1, high=1), spec("above", "x", threshold=0.5)]
    specs += [spec("scale_range", "x", low=-2, high=2), spec("combine", "k", "h")]
    specs += [spec("recode", "h", mapping=(("u", "1"),), default="0"), spec("magnitude", "m")]
    specs += [spec(op, "d") for op in ("day_of_week", "month", "quarter", "year")]
    specs += [spec("days_since", "d", event="2020-01-01")]
    specs += [spec(op, spec("month", "d"), period=12) for op in ("cyclic_sin", "cyclic_cos")]
    rolled = ("mean", "std", "min", "max", "zscore", "rank")
    specs += [spec(f"rolling_{r}", "x", n=4) for r in rolled] + [spec("rolling_correlation", "x", "y", n=4)]
    specs += [spec(op, "y", n=3) for op in ("lag", "delta", "ratio_to_mean", "distance_from_mean", "log_return")]
    specs += [spec(op, "y", n=3) for op in ("band_width", "range_position", "breakout_up", "breakout_down")]
    specs += [sp.rate_of_change("x", 2), sp.volume_confirmation("x", "y", 3), sp.exponential_mean("x", 4)]
    specs += [sp.strength_index("y", 5), sp.average_true_range("y", "x", "x", 3)]
    specs += [sp.group_deviation("x", "h"), sp.combined_frequency("k", "h")]
    specs += [spec(f"group_{s}", "h", "x") for s in ("min", "max", "mean", "median", "std", "nunique", "count")]
    specs += [spec("group_rank", "h", "x"), spec("frequency", "x"), spec("value_count", "x"), spec("residual", "x")]
    specs += [spec("range_scaled", "y"), spec("quantile_bin", "y", q=4)]
    specs += [spec("group_mean", "h", spec("rolling_mean", spec("log_safe", "x"), n=3))]
    return specs


def test_every_operator_agrees_on_keys_and_blocks(spark, frame):
    pdf = frame.assign(h=np.where(frame.t % 3 == 0, "u", "v"), m="1.5K", y=frame.y.abs() + 1)
    df = _spark_frame(spark, pdf).withColumn("d", F.expr("date_add(date'2020-02-01', cast(t as int))"))
    specs = _every_spec()
    used = {s.op for s in sp._ordered(specs).values()}
    known = {*sp.SCALAR, *sp.SERIES, *sp.GROUP, *sp.TABLE, "known", "exponential_part"}
    assert used == known
    results = []
    for options in ({}, {"key_rows": 0, "block_rows": 90}):
        out = with_features(df, specs, ["k"], ["t"], **options).select("t", *[F.col(f"`{s.label}`") for s in specs])
        results.append(out.toPandas().sort_values("t").reset_index(drop=True))
    pd.testing.assert_frame_equal(*results, check_exact=False, rtol=1e-9)
    assert not any(results[0][s.label].isna().all() for s in specs)


# --- long frames


def _long_series(rows=3000, offset=0.0):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"t": np.arange(rows), "k": np.where(rng.random(rows) < 0.7, "hot", "b"), "x": rng.integers(-20, 20, rows) / 10 + offset})
    pdf["y"] = rng.normal(size=rows) + pdf.x
    pdf.loc[[40, 41, rows // 2, rows - 700], "x"] = np.nan
    pdf.loc[(pdf.t > 2000) & (pdf.t < 2200), "x"] = 1.5 + offset
    return pdf


_N = 150


def _long_specs():
    ops = ("rolling_mean", "rolling_std", "rolling_min", "rolling_max", "rolling_rank", "rolling_zscore", "range_position", "breakout_up", "breakout_down")
    return [spec(op, "x", n=_N, name=op) for op in ops] + [spec("rolling_correlation", "x", "y", n=_N, name="rolling_correlation")]


def _long_expected(g):
    x = g.x
    roll, past = x.rolling(_N), x.shift(1).rolling(_N)
    out = pd.DataFrame({"t": g.t, "rolling_mean": roll.mean(), "rolling_std": roll.std(), "rolling_min": roll.min(), "rolling_max": roll.max()})
    out["rolling_rank"] = roll.rank(pct=True)
    std = out.rolling_std.where(out.rolling_std > 1e-9)
    out["rolling_zscore"] = (x - out.rolling_mean) / std
    width = out.rolling_max - out.rolling_min
    out["range_position"] = (x - out.rolling_min) / width.where(width > 0)
    out["breakout_up"] = (x > past.max()).astype(float).where(past.max().notna() & x.notna())
    out["breakout_down"] = (x < past.min()).astype(float).where(past.min().notna() & x.notna())
    out["rolling_correlation"] = x.rolling(_N).corr(g.y.where(x.notna())).where(roll.count() >= _N)
    return out


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("options", [{}, {"key_rows": 0, "block_rows": 400}, {"key_rows": 0, "block_rows": 60}])
def test_long_frames_equal_pandas(spark, keys, options):
    pdf = _long_series()
    made = with_features(_spark_frame(spark, pdf), _long_specs(), keys, ["t"], **options)
    got = made.select("t", *[s.label for s in _long_specs()]).toPandas().sort_values("t").reset_index(drop=True)
    groups = [g for _, g in pdf.groupby("k")] if keys else [pdf]
    want = pd.concat([_long_expected(g) for g in groups]).sort_values("t").reset_index(drop=True)
    flat = (pdf.t >= 2150) & (pdf.t <= 2200)  # a constant stretch: deviations of both are noise
    for c in want.columns:
        a, b = got[c].astype(float), want[c].astype(float)
        if c in ("rolling_zscore", "rolling_correlation"):
            a, b = a[~flat], b[~flat]
        np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-9, err_msg=c)


def test_long_frames_keep_their_digits(spark, monkeypatch):
    """Large offsets do not cancel: the merged frames are as exact as frames that are evaluated row by row."""
    from colwright.operators import rolling

    pdf = _long_series(2000, 1e9)
    specs = [spec(op, "x", n=_N, name=op) for op in ("rolling_mean", "rolling_std")]

    def run():
        return with_features(_spark_frame(spark, pdf), specs, [], ["t"]).select("t", *[s.label for s in specs]).toPandas().sort_values("t")

    merged = run()
    monkeypatch.setattr(rolling, "LONG_FRAME", 10_000)
    plain = run()
    exact = pdf.x - 1e9
    np.testing.assert_allclose(merged.rolling_mean, plain.rolling_mean, rtol=1e-12)
    # values near 1e9 hold about seven decimals themselves
    np.testing.assert_allclose(merged.rolling_std.to_numpy(), exact.rolling(_N).std().to_numpy(), rtol=1e-6, atol=1e-7)


def test_range_ranks_equal_counting():
    from colwright.operators.rolling import range_ranks

    rng = np.random.default_rng(1)
    codes = rng.integers(0, 37, 500)
    low = rng.integers(0, 500, 300)
    high = low + rng.integers(0, 500 - low + 1)
    of = rng.integers(0, 40, 300)
    less, equal = range_ranks(codes, low, high, np.minimum(of, 36))
    for a, b, c, x, y in zip(low, high, np.minimum(of, 36), less, equal):
        assert (x, y) == ((codes[a:b] < c).sum(), (codes[a:b] == c).sum())
