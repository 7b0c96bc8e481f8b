"""Lags, rolling statistics, momentum and oscillators over keyed and un-keyed series."""

from __future__ import annotations

from pyspark.sql import functions as F

from colwright.catalog.base import Book, table
from colwright.operators import ordered
from colwright.plans import spec as sp
from colwright.plans.spec import spec, with_features

book = Book()

_KEY, _ORDER = ["user_id"], ["ts", "event_id"]

#: ``x`` is the value with gaps at errors, ``y`` a second series.
_SERIES_SQL = """s AS (SELECT event_id, user_id, ts, CASE WHEN event_type <> 'error' THEN value END AS x,
  (event_id * 7919 % 1000)::DOUBLE AS y, value FROM events)"""


def _series(spark, sf):
    return table(spark, sf, "events").select(
        "event_id",
        "user_id",
        "ts",
        F.when(F.col("event_type") != "error", F.col("value")).alias("x"),
        (F.col("event_id") * 7919 % 1000).cast("double").alias("y"),
        "value",
    )


def _w(n, keyed=True, name="w"):
    part = "PARTITION BY user_id " if keyed else ""
    return f"{name} AS ({part}ORDER BY ts, event_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _o(keyed=True):
    part = "PARTITION BY user_id " if keyed else ""
    return f"o AS ({part}ORDER BY ts, event_id)"


def _add(name, specs, select, windows, keyed=True, ctes="", source="s", **options):
    """A series query; ``select`` maps the feature to its SQL over the series ``s``."""

    def run(spark, sf):
        keys = _KEY if keyed else []
        df = with_features(_series(spark, sf), specs, keys, _ORDER, **options)
        return df.select("event_id", *[F.round(s.label, 6).alias(s.label) for s in specs])

    columns = ", ".join(f"round({sql}, 6) AS {column}" for column, sql in select.items())
    book.add(name, run, f"WITH {_SERIES_SQL}{ctes} SELECT event_id, {columns} FROM {source} WINDOW {windows}")


def _gate(agg, x="x", n=5):
    return f"CASE WHEN count({x}) OVER w >= {n} THEN {agg} OVER w END"


_MEAN, _STD = _gate("avg(x)"), _gate("stddev_samp(x)")
_MIN, _MAX = _gate("min(x)"), _gate("max(x)")

#: Un-keyed series, and keyed ones with this option, are cut into blocks instead of one task per key.
_BLOCKS = {"key_rows": 0, "block_rows": 2_000}

_add("lag", [spec("lag", "x", n=3, name="v")], {"v": "lag(x, 3) OVER o"}, _o())
_add("delta", [spec("delta", "x", n=2, name="v")], {"v": "x - lag(x, 2) OVER o"}, _o())
_add("rolling_mean", [spec("rolling_mean", "x", n=5, name="v")], {"v": _MEAN}, _w(5))
_add("rolling_std", [spec("rolling_std", "x", n=5, name="v")], {"v": _STD}, _w(5))
_add("rolling_min", [spec("rolling_min", "x", n=5, name="v")], {"v": _MIN}, _w(5))
_add("rolling_max", [spec("rolling_max", "x", n=5, name="v")], {"v": _MAX}, _w(5))
_add(
    "rolling_zscore",
    [spec("rolling_zscore", "x", n=5, name="v")],
    {"v": f"(x - {_MEAN}) / nullif({_STD}, 0)"},
    _w(5),
)
_RANK_SQL = """CASE WHEN x IS NOT NULL AND len(l) >= 5 THEN
  (len(list_filter(l, lambda v: v < x)) + (len(list_filter(l, lambda v: v = x)) + 1) / 2.0) / 5.0 END"""
_LISTED = """, r AS (SELECT event_id, x, list_filter(list(x) OVER w, lambda v: v IS NOT NULL) AS l FROM s
  WINDOW {w})"""
book.add(
    "rolling_rank",
    lambda spark, sf: with_features(
        _series(spark, sf), [spec("rolling_rank", "x", n=5, name="v")], _KEY, _ORDER
    ).select("event_id", F.round("v", 6).alias("v")),
    f"WITH {_SERIES_SQL}{_LISTED.format(w=_w(5))} SELECT event_id, round({_RANK_SQL}, 6) AS v FROM r",
)
_FILLED = """, f AS (SELECT event_id, user_id, ts, x, y,
  last_value(x IGNORE NULLS) OVER ({part}ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS xf FROM s)"""
_add(
    "rate_of_change",
    [sp.rate_of_change("x", 3, "v")],
    {"v": "xf / nullif(lag(xf, 3) OVER o, 0) - 1"},
    _o(),
    ctes=_FILLED.format(part="PARTITION BY user_id "),
    source="f",
)


def _ewm_sql(part, span, reach):
    r = 1 - 2 / (span + 1)
    join = "a.user_id = b.user_id AND " if part else ""
    return f"""WITH {_SERIES_SQL}, n AS (SELECT event_id, user_id, x,
      row_number() OVER ({part}ORDER BY ts, event_id) AS i FROM s)
      SELECT a.event_id, round(sum(pow({r!r}::DOUBLE, a.i - b.i) * b.x) /
        sum(CASE WHEN b.x IS NOT NULL THEN pow({r!r}::DOUBLE, a.i - b.i) END), 6) AS v
      FROM n a JOIN n b ON {join} b.i <= a.i AND b.i > a.i - {reach} GROUP BY a.event_id"""


book.add(
    "exponential_mean",
    lambda spark, sf: with_features(_series(spark, sf), [sp.exponential_mean("x", 5, "v")], _KEY, _ORDER).select(
        "event_id", F.round("v", 6).alias("v")
    ),
    _ewm_sql("PARTITION BY user_id ", 5, 100_000),
)
book.add(
    "exponential_mean_blocks",
    lambda spark, sf: with_features(
        _series(spark, sf), [sp.exponential_mean("x", 9, "v")], [], _ORDER, **_BLOCKS
    ).select("event_id", F.round("v", 6).alias("v")),
    _ewm_sql("", 9, 400),
)
_BOTH = "CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN {c} END"
_XB, _YB = _BOTH.format(c="x"), _BOTH.format(c="y")
_add(
    "rolling_correlation",
    [spec("rolling_correlation", "x", "y", n=5, name="v")],
    {"v": f"CASE WHEN count({_XB}) OVER w >= 5 THEN corr({_XB}, {_YB}) OVER w END"},
    _w(5),
)
_add(
    "relative_to_mean",
    [spec("ratio_to_mean", "x", n=5, name="v"), spec("distance_from_mean", "x", n=5, name="d")],
    {"v": f"x / nullif({_MEAN}, 0)", "d": f"(x - {_MEAN}) / nullif({_MEAN}, 0)"},
    _w(5),
)
_add(
    "log_return",
    [spec("log_return", "x", n=1, name="v")],
    {"v": "CASE WHEN x / nullif(lag(x) OVER o, 0) > 0 THEN ln(x / nullif(lag(x) OVER o, 0)) END"},
    _o(),
)
_add("band_width", [spec("band_width", "x", n=5, name="v")], {"v": f"4 * {_STD} / nullif({_MEAN}, 0)"}, _w(5))
_add(
    "range_position",
    [spec("range_position", "x", n=5, name="v")],
    {"v": f"(x - {_MIN}) / nullif({_MAX} - {_MIN}, 0)"},
    _w(5),
)
_PAST = "p AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"
_add(
    "breakout",
    [spec("breakout_up", "x", n=5, name="up"), spec("breakout_down", "x", n=5, name="down")],
    {
        "up": "CASE WHEN count(x) OVER p >= 5 THEN CAST(x > max(x) OVER p AS INTEGER) END",
        "down": "CASE WHEN count(x) OVER p >= 5 THEN CAST(x < min(x) OVER p AS INTEGER) END",
    },
    _PAST,
)

# The same operators over all events as one series: no key, so the table is cut into blocks.
_add(
    "rolling_statistics_blocks",
    [
        spec("rolling_mean", "x", n=20, name="m"),
        spec("rolling_std", "x", n=20, name="sd"),
        spec("rolling_min", "x", n=20, name="lo"),
        spec("rolling_max", "x", n=20, name="hi"),
        spec("lag", "x", n=7, name="l"),
        spec("delta", "value", n=50, name="d"),
    ],
    {
        "m": _gate("avg(x)", n=20),
        "sd": _gate("stddev_samp(x)", n=20),
        "lo": _gate("min(x)", n=20),
        "hi": _gate("max(x)", n=20),
        "l": "lag(x, 7) OVER o",
        "d": "value - lag(value, 50) OVER o",
    },
    f"{_w(20, False)}, {_o(False)}",
    keyed=False,
    **_BLOCKS,
)
_add(
    "rolling_mean_long_frame_blocks",
    [spec("rolling_mean", "x", n=700, name="m"), spec("lag", "x", n=650, name="l")],
    {"m": _gate("avg(x)", n=700), "l": "lag(x, 650) OVER o"},
    f"{_w(700, False)}, {_o(False)}",
    keyed=False,
    key_rows=0,
    block_rows=300,
)
_add(
    "rolling_mean_hot_keys",
    [spec("rolling_mean", "x", n=5, name="v"), spec("lag", "x", n=3, name="l")],
    {"v": _MEAN, "l": "lag(x, 3) OVER o"},
    f"{_w(5)}, {_o()}",
    key_rows=50,
    block_rows=1_000,
)
_add(
    "rate_of_change_blocks",
    [sp.rate_of_change("x", 3, "v")],
    {"v": "xf / nullif(lag(xf, 3) OVER o, 0) - 1"},
    _o(False),
    keyed=False,
    ctes=_FILLED.format(part=""),
    source="f",
    **_BLOCKS,
)

# Frames of thousands of rows, over one series without a key and over users whose frames are longer than ``LONG_FRAME``.
_LONG = 5_000
_add(
    "rolling_extremes_long_frame",
    [
        spec("rolling_min", "value", n=_LONG, name="lo"),
        spec("rolling_max", "value", n=_LONG, name="hi"),
        spec("range_position", "value", n=_LONG, name="position"),
        spec("breakout_up", "y", n=_LONG - 1, name="up"),
        spec("breakout_down", "y", n=_LONG - 1, name="down"),
    ],
    {
        "lo": _gate("min(value)", "value", _LONG),
        "hi": _gate("max(value)", "value", _LONG),
        "position": f"CASE WHEN count(value) OVER w >= {_LONG} THEN (value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0) END",
        "up": f"CASE WHEN count(y) OVER p >= {_LONG - 1} THEN CAST(y > max(y) OVER p AS INTEGER) END",
        "down": f"CASE WHEN count(y) OVER p >= {_LONG - 1} THEN CAST(y < min(y) OVER p AS INTEGER) END",
    },
    f"{_w(_LONG, False)}, p AS (ORDER BY ts, event_id ROWS BETWEEN {_LONG - 1} PRECEDING AND 1 PRECEDING)",
    keyed=False,
    **_BLOCKS,
)
_add(
    "rolling_moments_long_frame",
    [
        spec("rolling_mean", "value", n=_LONG, name="m"),
        spec("rolling_std", "value", n=_LONG, name="sd"),
        spec("rolling_zscore", "value", n=_LONG, name="z"),
        spec("distance_from_mean", "value", n=_LONG, name="d"),
        spec("band_width", "value", n=_LONG, name="width"),
        spec("rolling_correlation", "value", "y", n=_LONG, name="r"),
    ],
    {
        "m": _gate("avg(value)", "value", _LONG),
        "sd": _gate("stddev_samp(value)", "value", _LONG),
        "z": f"(value - {_gate('avg(value)', 'value', _LONG)}) / nullif({_gate('stddev_samp(value)', 'value', _LONG)}, 0)",
        "d": f"(value - {_gate('avg(value)', 'value', _LONG)}) / nullif({_gate('avg(value)', 'value', _LONG)}, 0)",
        "width": f"4 * {_gate('stddev_samp(value)', 'value', _LONG)} / nullif({_gate('avg(value)', 'value', _LONG)}, 0)",
        "r": f"CASE WHEN count(value) OVER w >= {_LONG} THEN corr(value, y) OVER w END",
    },
    _w(_LONG, False),
    keyed=False,
    **_BLOCKS,
)
book.add(
    "rolling_rank_long_frame",
    lambda spark, sf: with_features(
        _series(spark, sf), [spec("rolling_rank", "y", n=_LONG, name="v")], [], _ORDER, **_BLOCKS
    ).select("event_id", F.round("v", 6).alias("v")),
    f"""WITH {_SERIES_SQL}, i AS (SELECT event_id, y, row_number() OVER (ORDER BY ts, event_id) AS i FROM s)
      SELECT a.event_id, round(CASE WHEN count(*) >= {_LONG} THEN
        (count(*) FILTER (WHERE b.y < a.y) + (count(*) FILTER (WHERE b.y = a.y) + 1) / 2.0) / {_LONG} END, 6) AS v
      FROM i a JOIN i b ON b.i <= a.i AND b.i > a.i - {_LONG} GROUP BY a.event_id, a.i""",
)

_SINCE_SQL = """SELECT event_id, CAST(date_diff('day', last_value(CASE WHEN event_type = 'purchase' THEN ts END
    IGNORE NULLS) OVER ({part}ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::DATE, ts::DATE) AS INTEGER) AS v
    FROM events"""


def _days_since_purchase(spark, sf, keys, **options):
    bought = F.when(F.col("event_type") == "purchase", F.col("ts"))
    df = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    df = ordered.running(df, keys, _ORDER, {"last": ("last", bought)}, **options)
    return df.select("event_id", F.datediff(F.col("ts").cast("date"), F.col("last").cast("date")).alias("v"))


book.add(
    "days_since_last_event",
    lambda spark, sf: _days_since_purchase(spark, sf, _KEY),
    _SINCE_SQL.format(part="PARTITION BY user_id "),
)
book.add(
    "days_since_last_event_blocks",
    lambda spark, sf: _days_since_purchase(spark, sf, [], **_BLOCKS),
    _SINCE_SQL.format(part=""),
)

# Daily bars of order prices: open, high, low, close and volume, with an index of sentiment.
_BARS_SQL = """b AS (SELECT o_orderdate AS d, min_by(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
  min(o_totalprice) AS low, max_by(o_totalprice, o_orderkey) AS close, count(*)::DOUBLE AS volume,
  (sum(o_custkey) % 101)::DOUBLE AS index_value FROM orders GROUP BY 1)"""


def _bars(spark, sf):
    price, key = F.col("o_totalprice"), F.col("o_orderkey")
    return (
        table(spark, sf, "orders")
        .groupBy(F.col("o_orderdate").alias("d"))
        .agg(
            F.min_by(price, key).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, key).alias("close"),
            F.count(F.lit(1)).cast("double").alias("volume"),
            (F.sum("o_custkey") % 101).cast("double").alias("index_value"),
        )
    )


def _bar_query(name, specs, select, windows, ctes=""):
    def run(spark, sf):
        df = with_features(_bars(spark, sf), specs, [], ["d"], key_rows=0, block_rows=500)
        return df.select("d", *[F.round(s.label, 6).alias(s.label) for s in specs])

    columns = ", ".join(f"round({sql}, 6) AS {column}" for column, sql in select.items())
    source = "t" if ctes else "b"
    book.add(name, run, f"WITH {_BARS_SQL}{ctes} SELECT d, {columns} FROM {source} WINDOW {windows}")


_D = "o AS (ORDER BY d)"


def _dw(n, name="w"):
    return f"{name} AS (ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


_bar_query(
    "average_true_range",
    [sp.average_true_range("high", "low", "close", 14, "v")],
    {"v": "CASE WHEN count(tr) OVER w >= 14 THEN avg(tr) OVER w END"},
    _dw(14),
    """, t AS (SELECT d, greatest(high - low, abs(high - lag(close) OVER (ORDER BY d)),
      abs(low - lag(close) OVER (ORDER BY d))) AS tr FROM b)""",
)
_bar_query(
    "strength_index",
    [sp.strength_index("close", 14, "v")],
    {
        "v": """100 * CASE WHEN count(g) OVER w >= 14 THEN avg(g) OVER w END /
          nullif(CASE WHEN count(g) OVER w >= 14 THEN avg(g) OVER w + avg(l) OVER w END, 0)"""
    },
    _dw(14),
    """, t AS (SELECT d, CASE WHEN c IS NOT NULL THEN greatest(c, 0) END AS g,
      CASE WHEN c IS NOT NULL THEN greatest(-c, 0) END AS l
      FROM (SELECT d, close - lag(close) OVER (ORDER BY d) AS c FROM b))""",
)
_bar_query(
    "volume_confirmation",
    [sp.volume_confirmation("close", "volume", 5, "v")],
    {
        "v": """(close / nullif(lag(close) OVER o, 0) - 1) * volume /
          CASE WHEN count(volume) OVER w >= 5 THEN avg(volume) OVER w END"""
    },
    f"{_D}, {_dw(5)}",
)


@book.query(
    "contrarian_flag",
    f"""WITH {_BARS_SQL}, p AS (SELECT d, index_value, CASE WHEN count(close) OVER w >= 10 THEN
        (close - min(close) OVER w) / nullif(max(close) OVER w - min(close) OVER w, 0) END AS position
        FROM b WINDOW {_dw(10)})
      SELECT d, CAST(index_value < 25 AND position > 0.5 AS INTEGER) AS v FROM p""",
)
def _contrarian(spark, sf):
    from colwright.operators import rolling

    position = spec("range_position", "close", n=10, name="position")
    df = with_features(_bars(spark, sf), [position], [], ["d"], key_rows=0, block_rows=500)
    return df.select("d", rolling.contrarian_flag(F.col("position"), F.col("index_value"), 25, 0.5).alias("v"))


_bar_query(
    "bar_breakout",
    [spec("breakout_up", "close", n=20, name="up"), spec("breakout_down", "close", n=20, name="down")],
    {
        "up": "CASE WHEN count(close) OVER p >= 20 THEN CAST(close > max(close) OVER p AS INTEGER) END",
        "down": "CASE WHEN count(close) OVER p >= 20 THEN CAST(close < min(close) OVER p AS INTEGER) END",
    },
    "p AS (ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)",
)


def flagship(spark, sf):
    """Rolling mean, lag and rate of change per user, with the event type's frequency and mean value."""
    specs = [
        spec("rolling_mean", "value", n=5, name="value_mean_5"),
        spec("lag", "value", n=1, name="value_lag_1"),
        sp.rate_of_change("value", 3, "value_change_3"),
        spec("frequency", "event_type", name="type_share"),
        spec("group_mean", "event_type", "value", name="type_mean"),
    ]
    df = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    out = with_features(df, specs, _KEY, _ORDER)
    return out.select("event_id", *[F.round(s.label, 6).alias(s.label) for s in specs])


book.add(
    "event_features",
    flagship,
    f"""WITH n AS (SELECT count(*) AS total FROM events), g AS (SELECT event_type, count(*) AS c, avg(value) AS m
      FROM events GROUP BY 1)
    SELECT event_id, round(CASE WHEN count(value) OVER w >= 5 THEN avg(value) OVER w END, 6) AS value_mean_5,
      round(lag(value) OVER o, 6) AS value_lag_1,
      round(value / nullif(lag(value, 3) OVER o, 0) - 1, 6) AS value_change_3,
      round(c / total, 6) AS type_share, round(m, 6) AS type_mean
    FROM events JOIN g USING (event_type), n WINDOW {_o()}, {_w(5)}""",
)
