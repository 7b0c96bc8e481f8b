"""Features along a time window: lags, rolling statistics, momentum and oscillators.

A feature is a formula over *frames*: window aggregates that are computed once per series and length, however many
features use them. Every frame holds the current and earlier rows only. A rolling statistic over ``n`` rows is NULL
until its frame holds ``n`` known values.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from colwright.functions import numeric as num


def _steps(n: int, least: int = 1) -> int:
    if int(n) != n or n < least:
        raise ValueError(f"a window needs at least {least} past row(s), not {n}: later rows must not be read")
    return int(n)


#: A frame of more rows than this is put together from running values instead of being evaluated anew for each row.
LONG_FRAME = 128

#: What two parts of a frame keep of their values: ``count``, and with it what the other statistics are merged from.
_PARTS = {
    "count": {},
    "min": {"least": F.min},
    "max": {"most": F.max},
    "mean": {"mean": F.avg},
    "std": {"mean": F.avg, "var": F.var_pop},
}


class Frames:
    """Window aggregates over one window specification, each under its own column name.

    ``keys`` and ``order`` are the columns of the window. With them, frames of more than ``LONG_FRAME`` rows are *segmented*: rows
    are numbered and cut into segments as long as the frame, and two running scans, one from the start and one from the end of
    each segment, keep count, extremes, mean and deviation. A frame is the head of one segment and the tail of the segment
    before, so its statistics are merged from two running values, one of them ``n - 1`` rows back. A row costs the same for
    any ``n``, and as parts are merged and never subtracted, no digits cancel.
    """

    def __init__(self, w: WindowSpec, keys: Sequence[str] | None = None, order: Sequence[str] = ()):
        self.w = w
        self.keys, self.order = keys, list(order)
        #: Columns by how many others they rest on: numbers, segments, running values, frames, shifted frames.
        self.levels: list[dict[str, Column]] = [{} for _ in range(5)]
        self._names: dict[tuple, str] = {}

    @property
    def columns(self) -> dict[str, Column]:
        return {name: c for level in self.levels for name, c in level.items()}

    def _once(self, kind: str, xs: tuple[Column, ...], n: int, column: Column, level: int = 0) -> Column:
        key = (kind, n, *[str(x) for x in xs])
        if key not in self._names:
            self._names[key] = f"__w{len(self._names)}"
            self.levels[level][self._names[key]] = column
        return F.col(self._names[key])

    def lag(self, x: Column, n: int) -> Column:
        return self._once("lag", (x,), n, F.lag(x, _steps(n)).over(self.w))

    def _long(self, n: int) -> bool:
        return n > LONG_FRAME and self.keys is not None

    def _two_parts(self, stats: dict[str, Callable[..., Column]], xs: tuple[Column, ...], n: int) -> tuple[dict[str, Column], dict[str, Column]]:
        """Running values of the frame's head and tail; of a frame that is one whole segment the tail is empty (NULL)."""
        number = self._once("number", (), 0, F.row_number().over(self.w) - 1)
        segment = self._once("segment", (), n, F.floor(number / F.lit(n)), 1)
        ends = [F.col(f"`{c}`") for c in self.order]
        within = Window.partitionBy(*self.keys, str(self._names[("segment", n)]))
        forth = within.orderBy(*ends).rowsBetween(Window.unboundedPreceding, 0)
        back = within.orderBy(*[c.desc() for c in ends]).rowsBetween(Window.unboundedPreceding, 0)
        head, tail = {}, {}
        crosses = F.pmod(number, F.lit(n)) < n - 1
        for name, agg in stats.items():
            head[name] = self._once(f"head {name}", xs, n, agg(*xs).over(forth), 2)
            ended = self._once(f"tail {name}", xs, n, agg(*xs).over(back), 2)
            tail[name] = self._once(f"tail {name} before", xs, n, F.when(crosses, F.lag(ended, n - 1).over(self.w)), 3)
        return head, tail

    def _segmented(self, kind: str, x: Column, n: int) -> Column:
        head, tail = self._two_parts({"count": F.count, **_PARTS[kind]}, (x,), n)
        a, b = head["count"], F.coalesce(tail["count"], F.lit(0))
        both = (a > 0) & (b > 0)
        if kind == "count":
            return a + b
        if kind in ("min", "max"):
            name = next(iter(_PARTS[kind]))
            return (F.least if kind == "min" else F.greatest)(head[name], tail[name])
        step = tail["mean"] - head["mean"]
        if kind == "mean":
            return F.when(both, head["mean"] + step * b / (a + b)).otherwise(F.coalesce(head["mean"], tail["mean"]))
        squares = F.coalesce(head["var"] * a, F.lit(0.0)) + F.coalesce(tail["var"] * b, F.lit(0.0))
        squares = squares + F.when(both, step * step * a * b / (a + b)).otherwise(0.0)
        return F.when(a + b > 1, F.sqrt(squares / (a + b - 1)))

    def over(self, kind: str, x: Column, n: int) -> Column:
        """``count``, ``mean``, ``std``, ``min``, ``max`` or ``values`` of the last ``n`` rows."""
        if self._long(_steps(n)) and kind in _PARTS:
            return self._segmented(kind, x, n)
        agg = {
            "count": F.count,
            "mean": F.avg,
            "std": F.stddev_samp,
            "min": F.min,
            "max": F.max,
            "values": F.collect_list,
        }[kind](x)
        return self._once(kind, (x,), n, agg.over(self.w.rowsBetween(-(n - 1), 0)))

    def past(self, kind: str, x: Column, n: int) -> Column:
        """``count``, ``min`` or ``max`` of the ``n`` rows before the current one."""
        if self._long(_steps(n)):
            return self._once(f"past {kind}", (x,), n, F.lag(self._segmented(kind, x, n)).over(self.w), 4)
        agg = {"count": F.count, "min": F.min, "max": F.max}[kind](x)
        return self._once(f"past {kind}", (x,), n, agg.over(self.w.rowsBetween(-n, -1)))

    def covariance(self, a: Column, b: Column, n: int) -> Column:
        """Of two columns that are known in the same rows."""
        if self._long(_steps(n, 2)):
            head, tail = self._two_parts({"count": lambda x, y: F.count(x), "x": lambda x, y: F.avg(x), "y": lambda x, y: F.avg(y), "cov": F.covar_pop}, (a, b), n)
            p, q = head["count"], F.coalesce(tail["count"], F.lit(0))
            shift = (tail["x"] - head["x"]) * (tail["y"] - head["y"]) * p * q / (p + q)
            products = F.coalesce(head["cov"] * p, F.lit(0.0)) + F.coalesce(tail["cov"] * q, F.lit(0.0))
            return F.when(p + q > 1, (products + F.when((p > 0) & (q > 0), shift).otherwise(0.0)) / (p + q - 1))
        frame = self.w.rowsBetween(-(n - 1), 0)
        return self._once("covariance", (a, b), n, F.covar_samp(a, b).over(frame))

    def full(self, x: Column, n: int, value: Column) -> Column:
        """``value`` where the last ``n`` rows are all known."""
        return F.when(self.over("count", x, n) >= n, value)

    def add_to(self, df: DataFrame, features: dict[str, Column]) -> DataFrame:
        """``df`` with the features that were built on these frames; NaN and infinities become NULL."""
        out = df
        for level in self.levels:
            out = out.withColumns(level) if level else out
        out = out.withColumns(features)
        floats = {f.name for f in out.select(*features).schema.fields if f.dataType.typeName() == "double"}
        clean = {name: num.finite(F.col(name)) for name in features if name in floats}
        return (out.withColumns(clean) if clean else out).drop(*self.columns)


def lag(x: Column, n: int, f: Frames) -> Column:
    return f.lag(x, n)


def delta(x: Column, n: int, f: Frames) -> Column:
    return x.cast("double") - f.lag(x, n)


def rolling_mean(x: Column, n: int, f: Frames) -> Column:
    return f.full(x, n, f.over("mean", x, n))


def rolling_std(x: Column, n: int, f: Frames) -> Column:
    return f.full(x, _steps(n, 2), f.over("std", x, n))


def rolling_min(x: Column, n: int, f: Frames) -> Column:
    return f.full(x, n, f.over("min", x, n))


def rolling_max(x: Column, n: int, f: Frames) -> Column:
    return f.full(x, n, f.over("max", x, n))


def rolling_zscore(x: Column, n: int, f: Frames) -> Column:
    return f.full(x, _steps(n, 2), F.try_divide(x - f.over("mean", x, n), f.over("std", x, n)))


def rolling_rank(x: Column, n: int, f: Frames) -> Column:
    """Share of the frame that is not above the current value, ties counted half.

    The values of the frame are gathered for each row; for long frames see ``block_ranks``.
    """
    values = f.over("values", x, n)
    below = F.size(F.filter(values, lambda v: v < x))
    equal = F.size(F.filter(values, lambda v: v == x))
    rank = (below + (equal + 1) / F.lit(2.0)) / F.lit(float(n))
    return F.when(x.isNotNull() & (F.size(values) >= n), rank)


def range_ranks(codes: np.ndarray, low: np.ndarray, high: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many of ``codes[low:high]`` are less than and equal to ``of``, for many ranges at once.

    The codes are small numbers from 0 on. They are sorted bit by bit, highest bit first; of each bit a running count of the
    zeros carries a range on to the next bit, so that all ranges together cost one pass per bit.
    """
    less = np.zeros(len(low), np.int64)
    for bit in range(int(codes.max(initial=0)).bit_length() - 1, -1, -1):
        ones = (codes >> bit & 1).astype(bool)
        zeros = np.concatenate(([0], np.cumsum(~ones)))
        a, b = zeros[low], zeros[high]
        up = (of >> bit & 1).astype(bool)
        less += np.where(up, b - a, 0)
        low, high = np.where(up, low - a + zeros[-1], a), np.where(up, high - b + zeros[-1], b)
        codes = np.concatenate((codes[~ones], codes[ones]))
    return less, high - low


def _starts(block: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Of each row of a sorted block the first row of its key."""
    new = np.zeros(block.num_rows, bool)
    new[:1] = True
    for k in keys:
        codes = block.column(k).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(block.num_rows), 0))


def block_ranks(block: pa.Table, keys: Sequence[str], order: str, wanted: dict[str, tuple[str, int]]) -> pa.Table:
    """A block of rows with columns ``name`` = rolling rank of column ``x`` over ``n`` rows, for ``name -> (x, n)``.

    The values of the block are ranked once; a frame is then a range of rows in which lower ranks are counted. Memory follows the
    block, whatever the length of the frames.
    """
    block = block.sort_by(order)
    starts = _starts(block, keys)
    rows = np.arange(block.num_rows)
    for name, (x, n) in wanted.items():
        values = block.column(x).cast(pa.float64()).combine_chunks()
        known = ~np.asarray(values.is_null(nan_is_null=True))
        codes = np.zeros(len(rows), np.int64)
        codes[known] = np.unique(values.to_numpy(zero_copy_only=False)[known], return_inverse=True)[1]
        count = np.concatenate(([0], np.cumsum(known)))
        low = rows - n + 1
        full = low >= starts
        full[full] &= count[rows[full] + 1] - count[low[full]] == n
        less, equal = range_ranks(codes, low[full], rows[full] + 1, codes[full])
        out = np.zeros(len(rows))
        out[full] = (less + (equal + 1) / 2.0) / n
        block = block.append_column(name, pa.array(out, mask=~full))
    return block


def rate_of_change(known: Column, n: int, f: Frames) -> Column:
    """``known`` is the series with gaps filled by the last known value."""
    return F.try_divide(known.cast("double"), f.lag(known, n)) - F.lit(1.0)


def rolling_correlation(a: Column, b: Column, n: int, f: Frames) -> Column:
    """Over the pairs that are both known; NULL where one side is constant."""
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    spread = f.over("std", a, _steps(n, 2)) * f.over("std", b, n)
    return f.full(a, n, F.try_divide(f.covariance(a, b, n), spread))


def ratio_to_mean(x: Column, n: int, f: Frames) -> Column:
    return f.full(x, n, F.try_divide(x.cast("double"), f.over("mean", x, n)))


def distance_from_mean(x: Column, n: int, f: Frames) -> Column:
    mean = f.over("mean", x, n)
    return f.full(x, n, F.try_divide(x - mean, mean))


def log_return(x: Column, n: int, f: Frames) -> Column:
    return num.log_plain(F.try_divide(x.cast("double"), f.lag(x, n)))


def band_width(x: Column, n: int, f: Frames, k: float = 2.0) -> Column:
    """Width of the band of ``k`` deviations on both sides of the mean, relative to the mean."""
    return f.full(x, _steps(n, 2), F.try_divide(F.lit(2.0 * k) * f.over("std", x, n), f.over("mean", x, n)))


def true_range(high: Column, low: Column, close: Column, f: Frames) -> Column:
    before = f.lag(close, 1)
    return F.greatest(high - low, F.abs(high - before), F.abs(low - before))


def range_position(x: Column, n: int, f: Frames) -> Column:
    """0 at the lowest, 1 at the highest value of the recent range."""
    low, high = f.over("min", x, n), f.over("max", x, n)
    return f.full(x, n, F.try_divide((x - low).cast("double"), high - low))


def gain(x: Column, f: Frames) -> Column:
    step = delta(x, 1, f)
    return F.when(step.isNotNull(), F.greatest(step, F.lit(0.0)))


def loss(x: Column, f: Frames) -> Column:
    step = delta(x, 1, f)
    return F.when(step.isNotNull(), F.greatest(-step, F.lit(0.0)))


def strength_index(gains: Column, losses: Column, n: int, f: Frames) -> Column:
    """0 to 100: share of mean gains in mean gains plus mean losses."""
    up, down = rolling_mean(gains, n, f), rolling_mean(losses, n, f)
    return F.lit(100.0) * F.try_divide(up, up + down)


def volume_confirmation(known_price: Column, volume: Column, n: int, f: Frames) -> Column:
    """Price move times volume relative to its recent mean."""
    return rate_of_change(known_price, 1, f) * ratio_to_mean(volume, n, f)


def contrarian_flag(position: Column, index: Column, fear_below: float, support_above: float) -> Column:
    """1 where sentiment is in extreme fear while the price holds in its recent range."""
    return num.flag((index < fear_below) & (position > support_above))


def breakout_up(x: Column, n: int, f: Frames) -> Column:
    """1 where the value exceeds all of the ``n`` values before it."""
    return F.when(f.past("count", x, n) >= n, num.flag(x > f.past("max", x, n)))


def breakout_down(x: Column, n: int, f: Frames) -> Column:
    return F.when(f.past("count", x, n) >= n, num.flag(x < f.past("min", x, n)))


# --- exponential mean -------------------------------------------------------------------------------------------

#: Weights below this share of the newest weight change nothing in double precision.
_NEGLIGIBLE = 36.8
#: Powers inside one segment stay below exp(345), far from overflow.
_SEGMENT = 345.0


def _decay(span: float) -> float:
    if span <= 1:
        raise ValueError("the span of an exponential mean must exceed 1")
    return 1.0 - 2.0 / (span + 1.0)


def exponential_depth(span: float) -> int:
    """Past rows that carry any weight."""
    return math.ceil(_NEGLIGIBLE / -math.log(_decay(span)))


def exponential_levels(x: Column, span: float, w: WindowSpec, keys: list[str], order: list[str], name: str):
    """Column levels for the adjusted exponential mean; the last level defines ``name``.

    Weighted sums are running sums inside segments of fixed length, plus the total of the segment before, so a row
    costs the same for any span. Rows with a missing value are left NULL here; the mean of the row before stands
    there once gaps are filled.
    """
    r = _decay(span)
    length = int(_SEGMENT / -math.log(r))
    n, seg, off = f"{name}__n", f"{name}__seg", f"{name}__off"
    num_, den, cnum, cden = (f"{name}__{s}" for s in ("num", "den", "cnum", "cden"))
    inside = Window.partitionBy(*keys, seg).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    grow = F.pow(F.lit(r), -F.col(off))
    shrink = F.pow(F.lit(r), F.col(off).cast("double"))
    value = x.cast("double")
    known = value.isNotNull()
    at_end = F.col(off) == length - 1
    carried = shrink * F.lit(r)
    zero = F.lit(0.0)
    levels = [
        {n: F.row_number().over(w) - 1},
        {seg: F.floor(F.col(n) / length), off: F.pmod(F.col(n), F.lit(length))},
        {
            num_: shrink * F.coalesce(F.sum(value * grow).over(inside), zero),
            den: shrink * F.coalesce(F.sum(F.when(known, grow)).over(inside), zero),
        },
        {
            cnum: F.last(F.when(at_end, F.col(num_)), ignorenulls=True).over(before),
            cden: F.last(F.when(at_end, F.col(den)), ignorenulls=True).over(before),
        },
        {
            name: F.when(
                known,
                num.ratio(
                    F.col(num_) + carried * F.coalesce(F.col(cnum), zero),
                    F.col(den) + carried * F.coalesce(F.col(cden), zero),
                ),
            )
        },
    ]
    return levels, [n, seg, off, num_, den, cnum, cden]
