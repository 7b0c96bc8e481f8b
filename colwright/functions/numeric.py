"""Row-wise numeric transforms.

NULL is the only missing value: results that would be NaN or infinite are NULL, and a missing input gives a missing
result. All inputs are read as double, so no integer overflow or ANSI division error can stop a job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

_INF = float("inf")


def finite(x: Column) -> Column:
    """NaN and infinities become NULL; NaN sorts above infinity, so one comparison finds both."""
    x = x.cast("double")
    return F.when(F.abs(x) < F.lit(_INF), x)


def _d(x: Column) -> Column:
    return x.cast("double")


def absolute(x: Column) -> Column:
    return F.abs(_d(x))


def log_safe(x: Column) -> Column:
    return F.log1p(F.abs(_d(x)))


def log_plain(x: Column) -> Column:
    return F.when(_d(x) > 0, F.log(_d(x)))


def sqrt_abs(x: Column) -> Column:
    return F.sqrt(F.abs(_d(x)))


def sqrt_signed(x: Column) -> Column:
    return F.sqrt(F.abs(_d(x))) * F.signum(_d(x))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_d(x)))


def square(x: Column) -> Column:
    return finite(_d(x) * _d(x))


def power(x: Column, exponent: float) -> Column:
    return finite(F.pow(_d(x), F.lit(float(exponent))))


def round_half_even(x: Column, digits: int = 2) -> Column:
    """Rounds the scaled value half to even, as array libraries do; ``F.round`` would round half up."""
    scale = F.lit(float(10**digits))
    return F.rint(_d(x) * scale) / scale


def minimum(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.least(_d(a), _d(b)))


def maximum(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(_d(a), _d(b)))


def add(a: Column, b: Column) -> Column:
    return finite(_d(a) + _d(b))


def subtract(a: Column, b: Column) -> Column:
    return finite(_d(a) - _d(b))


def absolute_difference(a: Column, b: Column) -> Column:
    return F.abs(subtract(a, b))


def product(*xs: Column, scale: float = 1.0) -> Column:
    out = _d(xs[0])
    for x in xs[1:]:
        out = out * _d(x)
    return finite(out if scale == 1.0 else out / F.lit(float(scale)))


def row_sum(*xs: Column) -> Column:
    out = _d(xs[0])
    for x in xs[1:]:
        out = out + _d(x)
    return finite(out)


def row_mean(*xs: Column) -> Column:
    return row_sum(*xs) / F.lit(float(len(xs)))


def ratio(a: Column, b: Column) -> Column:
    """NULL on a zero divisor."""
    return finite(F.try_divide(_d(a), _d(b)))


def ratio_guarded(a: Column, b: Column) -> Column:
    """A zero divisor counts as one."""
    return finite(_d(a) / F.when(_d(b) == 0, F.lit(1.0)).otherwise(_d(b)))


def where(condition: Column, a: Column, b: Column) -> Column:
    return F.when(condition, a).otherwise(b)


def flag(predicate: Column) -> Column:
    return predicate.cast("int")


def clip(x: Column, low: float, high: float) -> Column:
    x = _d(x)
    return F.when(x < low, F.lit(float(low))).when(x > high, F.lit(float(high))).otherwise(x)


def discretize(x: Column, upper_bounds: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the first bucket whose inclusive upper bound is not below ``x``; NULL above the last bound."""
    out = F.when(x <= upper_bounds[0], F.lit(labels[0]))
    for bound, label in zip(upper_bounds[1:], labels[1:], strict=True):
        out = out.when(x <= bound, F.lit(label))
    return out


def bin_index(x: Column, edges: Sequence[float]) -> Column:
    """0-based bin of right-closed intervals with the lowest edge included; NULL outside the edges."""
    x = _d(x)
    out = F.when((x < edges[0]) | x.isNull(), F.lit(None).cast("int"))
    for i, edge in enumerate(edges[1:]):
        out = out.when(x <= F.lit(float(edge)), F.lit(i))
    return out


def scale_range(x: Column, low: Column | float, high: Column | float) -> Column:
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    return ratio(_d(x) - low, high - low)


def unscale_range(x: Column, low: float, high: float) -> Column:
    return _d(x) * F.lit(float(high - low)) + F.lit(float(low))


def fill_zero(x: Column) -> Column:
    return F.coalesce(finite(x), F.lit(0.0))


def correlation(a: Column, b: Column) -> Column:
    """An aggregate over pairs that are both known; NULL where one side is constant, which ``F.corr`` refuses."""
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, _d(a)), F.when(both, _d(b))
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))
