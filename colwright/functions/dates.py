"""Date parts, distances between dates, cyclic codes and magnitude suffixes."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Factors of the suffixes that volumes are written with.
MAGNITUDES = {"K": 1e3, "M": 1e6, "B": 1e9}

_NUMBER = r"^\s*([-+]?[0-9][0-9,]*(?:\.[0-9]+)?)\s*([KMBkmb]?)\s*$"


def day_of_week(d: Column) -> Column:
    """1 is Sunday."""
    return F.dayofweek(d)


def month(d: Column) -> Column:
    return F.month(d)


def quarter(d: Column) -> Column:
    return F.quarter(d)


def year(d: Column) -> Column:
    return F.year(d)


def days_since(d: Column, event: str) -> Column:
    return F.datediff(d.cast("date"), F.lit(event).cast("date"))


def days_since_latest(d: Column, events: Sequence[str]) -> Column:
    """Days since the last of the listed events; NULL before the first."""
    day = d.cast("date")
    past = F.filter(F.array(*[F.lit(e).cast("date") for e in events]), lambda e: e <= day)
    return F.datediff(day, F.array_max(past))


def cyclic_sin(x: Column, period: float) -> Column:
    return F.sin(x.cast("double") * F.lit(2 * math.pi / period))


def cyclic_cos(x: Column, period: float) -> Column:
    return F.cos(x.cast("double") * F.lit(2 * math.pi / period))


def parse_magnitude(text: Column) -> Column:
    """``1.5K``, ``2M``, ``3,000`` as doubles; NULL for anything else."""
    digits = F.regexp_replace(F.regexp_extract(text, _NUMBER, 1), ",", "")
    suffix = F.upper(F.regexp_extract(text, _NUMBER, 2))
    factor = F.lit(1.0)
    for letter, value in MAGNITUDES.items():
        factor = F.when(suffix == letter, F.lit(value)).otherwise(factor)
    return digits.try_cast("double") * factor
