"""Category and row text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

_SPACE = " \t\n\r\f\x0b"


def combine(*xs: Column) -> Column:
    """Category values joined by ``_``; a missing part prints as ``nan``."""
    return F.concat_ws("_", *[F.coalesce(x.cast("string"), F.lit("nan")) for x in xs])


def recode(x: Column, mapping: Mapping[str, str], default: str) -> Column:
    out = None
    for value, code in mapping.items():
        out = F.when(x == value, F.lit(code)) if out is None else out.when(x == value, F.lit(code))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def _bare(x: Column) -> Column:
    text = F.coalesce(x.cast("string"), F.lit("nan"))
    return F.btrim(F.btrim(F.btrim(text, F.lit(" .'")), F.lit('"')), F.lit(_SPACE))


def row_sentence(columns: Sequence[str]) -> Column:
    """``If a is 1, b is 2,  Then t is 3.`` with the last column as the conclusion.

    A conclusion whose name is shorter than two characters is left out.
    """
    parts = [F.lit("If ")]
    for name in columns[:-1]:
        parts += [F.lit(f"{name} is "), _bare(F.col(f"`{name}`")), F.lit(", ")]
    last = columns[-1]
    if len(last.strip()) >= 2:
        parts += [F.lit(f" Then {last} is "), _bare(F.col(f"`{last}`")), F.lit(".")]
    return F.concat(*parts)
