"""A way out for functions that no column expression can state."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F


def row_function(fn: Callable, returns: str):
    """A function of single values as a column function; values cross to Python in Arrow batches.

    Conditions and recodes are better written as ``numeric.where`` or ``text.recode``, which stay in the JVM.
    """

    @F.pandas_udf(returns)
    def apply(values: pd.Series) -> pd.Series:
        return values.astype(object).where(values.notna(), None).map(fn, na_action=None)

    return apply
