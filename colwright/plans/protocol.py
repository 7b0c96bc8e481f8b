"""How a problem is evaluated: task, metric, and how outer and inner folds are cut."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from colwright.operators import folds

# Problems whose target is a number, and the one of them that is a time series; all others are classified.
REGRESSION_PROBLEMS = ("btc", "forest-fires", "housing", "insurance", "bike", "wine", "crab")
SERIES_PROBLEMS = ("btc",)

TASKS = ("regression", "classification")
RULES = ("time", "shuffled", "stratified")
METRICS = ("rmse", "nrmse", "accuracy")


@dataclass(frozen=True)
class Protocol:
    """Outer folds measure what the search found, inner folds measure its candidates; each has its own rule.

    ``time`` folds train on earlier rows only, ``shuffled`` and ``stratified`` ones on all other folds.
    """

    task: str
    metric: str
    outer: str
    inner: str
    outer_folds: int = 5
    inner_folds: int = 4

    def __post_init__(self) -> None:
        for value, known in ((self.task, TASKS), (self.metric, METRICS), (self.outer, RULES), (self.inner, RULES)):
            if value not in known:
                raise ValueError(f"{value} is none of {known}")
        if (self.metric == "accuracy") != (self.task == "classification"):
            raise ValueError(f"{self.metric} does not measure {self.task}")

    def assign(self, df: DataFrame, which: str, target: str, ids: Sequence[str], order_by: Sequence[str], out: str, seed: int) -> DataFrame:
        """Add the fold numbers of the ``outer`` or ``inner`` rule as column ``out``."""
        rule, k = (self.outer, self.outer_folds) if which == "outer" else (self.inner, self.inner_folds)
        if rule == "time":
            return folds.time_folds(df, order_by, k, out)
        if rule == "stratified":
            return folds.stratified_folds(df, target, ids, k, seed, out)
        return folds.shuffled_folds(df, ids, k, seed, out)

    def ordered(self, which: str) -> bool:
        return (self.outer if which == "outer" else self.inner) == "time"


CLASSES = Protocol("classification", "accuracy", "stratified", "stratified")
NUMBERS = Protocol("regression", "rmse", "time", "shuffled")
SERIES = Protocol("regression", "nrmse", "time", "time")


def protocol_of(problem: str | None = None, task: str | None = None) -> Protocol:
    """The protocol of a bundled problem, or the usual one of a task, which wins if both are given."""
    if task is not None:
        return {"classification": CLASSES, "regression": NUMBERS, "series": SERIES}[task]
    if problem in SERIES_PROBLEMS:
        return SERIES
    return NUMBERS if problem in REGRESSION_PROBLEMS else CLASSES
