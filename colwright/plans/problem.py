"""A labelled problem: its table, target, metadata and task, ready for folds and scoring."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from colwright.operators import encode
from colwright.plans.protocol import Protocol, protocol_of
from colwright.plans.seeds import SEEDS
from colwright.plans.spec import FeatureSpec
from colwright.sources import metadata as columns, tables


@dataclass(frozen=True)
class Problem:
    table: DataFrame
    target: str
    protocol: Protocol
    metadata: DataFrame | None = None
    seed: FeatureSpec | None = None

    @property
    def task(self) -> str:
        return self.protocol.task


# Fixed value: a column of this name only orders the rows and is no feature.
DATE_COLUMN = "date"


def load_problem(spark: SparkSession, folder: str, name: str, schema: str | None = None, task: str | None = None) -> Problem:
    """``<folder>/<name>.csv`` with ``<name>-metadata.json``; the last column is the target.

    ``task`` is ``regression``, ``series`` or ``classification``. Without it a bundled problem has its own, and any other is
    classified if its target is text, else a regression.
    """
    table = tables.drop_stray_columns(tables.read_csv(spark, f"{folder}/{name}.csv", schema))
    told = columns.read_metadata(spark, f"{folder}/{name}-metadata.json")
    target = tables.target_column(table)
    if task is None and name not in SEEDS:
        task = "regression" if isinstance(table.schema[target].dataType, T.NumericType) else "classification"
    return Problem(table, target, protocol_of(name, task), told, SEEDS.get(name))


def base_table(problem: Problem, fit_on: Column | None = None, keep: tuple[str, ...] = ()) -> Problem:
    """String features as codes, missing numbers as 0, and class labels as codes.

    A column named ``date`` is left out unless it is in ``keep``. Codes of features are learned from the rows where ``fit_on`` holds; the label codes must cover all classes.
    """
    df, target = problem.table, problem.target
    if DATE_COLUMN not in (*keep, target):
        df = df.drop(DATE_COLUMN)
    features = [c for c in df.columns if c != target]
    for column in encode.categorical_columns(df, (target, *keep)):
        coded = encode.label_encode(df, column, "__code", fit_on).drop(column)
        df = coded.withColumnRenamed("__code", column)
    if problem.task == "classification":
        df = encode.label_encode(df, target, "__y").drop(target).withColumnRenamed("__y", target)
    df = df.fillna(0, subset=[c for c in features if c not in keep])
    return replace(problem, table=df.select(*[F.col(f"`{c}`") for c in features], F.col(f"`{target}`")))
