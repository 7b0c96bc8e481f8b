"""Equi-joins with derived lookup tables, and joins between the run tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from colwright.storage import cut_lineage


def attach(df: DataFrame, dim: DataFrame, on: Sequence[str], written: bool = False) -> DataFrame:
    """Left join of ``df`` with one row per key of ``dim``; missing keys and NULL keys give NULL.

    ``dim`` is written first, so the planner knows its size: a small one is broadcast and ``df`` is not shuffled, a
    large one is joined by a shuffle in which adaptive execution splits the hot keys of ``df``.
    """
    dim = dim if written else cut_lineage(dim, "lookup")
    return df.join(dim, list(on), "left")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on keys where NULL matches NULL; with no keys, both sides have one group and are combined."""
    if not keys:
        return left.crossJoin(F.broadcast(right))
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(renamed[f"__r_{k}"])
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def attach_single(df: DataFrame, row: DataFrame) -> DataFrame:
    """Adds the columns of a one-row table (an ungrouped aggregate)."""
    return df.crossJoin(F.broadcast(row))


def map_codes(df: DataFrame, codes: DataFrame, column: str, out: str, missing: int = -1) -> DataFrame:
    """Replace values by their code; unseen and NULL values get ``missing``. ``codes`` has (value, code)."""
    dim = codes.select(F.col("value").alias(column), F.col("code").alias("__looked_up"))
    return attach(df, dim, [column]).withColumn(out, F.coalesce("__looked_up", F.lit(missing))).drop("__looked_up")


def unseen_values(test: DataFrame, train: DataFrame, column: str) -> DataFrame:
    """Distinct known test values that the training rows do not have."""
    values = test.select(column).filter(F.col(column).isNotNull()).distinct()
    return values.join(train.select(column).distinct(), [column], "left_anti")


def describe_columns(columns: DataFrame, metadata: DataFrame, name: str = "name") -> DataFrame:
    """Adds a description per column name; without one, the name with spaces for underscores."""
    joined = attach(columns, metadata.select(F.col("name").alias(name), "type", "description", "context"), [name])
    description, context = (F.nullif(F.col(c), F.lit("")) for c in ("description", "context"))
    told = (
        F.when(description.isNotNull() & context.isNotNull(), F.concat(description, F.lit(" ("), context, F.lit(")")))
        .otherwise(F.coalesce(description, context))
    )
    return joined.withColumn("description", F.coalesce(told, F.regexp_replace(F.col(name), "_", " "))).drop("context")


def with_program_score(
    reviews: DataFrame, candidates: DataFrame, keys: Sequence[str] = ("run_id", "program_index")
) -> DataFrame:
    """Score of the reviewed program; 0 where no program matches, NULL where the matched one has none."""
    scores = candidates.select(*keys, F.col("score").alias("__score"), F.lit(True).alias("__hit"))
    return (
        reviews.join(scores, list(keys), "left")
        .withColumn("score", F.when(F.col("__hit"), F.col("__score")).otherwise(F.lit(0.0)))
        .drop("__score", "__hit")
    )


def with_prompt(candidates: DataFrame, prompts: DataFrame, columns: Sequence[str], how: str = "left") -> DataFrame:
    """Columns of the prompt that a candidate came from."""
    return candidates.join(prompts.select("prompt_id", *columns), ["prompt_id"], how)


def coalesce_columns(df: DataFrame, defaults: Mapping[str, Column]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), default) for c, default in defaults.items()})
