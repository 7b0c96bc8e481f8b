"""Fold assignment: stratified, shuffled and time-ordered, and row sampling.

Shuffles follow the digest of seed and row id, so a row's fold depends on the data alone, not on the cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from colwright.operators.ordered import BLOCK_ROWS, POS, hashed_position, lay_out


def row_digest(seed: int, ids: Sequence[str]) -> Column:
    return F.md5(F.concat_ws("~", F.lit(str(seed)), *[F.col(f"`{c}`").cast("string") for c in ids]))


def stratified_folds(
    df: DataFrame, label: str, ids: Sequence[str], k: int, seed: int = 42, out: str = "fold"
) -> DataFrame:
    """Folds 0..k-1 whose counts of each class differ by at most one."""
    placed = hashed_position(df, ids, seed, [label], name="__p")
    return placed.withColumn(out, F.pmod("__p", F.lit(k)).cast("int")).drop("__p")


def shuffled_folds(df: DataFrame, ids: Sequence[str], k: int, seed: int = 42, out: str = "fold") -> DataFrame:
    placed = hashed_position(df, ids, seed, name="__p")
    return placed.withColumn(out, F.pmod("__p", F.lit(k)).cast("int")).drop("__p")


def time_folds(
    df: DataFrame, order_by: Sequence[str], k: int, out: str = "fold", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Test fold 0..k-1 of each row, -1 for rows that only ever train; fold j trains on all rows with fold < j.

    Only the ``k`` rows that open a test fold are looked up, in a sorted copy of the order columns; the table itself
    is compared with these cuts and is not shuffled.
    """
    n = df.count()
    size = n // (k + 1)
    if size == 0:
        raise ValueError(f"{n} rows are too few for {k} folds")
    layout = lay_out(df.select(*order_by), [], order_by, block_rows)
    opens = [n - (k - j) * size for j in range(k)]
    cuts = layout.table.filter(F.col(POS).isin(opens)).select(F.struct(*order_by).alias("c"))
    cuts = cuts.agg(F.sort_array(F.collect_list("c")).alias("__cuts"))
    here = F.struct(*[F.col(c) for c in order_by])
    passed = F.size(F.filter("__cuts", lambda c: c <= here))
    return df.crossJoin(F.broadcast(cuts)).withColumn(out, (passed - 1).cast("int")).drop("__cuts")


def is_train(fold: Column, j: int, ordered: bool = False) -> Column:
    """Rows that fold ``j`` trains on: all other folds, or all earlier ones for time-ordered folds."""
    return (fold < j) if ordered else (fold != j)


def sample_rows(df: DataFrame, ids: Sequence[str], k: int, seed: int = 42) -> DataFrame:
    """``k`` rows at random: the first in digest order, by a top-k per partition and a merge."""
    return df.orderBy(row_digest(seed, ids)).limit(k)
