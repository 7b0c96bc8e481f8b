"""Work along an order without one task per key.

``Window.partitionBy(key)`` sends every row of a key to one task, and ``Window.orderBy`` alone sends the whole table
to one. Where a key may hold a large part of the table, rows are sorted once by range, numbered, and cut into blocks
of fixed length:

* frames of bounded depth (rolling, lag) see their block plus a *halo*, a copy of the last rows of the block before;
* running values (sums, maxima, last known value) combine a value inside the block with a *carry* from earlier blocks
  of the same key. Only a key that continues across a block boundary needs a carry, so there are at most as many
  carries as blocks.

The order must be total: ties in ``order_by`` would leave the result undefined.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from colwright.storage import cut_lineage

#: Rows of one key that a single window task may take.
KEY_ROWS = 1_000_000
#: Rows per block of a table that is cut into blocks.
BLOCK_ROWS = 250_000

POS = "__pos"
BLOCK = "__block"
_ROW_BITS = 33


def largest_key(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the fullest key; partial counts are combined before the shuffle."""
    if not keys:
        return df.count()
    row = df.groupBy(*keys).count().agg(F.max("count")).first()
    return row[0] or 0


@dataclass(frozen=True)
class Layout:
    """A table sorted by (keys, order), with ``__pos`` numbering all rows from 0 and ``__block`` = pos div rows."""

    table: DataFrame
    keys: tuple[str, ...]
    block_rows: int

    def window(self) -> WindowSpec:
        return Window.partitionBy(BLOCK, *self.keys).orderBy(POS)


def partition_starts(counts: DataFrame, part: str, count: str) -> DataFrame:
    """Exclusive running count over partition numbers; one row per partition of the sorted table."""
    w = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(part, F.coalesce(F.sum(count).over(w), F.lit(0)).alias("__start"))


def lay_out(
    df: DataFrame,
    partition_by: Sequence[str],
    order_by: Sequence[str],
    block_rows: int = BLOCK_ROWS,
) -> Layout:
    """Sort by range, number the rows, and write the result so that the numbering is settled once."""
    spark = df.sparkSession
    order = [F.col(f"`{c}`") for c in (*partition_by, *order_by)]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    numbered = cut_lineage(ranged.withColumn("__mid", F.monotonically_increasing_id()), "layout")
    part = F.shiftright("__mid", _ROW_BITS)
    counts = numbered.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    starts = partition_starts(counts, "__part", "__n")
    # one row per range partition: at most spark.sql.shuffle.partitions rows
    table = (
        numbered.withColumn("__part", part)
        .join(F.broadcast(starts), "__part")
        .withColumn(POS, F.col("__start") + F.col("__mid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
        .withColumn(BLOCK, F.floor(F.col(POS) / F.lit(block_rows)).cast("long"))
        .drop("__part", "__start", "__mid")
    )
    return Layout(table, tuple(partition_by), block_rows)


def with_halo(layout: Layout, depth: int) -> DataFrame:
    """Adds to every block the last ``depth`` rows before it, from as many earlier blocks as that takes.

    A row at place p of its block is copied to each of the next (p + depth) div rows blocks, so a block never holds more than
    its own rows and ``depth`` others. With a deep halo many copies are made; blocks are then as long as the halo.
    """
    place = F.pmod(F.col(POS), F.lit(layout.block_rows))
    later = F.floor((place + F.lit(depth)) / F.lit(layout.block_rows)).cast("long")
    homes = F.transform(F.sequence(F.lit(0).cast("long"), later), lambda i: F.col(BLOCK) + i)
    return layout.table.withColumn(BLOCK, F.explode(homes))


def without_halo(df: DataFrame, block_rows: int) -> DataFrame:
    return df.filter(F.col(BLOCK) == F.floor(F.col(POS) / F.lit(block_rows)))


def bounded_frames(layout: Layout, depth: int, add: Callable[[DataFrame], DataFrame]) -> Layout:
    """Add columns over ``layout.window()`` whose frames reach back at most ``depth`` rows."""
    if not depth:
        return Layout(add(layout.table), layout.keys, layout.block_rows)
    # a frame deeper than a block: longer blocks for this step, so that a row is copied about once
    rows = max(layout.block_rows, depth)
    wide = layout.table.withColumn(BLOCK, F.floor(F.col(POS) / F.lit(rows)).cast("long")) if rows != layout.block_rows else layout.table
    df = without_halo(add(with_halo(Layout(wide, layout.keys, rows), depth)), rows)
    if rows != layout.block_rows:
        df = df.withColumn(BLOCK, F.floor(F.col(POS) / F.lit(layout.block_rows)).cast("long"))
    return Layout(df, layout.keys, layout.block_rows)


def _same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    cond = left[BLOCK] == right[f"{BLOCK}_r"]
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[f"{k}__r"])
    return cond


def running_value(kind: str, x: Column, w: WindowSpec) -> Column:
    """A running aggregate inside window ``w``: ``sum``, ``max`` or ``last`` (last known value)."""
    frame = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if kind == "sum":
        return F.coalesce(F.sum(x).over(frame), F.lit(0))
    if kind == "max":
        return F.max(x).over(frame)
    if kind == "last":
        return F.last(x, ignorenulls=True).over(frame)
    raise ValueError(f"unknown running aggregate {kind}")


def _partial(kind: str, x: Column) -> Column:
    if kind == "sum":
        return F.coalesce(F.sum(x), F.lit(0))
    if kind == "max":
        return F.max(x)
    return F.max_by(x, F.when(x.isNotNull(), F.col(POS)))


def _combine(kind: str, inside: Column, carry: Column) -> Column:
    if kind == "sum":
        return F.coalesce(carry, F.lit(0)) + inside
    if kind == "max":
        return F.greatest(inside, carry)
    return F.coalesce(inside, carry)


def running_blocks(layout: Layout, columns: Mapping[str, tuple[str, Column]]) -> Layout:
    """Running aggregates over a block layout; exact for keys of any size."""
    keys = layout.keys
    partial = layout.table.groupBy(BLOCK, *keys).agg(
        *[_partial(kind, x).alias(f"__c_{name}") for name, (kind, x) in columns.items()]
    )
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    merged = []
    for name, (kind, _) in columns.items():
        c = F.col(f"__c_{name}")
        agg = {"sum": F.sum(c), "max": F.max(c), "last": F.last(c, ignorenulls=True)}[kind]
        merged.append(agg.over(before).alias(f"__c_{name}"))
    carries = partial.select(
        F.col(BLOCK).alias(f"{BLOCK}_r"),
        *[F.col(k).alias(f"{k}__r") for k in keys],
        F.count(F.lit(1)).over(before).alias("__earlier"),
        *merged,
    ).filter(F.col("__earlier") > 0)
    carries = cut_lineage(carries.drop("__earlier"), "carry")
    w = layout.window()
    inside = layout.table.withColumns(
        {f"__i_{name}": running_value(kind, x, w) for name, (kind, x) in columns.items()}
    )
    joined = inside.join(carries, _same_keys(inside, carries, keys), "left")
    out = joined.withColumns(
        {
            name: _combine(kind, F.col(f"__i_{name}"), F.col(f"__c_{name}"))
            for name, (kind, _) in columns.items()
        }
    ).drop(
        f"{BLOCK}_r",
        *[f"{k}__r" for k in keys],
        *[f"__i_{name}" for name in columns],
        *[f"__c_{name}" for name in columns],
    )
    return Layout(out, keys, layout.block_rows)


def running(
    df: DataFrame,
    partition_by: Sequence[str],
    order_by: Sequence[str],
    columns: Mapping[str, tuple[str, Column]],
    key_rows: int = KEY_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Running aggregates along ``order_by`` per key: name -> (``sum`` | ``max`` | ``last``, expression)."""
    if largest_key(df, partition_by) <= key_rows:
        w = Window.partitionBy(*partition_by).orderBy(*order_by)
        return df.withColumns({name: running_value(kind, x, w) for name, (kind, x) in columns.items()})
    layout = running_blocks(lay_out(df, partition_by, order_by, block_rows), columns)
    return layout.table.drop(POS, BLOCK)


def hashed_position(
    df: DataFrame, ids: Sequence[str], seed: int, strata: Sequence[str] = (), digits: int = 4, name: str = POS
) -> DataFrame:
    """0-based position of every row in the order of ``md5(seed~ids)``, within each stratum.

    Digests are uniform, so their leading hex digits cut any stratum into even buckets; positions are the bucket's
    start plus the rank inside the bucket. No task sees more than one bucket, however large a stratum is. ``ids``
    must identify a row.
    """
    digest = F.md5(F.concat_ws("~", F.lit(str(seed)), *[F.col(f"`{c}`").cast("string") for c in ids]))
    hashed = df.withColumn("__h", digest).withColumn("__bucket", F.substring("__h", 1, digits))
    counts = hashed.groupBy(*strata, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*strata).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *[F.col(s).alias(f"{s}__r") for s in strata],
        F.col("__bucket").alias("__bucket_r"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"),
    )
    inside = Window.partitionBy(*strata, "__bucket").orderBy("__h")
    ranked = hashed.withColumn("__rank", F.row_number().over(inside) - 1)
    cond = ranked["__bucket"] == starts["__bucket_r"]
    for s in strata:
        cond = cond & ranked[s].eqNullSafe(starts[f"{s}__r"])
    return (
        ranked.join(starts, cond)
        .withColumn(name, F.col("__start") + F.col("__rank"))
        .drop("__h", "__bucket", "__bucket_r", "__start", "__rank", *[f"{s}__r" for s in strata])
    )
