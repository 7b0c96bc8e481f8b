"""Exact quantiles of columns of any size, bins of equal count, and ranks.

Exact percentile aggregates hold all distinct values of a group, with their counts, in one buffer. Where a group has
more than ``GROUP_VALUES`` distinct values, a quantile sketch brackets each wanted position instead, and only the
values inside the bracket, a small share of the rows, are counted and ordered.

Many columns that are packed into one array per row are cut without unfolding them (``packed_quantiles``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from colwright.functions import numeric as num
from colwright.operators.lookup import attach, null_safe_join
from colwright.operators.ordered import BLOCK_ROWS, KEY_ROWS, running
from colwright.storage import cut_lineage

#: Distinct values of one group that may be held in one aggregation buffer.
GROUP_VALUES = 100_000
#: Rows that a bracket should hold at most, and the limits of the sketch accuracy that is chosen for it.
_BRACKET_ROWS = 2_000_000
_ACCURACY = (20_000, 1_000_000)


def group_widths(df: DataFrame, group_by: Sequence[str], columns: Sequence[str]) -> tuple[int, int]:
    """Rows of the fullest group, and (about) the most distinct values that any of the columns has in a group."""
    per_group = df.groupBy(*group_by).agg(
        F.count(F.lit(1)).alias("n"),
        F.greatest(*[F.approx_count_distinct(c) for c in columns], F.lit(0)).alias("values"),
    )
    row = per_group.agg(F.max("n"), F.max("values")).first()
    return row[0] or 0, row[1] or 0


def exact_quantiles(
    df: DataFrame,
    x: str,
    probabilities: Sequence[float],
    group_by: Sequence[str] = (),
    group_values: int | None = None,
    accuracy: int | None = None,
) -> DataFrame:
    """One row per group: keys and ``q``, the linearly interpolated quantiles as an array in the given order."""
    values = df.select(*group_by, F.col(x).cast("double").alias("__x")).filter(F.col("__x").isNotNull())
    probs = [float(p) for p in probabilities]
    rows, widest = group_widths(values, group_by, ["__x"])
    if widest <= (GROUP_VALUES if group_values is None else group_values):
        wanted = F.percentile("__x", F.array(*[F.lit(p) for p in probs])).alias("q")
        return values.groupBy(*group_by).agg(wanted)
    least, most = _ACCURACY
    return _bracketed(values, probs, list(group_by), accuracy or min(max(least, 4 * rows // _BRACKET_ROWS), most))


def _bracketed(values: DataFrame, probs: list[float], keys: list[str], accuracy: int) -> DataFrame:
    # The sketch is off by at most n/accuracy ranks; a bracket of twice that on both sides holds the wanted rank.
    slack = 2.0 / accuracy
    low = [F.lit(max(p - slack, 0.0)) for p in probs]
    high = [F.lit(min(p + slack, 1.0)) for p in probs]
    brackets = cut_lineage(
        values.groupBy(*keys).agg(
            F.count("__x").alias("__n"),
            F.min("__x").alias("__min"),
            F.max("__x").alias("__max"),
            F.percentile_approx("__x", F.array(*low), accuracy).alias("__lo"),
            F.percentile_approx("__x", F.array(*high), accuracy).alias("__hi"),
        ),
        "brackets",
    )
    # A group of few rows is taken whole, as its ranks are too close together for a bracket, and so is a position
    # next to an end, which has no neighbour there to lean on.
    short = F.col("__n") < 4 * accuracy
    edge = [
        F.struct(
            F.lit(i).alias("i"),
            F.lit(p).alias("p"),
            F.when(short | F.lit(p <= slack), F.col("__min")).otherwise(F.col("__lo")[i]).alias("lo"),
            F.when(short | F.lit(p >= 1 - slack), F.col("__max")).otherwise(F.col("__hi")[i]).alias("hi"),
        )
        for i, p in enumerate(probs)
    ]
    brackets = brackets.select(*keys, "__n", F.array(*edge).alias("__b"))
    rows = null_safe_join(values, brackets, keys)
    below = rows.groupBy(*keys).agg(
        F.array(
            *[F.sum(F.when(F.col("__x") < F.col("__b")[i]["lo"], 1).otherwise(0)) for i in range(len(probs))]
        ).alias("__below")
    )
    inside = F.filter("__b", lambda b: (F.col("__x") >= b["lo"]) & (F.col("__x") <= b["hi"]))
    counted = (
        rows.filter(F.size(inside) > 0)
        .select(*keys, "__n", "__x", F.explode(inside).alias("b"))
        .groupBy(*keys, "__n", "b.i", "b.p", "__x")
        .agg(F.count(F.lit(1)).alias("__c"))
    )
    up_to = Window.partitionBy(*keys, "i").orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)
    ordered = counted.withColumn("__upto", F.sum("__c").over(up_to))
    ordered = null_safe_join(ordered, below, keys)
    rank = F.col("p") * (F.col("__n") - 1)
    last = F.col("__below")[F.col("i")] + F.col("__upto") - 1
    first = last - F.col("__c") + 1
    per_prob = ordered.groupBy(*keys, "i").agg(
        F.max(rank).alias("r"),
        F.min(F.when((first <= F.floor(rank)) & (last >= F.floor(rank)), F.col("__x"))).alias("a"),
        F.min(F.when((first <= F.ceil(rank)) & (last >= F.ceil(rank)), F.col("__x"))).alias("z"),
    )
    missed = F.raise_error(F.lit("a quantile lies outside its bracket; raise the accuracy")).cast("double")
    value = F.when(F.col("a").isNull() | F.col("z").isNull(), missed).otherwise(
        F.col("a") + (F.col("r") - F.floor("r")) * (F.col("z") - F.col("a"))
    )
    packed = per_prob.withColumn("v", value).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("s"))
    return packed.select(*keys, F.transform("s", lambda e: e["v"]).alias("q"))


#: Rows of a run that are sorted together, and the values of a column that stand for them.
_CHUNK = 1 << 16
_POINTS = 1 << 11


def unpacked(batch: pa.RecordBatch, xs: str) -> np.ndarray:
    """The arrays of a batch as rows of a matrix; missing and infinite values are NaN."""
    return _numbers(batch.column(xs).flatten()).reshape(batch.num_rows, -1)


def _numbers(values: pa.Array) -> np.ndarray:
    flat = values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.where(np.isfinite(flat), flat, np.nan)


def unpacked_columns(batch: pa.RecordBatch, xs: str | Sequence[str]) -> list[np.ndarray]:
    """The places of the arrays of a batch, or several of its columns, one by one."""
    return list(unpacked(batch, xs).T) if isinstance(xs, str) else [_numbers(batch.column(x)) for x in xs]


def _sorted_columns(
    batches: Iterator[pa.RecordBatch], xs: str | Sequence[str], chunk: int
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(run, column, its different known values in order, their weights) of ``chunk`` rows of a run at a time."""
    waiting: dict[int, list[list[np.ndarray]]] = {}

    def columns(run: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        weights, *values = (np.concatenate(parts) for parts in zip(*waiting.pop(run), strict=True))
        alike = bool((weights == 1).all())
        for f, x in enumerate(values):
            known = ~np.isnan(x)
            if not known.any():
                continue
            if alike:
                v, w = np.unique(x[known], return_counts=True)
            else:
                v, place = np.unique(x[known], return_inverse=True)
                w = np.bincount(place, weights[known]).astype(np.int64)
            yield run, f, v, w

    for batch in batches:
        runs, rows = batch.column("run").to_numpy(), [batch.column("weight").to_numpy(), *unpacked_columns(batch, xs)]
        for run in np.unique(runs).tolist():
            here = runs == run
            waiting.setdefault(run, []).append(rows if here.all() else [x[here] for x in rows])
            if sum(len(part[0]) for part in waiting[run]) >= chunk:
                yield from columns(run)
    for run in list(waiting):
        yield from columns(run)


def packed_quantiles(
    df: DataFrame,
    xs: str | Sequence[str],
    probabilities: Sequence[float],
    run: str | None = None,
    chunk: int = _CHUNK,
    points: int = _POINTS,
    weight: str | None = None,
) -> DataFrame:
    """(run, f, q): exact quantiles, as ``exact_quantiles`` gives them, of every place ``f`` of the arrays ``xs``, per ``run``.

    ``xs`` may also be several columns, with ``f`` their place in the list. ``weight`` is a column that says for how many equal rows
    a row stands, at least one. All arrays have one length; missing and infinite values do not count, and a column without others has
    no row. Every task sorts ``chunk`` rows at a time and hands on about ``points`` values of each column at equal distances, so that
    the error of a rank is known, not only likely. Positions are bracketed by these, then the values inside a bracket, about one of
    ``points`` rows, are counted.
    """
    probs = np.array(probabilities, float)
    places = xs if isinstance(xs, str) else list(xs)
    columns = [F.col(x) for x in ([places] if isinstance(places, str) else places)]
    weights = (F.lit(1) if weight is None else F.col(weight)).cast("long").alias("weight")
    rows = df.select((F.lit(0) if run is None else F.col(run)).cast("int").alias("run"), weights, *columns)

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for j, f, v, w in _sorted_columns(batches, places, chunk):
            upto = np.cumsum(w)
            stride = -(-int(upto[-1]) // points)
            # a point ends its interval; the values before it in there weigh less than a stride
            last = np.append(np.nonzero(np.diff(upto // stride, prepend=0))[0], len(v) - 1)
            last = np.unique(last)
            yield pa.RecordBatch.from_pylist(
                [{"run": j, "f": f, "stride": stride, "v": v[last], "w": np.diff(upto[last], prepend=0)}], _SUMMARY
            )

    def brackets(part: pa.Table) -> pa.Table:
        v, w = (np.concatenate([x.values.to_numpy() for x in part.column(c)]) for c in ("v", "w"))
        slack = sum(part.column("stride").to_pylist()) - part.num_rows
        order = np.argsort(v)
        v, w = v[order], np.cumsum(w[order])
        # of a point, at least those before it are below and at most ``slack`` more; a rank starts behind as many as are surely below
        rank = probs * (w[-1] - 1)
        below = np.searchsorted(w + slack, np.floor(rank), "right")
        low = np.where(below > 0, v[np.maximum(below - 1, 0)], -np.inf)
        high = v[np.searchsorted(w, np.ceil(rank) + 1)]
        keys = [part.column(c)[:1] for c in ("run", "f")]
        return pa.table([*keys, pa.array([low]), pa.array([high])], ["run", "f", "low", "high"])

    summed = rows.mapInArrow(summaries, "run int, f int, stride long, v array<double>, w array<long>")
    found = summed.groupBy("run", "f").applyInArrow(brackets, "run int, f int, low array<double>, high array<double>")
    place: dict[tuple[int, int], tuple[list, list]] = {}
    for r in found.collect():  # one row per run and column
        merged: list[list[float]] = []
        for low, high in sorted(zip(r["low"], r["high"])):
            if merged and low <= merged[-1][1]:
                merged[-1][1] = max(high, merged[-1][1])
            else:
                merged.append([low, high])
        place[r["run"], r["f"]] = tuple(np.array(ends) for ends in zip(*merged))

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for j, f, v, w in _sorted_columns(batches, places, chunk):
            low, high = place[j, f]
            start, end = np.searchsorted(v, low, "left"), np.searchsorted(v, high, "right")
            near, count = (np.concatenate([x[a:b] for a, b in zip(start, end)]) for x in (v, w))
            # values below a bracket stand for its place, those above the last one for the end
            upto = np.append(0, np.cumsum(w))
            skipped = upto[np.append(start, len(v))] - upto[np.append(0, end)]
            yield pa.RecordBatch.from_pylist([{"run": j, "f": f, "v": near, "c": count, "skipped": skipped}], _INSIDE)

    def wanted(part: pa.Table) -> pa.Table:
        j, f = (part.column(c)[0].as_py() for c in ("run", "f"))
        v, c = (np.concatenate([x.values.to_numpy() for x in part.column(name)]) for name in ("v", "c"))
        order = np.argsort(v)
        v, c = v[order], c[order]
        skipped = np.sum([x.values.to_numpy() for x in part.column("skipped")], axis=0)
        upto = np.cumsum(c) + np.cumsum(skipped)[np.searchsorted(place[j, f][0], v, "right") - 1]
        rank = probs * (c.sum() + skipped.sum() - 1)
        a, z = (v[np.searchsorted(upto, side(rank), "right")] for side in (np.floor, np.ceil))
        return pa.table([part.column("run")[:1], part.column("f")[:1], pa.array([a + (rank - np.floor(rank)) * (z - a)])], ["run", "f", "q"])

    near = rows.mapInArrow(inside, "run int, f int, v array<double>, c array<long>, skipped array<long>")
    return near.groupBy("run", "f").applyInArrow(wanted, "run int, f int, q array<double>")


_SUMMARY = pa.schema([("run", pa.int32()), ("f", pa.int32()), ("stride", pa.int64()), ("v", pa.list_(pa.float64())), ("w", pa.list_(pa.int64()))])
_INSIDE = pa.schema([("run", pa.int32()), ("f", pa.int32()), ("v", pa.list_(pa.float64())), ("c", pa.list_(pa.int64())), ("skipped", pa.list_(pa.int64()))])


def quantile_edges(df: DataFrame, x: str, q: int, approximate: bool = False) -> list[float]:
    """``q + 1`` edges of bins with equal counts; edges that coincide are refused."""
    probs = [i / q for i in range(q + 1)]
    if approximate:
        row = df.agg(F.percentile_approx(F.col(x).cast("double"), probs, 10_000).alias("q")).first()
    else:
        row = exact_quantiles(df, x, probs).first()
    edges = list(row["q"])
    if len(set(edges)) != len(edges):
        raise ValueError(f"bin edges of {x} are not unique: {edges}")
    return edges


def quantile_bins(df: DataFrame, x: str, q: int, out: str, approximate: bool = False) -> DataFrame:
    return df.withColumn(out, num.bin_index(F.col(x), quantile_edges(df, x, q, approximate)))


def group_rank(
    df: DataFrame,
    group_by: Sequence[str],
    x: str,
    out: str,
    key_rows: int = KEY_ROWS,
    block_rows: int = BLOCK_ROWS,
    learned: DataFrame | None = None,
) -> DataFrame:
    """Rank of ``x`` inside its group from 1, ties averaged; NULL for a missing value or group.

    Values are counted per (group, value) before any ordering, so ties of any number are one row. ``learned`` may be a
    frame of the same rows that is cheaper to count.
    """
    known = F.col(x).isNotNull()
    for g in group_by:
        known = known & F.col(g).isNotNull()
    counts = (df if learned is None else learned).filter(known).groupBy(*group_by, x).agg(F.count(F.lit(1)).alias("__c"))
    counts = cut_lineage(counts, "counts")
    summed = running(counts, group_by, [x], {"__upto": ("sum", F.col("__c"))}, key_rows, block_rows)
    ranks = summed.select(*group_by, x, (F.col("__upto") - (F.col("__c") - 1) / F.lit(2.0)).alias(out))
    return attach(df, ranks, [*group_by, x])


def box_summary(df: DataFrame, group_by: Sequence[str], x: str) -> DataFrame:
    """Count, ends and quartiles per group."""
    ends = df.groupBy(*group_by).agg(F.count(x).alias("n"), F.min(x).alias("low"), F.max(x).alias("high"))
    quartiles = exact_quantiles(df, x, [0.25, 0.5, 0.75], group_by)
    names = ("q1", "median", "q3")
    spread = quartiles.select(*group_by, *[F.col("q")[i].alias(name) for i, name in enumerate(names)])
    return null_safe_join(ends, spread, group_by)
