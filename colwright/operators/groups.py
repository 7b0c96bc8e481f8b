"""Group statistics written back to rows, frequencies and residuals.

All of them aggregate first, with partial sums on the map side, and join the small result back. A window over the
group key would send every row of a hot group to one task.

``fit_on`` limits the rows that statistics are learned from, for example to the training folds. ``learned`` is a frame of the same
rows to learn from, where ``df`` has gained columns that would have to be computed again for it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from colwright.functions import numeric as num
from colwright.functions.text import combine
from colwright.operators.lookup import attach, attach_single
from colwright.operators.quantiles import GROUP_VALUES, exact_quantiles, group_widths
from colwright.storage import cut_lineage

_SIMPLE = {
    "min": F.min,
    "max": F.max,
    "mean": lambda x: F.avg(x),
    "std": lambda x: F.stddev_samp(x),
    "count": F.count,
}
#: Statistics that ``group_statistics`` knows.
STATISTICS = (*_SIMPLE, "median", "nunique")


def _fitted(df: DataFrame, fit_on: Column | None) -> DataFrame:
    return df if fit_on is None else df.filter(fit_on)


def group_statistics(
    df: DataFrame, by: Sequence[str], wanted: Mapping[str, tuple[str, str]], fit_on: Column | None = None
) -> DataFrame:
    """One row per known key: ``wanted`` maps the output name to (statistic, input column)."""
    rows = _fitted(df, fit_on)
    for k in by:
        rows = rows.filter(F.col(k).isNotNull())
    simple, distinct, medians = [], [], {}
    for out, (stat, x) in wanted.items():
        if stat in _SIMPLE:
            simple.append(_SIMPLE[stat](F.col(x)).alias(out))
        elif stat == "nunique":
            distinct.append(F.count_distinct(F.col(x)).alias(out))
        elif stat == "median":
            medians[out] = x
        else:
            raise ValueError(f"unknown statistic {stat}; known are {', '.join(STATISTICS)}")
    if medians and group_widths(rows, by, list(medians.values()))[1] <= GROUP_VALUES:
        simple += [F.median(F.col(x).cast("double")).alias(out) for out, x in medians.items()]
        medians = {}
    parts = []
    if simple:
        parts.append(rows.groupBy(*by).agg(*simple))
    parts += [rows.groupBy(*by).agg(d) for d in distinct]
    for out, x in medians.items():
        parts.append(exact_quantiles(rows, x, [0.5], by).select(*by, F.col("q")[0].alias(out)))
    stats = parts[0]
    for part in parts[1:]:
        stats = stats.join(part, list(by), "full")
    return stats


def with_group_statistics(
    df: DataFrame,
    by: Sequence[str],
    wanted: Mapping[str, tuple[str, str]],
    fit_on: Column | None = None,
    learned: DataFrame | None = None,
) -> DataFrame:
    """Group statistics on every row; a NULL key gives NULL."""
    return attach(df, group_statistics(df if learned is None else learned, by, wanted, fit_on), by)


def with_out_of_fold_mean(df: DataFrame, by: Sequence[str], x: str, fold: str, out: str) -> DataFrame:
    """Group mean over the rows of all other folds, for every fold at once.

    Sums per (group, fold) are taken in one pass; a fold's training sums are the group's totals less its own.
    """
    rows = df
    for k in by:
        rows = rows.filter(F.col(k).isNotNull())
    v = F.col(x).cast("double")
    parts = rows.groupBy(*by, fold).agg(F.count(v).alias("__n"), F.coalesce(F.sum(v), F.lit(0.0)).alias("__s"))
    parts = cut_lineage(parts, "folds")
    totals = parts.groupBy(*by).agg(F.sum("__n").alias("__gn"), F.sum("__s").alias("__gs"))
    mean = F.try_divide(F.col("__gs") - F.col("__s"), F.col("__gn") - F.col("__n"))
    return attach(df, parts.join(totals, list(by)).select(*by, fold, mean.alias(out)), [*by, fold])


#: Keys that one pass over the rows serves; a row is copied once per key before rows are combined.
SETS = 16


def _known(columns: Sequence[str]) -> Column:
    known = F.lit(True)
    for c in columns:
        known = known & F.col(f"`{c}`").isNotNull()
    return known


def _set_number(members: Sequence[str], columns: Sequence[str]) -> int:
    """What ``grouping_id`` is for the rows of a set: a bit for each column that is not in it."""
    return sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in members)


def _distinct_counts(rows: DataFrame, wanted: Sequence[tuple[tuple[str, ...], str]]) -> dict[tuple[tuple[str, ...], str], DataFrame]:
    """Number of different known values of a column per key, for all (key, column) from one expansion of the rows."""
    keys = list(dict.fromkeys(k for by, _ in wanted for k in by))
    inputs = list(dict.fromkeys(x for _, x in wanted))
    # a column may be key of one set and input of another, so inputs get names of their own
    value = {x: f"__v{i}" for i, x in enumerate(inputs)}
    columns = [*keys, *value.values()]
    sets = [[*by, value[x]] for by, x in wanted]
    copies = rows.select(*[F.col(f"`{k}`") for k in keys], *[F.col(f"`{x}`").alias(v) for x, v in value.items()])
    different = copies.groupingSets([[F.col(f"`{c}`") for c in s] for s in sets], *[F.col(f"`{c}`") for c in columns])
    different = different.agg(F.grouping_id().alias("__set"))
    known = F.lit(False)
    for s in sets:
        known = known | ((F.col("__set") == _set_number(s, columns)) & _known(s))
    counted = different.filter(known).groupBy("__set", *[F.col(f"`{k}`") for k in keys]).agg(F.count(F.lit(1)).alias("__n"))
    counted = cut_lineage(counted, "different")
    return {
        (by, x): counted.filter(F.col("__set") == _set_number(s, columns)).select(*[F.col(f"`{k}`") for k in by], "__n")
        for (by, x), s in zip(wanted, sets, strict=True)
    }


def statistics_by_keys(
    df: DataFrame, wanted: Mapping[tuple[str, ...], Mapping[str, tuple[str, str]]], fit_on: Column | None = None
) -> dict[tuple[str, ...], DataFrame]:
    """``group_statistics`` of several keys, each of one or more columns, as one table per key.

    Sums and the like of up to ``SETS`` keys come from one scan with grouping sets, distinct counts of all keys and columns
    from another; both combine rows before the shuffle. Medians are taken key by key.
    """
    rows = _fitted(df, fit_on)
    found: dict[tuple[str, ...], DataFrame] = {}
    every = list(wanted)
    for start in range(0, len(every), SETS):
        some = every[start : start + SETS]
        keys = list(dict.fromkeys(k for by in some for k in by))
        simple = list(dict.fromkeys(w for by in some for w in wanted[by].values() if w[0] in _SIMPLE))
        names = {w: f"__s{i}" for i, w in enumerate(simple)}
        numbers = {by: _set_number(by, keys) for by in some}
        # keys with the same columns in another order are one set
        sets = list({n: [F.col(f"`{k}`") for k in by] for by, n in numbers.items()}.values())
        measures = [_SIMPLE[stat](F.col(f"`{x}`")).alias(names[stat, x]) for stat, x in simple]
        summed = rows.groupingSets(sets, *[F.col(f"`{k}`") for k in keys]).agg(F.grouping_id().alias("__set"), *measures)
        summed = cut_lineage(summed, "sets")
        counts = list(dict.fromkeys((by, x) for by in some for stat, x in wanted[by].values() if stat == "nunique"))
        distinct = _distinct_counts(rows, counts) if counts else {}
        for by in some:
            outs = wanted[by]
            own = summed.filter((F.col("__set") == numbers[by]) & _known(by))
            table = own.select(
                *[F.col(f"`{k}`") for k in by],
                *[F.col(names[w]).alias(out) for out, w in outs.items() if w in names],
            )
            medians = {out: w for out, w in outs.items() if w[0] == "median"}
            if medians:
                table = table.join(group_statistics(rows, by, medians), list(by), "left")
            for out, (stat, x) in outs.items():
                if stat == "nunique":
                    counted = distinct[by, x].withColumnRenamed("__n", out)
                    table = table.join(counted, list(by), "left").withColumn(out, F.coalesce(F.col(f"`{out}`"), F.lit(0)))
                elif stat not in STATISTICS:
                    raise ValueError(f"unknown statistic {stat}; known are {', '.join(STATISTICS)}")
            found[by] = table.select(*[F.col(f"`{k}`") for k in by], *[F.col(f"`{out}`") for out in outs])
    return found


def with_statistics_by_keys(
    df: DataFrame,
    wanted: Mapping[tuple[str, ...], Mapping[str, tuple[str, str]]],
    fit_on: Column | None = None,
    learned: DataFrame | None = None,
) -> DataFrame:
    """Statistics of several keys on every row; a key with a NULL column gives NULL."""
    for by, table in statistics_by_keys(df if learned is None else learned, wanted, fit_on).items():
        df = attach(df, table, by)
    return df


def with_group_deviation(
    df: DataFrame, by: Sequence[str], x: str, out: str, fit_on: Column | None = None
) -> DataFrame:
    joined = with_group_statistics(df, by, {"__mean": ("mean", x)}, fit_on)
    return joined.withColumn(out, num.subtract(F.col(x), F.col("__mean"))).drop("__mean")


def value_counts(df: DataFrame, x: str, fit_on: Column | None = None) -> DataFrame:
    return _fitted(df, fit_on).filter(F.col(x).isNotNull()).groupBy(x).agg(F.count(F.lit(1)).alias("n"))


def with_frequency(
    df: DataFrame, x: str, out: str, fit_on: Column | None = None, relative: bool = True, learned: DataFrame | None = None
) -> DataFrame:
    """Share of the known rows that have the same value, or their number; a missing value stays missing."""
    counts = cut_lineage(value_counts(df if learned is None else learned, x, fit_on), "counts")
    share = F.col("n")
    if relative:
        share = share / F.lit(counts.agg(F.sum("n")).first()[0]).cast("long")
    return attach(df, counts.select(x, share.alias(out)), [x], written=True)


def with_combined_frequency(
    df: DataFrame, xs: Sequence[str], out: str, fit_on: Column | None = None
) -> DataFrame:
    combined = df.withColumn("__combined", combine(*[F.col(x) for x in xs]))
    return with_frequency(combined, "__combined", out, fit_on).drop("__combined")


def with_residual(df: DataFrame, x: str, out: str, fit_on: Column | None = None, learned: DataFrame | None = None) -> DataFrame:
    mean = _fitted(df if learned is None else learned, fit_on).agg(F.avg(x).alias("__mean"))
    return attach_single(df, mean).withColumn(out, num.subtract(F.col(x), F.col("__mean"))).drop("__mean")


def with_range_scaled(df: DataFrame, x: str, out: str, fit_on: Column | None = None, learned: DataFrame | None = None) -> DataFrame:
    ends = _fitted(df if learned is None else learned, fit_on).agg(F.min(x).cast("double").alias("__lo"), F.max(x).cast("double").alias("__hi"))
    scaled = num.scale_range(F.col(x), F.col("__lo"), F.col("__hi"))
    return attach_single(df, ends).withColumn(out, scaled).drop("__lo", "__hi")
