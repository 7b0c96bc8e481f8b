"""Boosted trees of many models at once.

A *model* is a set of features and a fold; several candidates over several folds are dozens of models on the same rows.

Values are cut once per (fold, feature) at exact quantiles of the fold's training rows; missing values are a bin of their own
below all others. Training rows of a model that agree in all bins (and in the class) are one *cell*, with their number and the sum
of their targets: trees can't tell them apart, so they grow on cells as they would on rows. Cells are counted on the map side, and
their number is bounded by the bins, not by the rows, as long as features are few.

A model of up to ``CELLS_AT_ONCE`` cells grows in one task, all such models in one job. Larger ones grow together: per level of the
trees one pass over their cells, in which every task adds up a histogram per (model, class, node, feature, bin), and one sum of
those histograms. So the number of jobs is at most rounds times levels, whatever the number of models, and cells are neither
shuffled nor written again while trees grow.

Trees are chosen from sums of fixed size (models x nodes x features x bins). In passes, scores of earlier rounds are worked out again
from the trees, which are small, so no state has to survive between passes and a lost executor costs the tasks it ran.

Targets and derivatives are rounded to a millionth of the largest target before they are added, so that sums are the same in any
order and reruns agree. Regression fits residuals: the first tree the target itself, later ones a tenth of what is left. Classes are
learned by softmax, one tree per class and round, with Newton steps.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from colwright.operators import encode
from colwright.operators.folds import is_train
from colwright.operators.parallel import side_by_side
from colwright.operators.quantiles import packed_quantiles, unpacked
from colwright.storage import cut_lineage

#: Quantile bins of a feature; with the least value and the bin of missing values there are two more.
BINS = 64
DEPTH = 5
ROUNDS = 20
#: Share of a tree that is added: of the first regression tree, of later ones, of class trees.
FIRST, LATER, OF_CLASSES = 1.0, 0.1, 0.3
#: Added to the second derivatives of class trees.
SMOOTHING = 1e-3
#: Derivatives are rounded to this share of the largest target (of one, for classes).
_QUANTUM = 2.0**-20
#: Rows or cells that a task works on at a time.
_ROWS = 1 << 15
#: Cells of a model up to which one task grows all of its trees.
CELLS_AT_ONCE = 1 << 18
_SUMS = 16


@dataclass
class Trees:
    """Trees of one model in heap order: node ``i`` has the children ``2 i + 1`` and ``2 i + 2``; feature -1 is a leaf.

    ``features`` are places in a binned row; cells hold the bins of these alone, and trees number them from 0.
    """

    fold: int
    features: np.ndarray
    classes: int
    scale: float = 1.0
    done: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = field(default_factory=list)
    growing: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def raw(self, bins: np.ndarray, since: int = 0) -> np.ndarray:
        out = np.zeros((len(bins), self.classes))
        for trees in self.done[since:]:
            for k, tree in enumerate(trees):
                out[:, k] += tree[2][leaves(tree, bins)]
        return out

    def plant(self, depth: int) -> None:
        size = 2 ** (depth + 1) - 1
        self.growing = [(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)) for _ in range(self.classes)]

    def finish_round(self) -> None:
        self.done.append(self.growing)
        self.growing = []


@dataclass
class Cells:
    """Different rows of a model: bins, class, number of rows, and sum of their targets in units of the quantum."""

    bins: np.ndarray
    y: np.ndarray
    n: np.ndarray
    s: np.ndarray


def leaves(tree: tuple[np.ndarray, np.ndarray, np.ndarray], bins: np.ndarray) -> np.ndarray:
    """The node that each row has come to."""
    feature, cut, _ = tree
    node = np.zeros(len(bins), np.int64)
    rows = np.arange(len(bins))
    for _ in range(int(np.log2(len(feature) + 1))):
        f = feature[node]
        inner = f >= 0
        if not inner.any():
            break
        right = bins[rows[inner], f[inner]] > cut[node[inner]]
        node[inner] = 2 * node[inner] + 1 + right
    return node


def gradients(model: Trees, cells: Cells, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of first and second derivatives per cell and class, in quanta; of one class those of squared error, else of softmax."""
    n, quantum = cells.n[:, None], model.scale * _QUANTUM
    if model.classes == 1:
        return cells.s[:, None] - n * np.rint(raw / quantum), n
    e = np.exp(raw - raw.max(axis=1, keepdims=True))
    p = e / e.sum(axis=1, keepdims=True)
    own = np.arange(model.classes)[None, :] == cells.y[:, None]
    return n * np.rint((own - p) / quantum), n * np.rint(p * (1 - p) / quantum)


def add_histogram(out: np.ndarray, model: Trees, level: int, cells: Cells, g: np.ndarray, h: np.ndarray) -> None:
    """Add cells to ``out`` (class, node of the level, feature, bin, sums of 1, g, h)."""
    first, width = 2**level - 1, out.shape[3]
    for k, tree in enumerate(model.growing):
        node = leaves(tree, cells.bins) - first
        here = node >= 0
        at = node[here] * width
        sums = [cells.n[here], g[here, k], h[here, k]]
        for f in range(len(model.features)):
            place = at + cells.bins[here, f]
            for s, weights in enumerate(sums):
                out[k, :, f, :, s] += np.bincount(place, weights, out.shape[1] * width).reshape(out.shape[1], width)


def grow_level(model: Trees, level: int, sums: np.ndarray, last: bool, step: float) -> bool:
    """Split the nodes of a level where that explains most, or make them leaves; whether any was split."""
    split_any = False
    smooth = SMOOTHING if model.classes > 1 else 0.0
    quantum = model.scale * _QUANTUM
    for k, (feature, cut, value) in enumerate(model.growing):
        for node in range(2**level):
            n, g, h = (sums[k, node, :, :, s] for s in range(3))
            g, h = g * quantum, (h * quantum if model.classes > 1 else n)
            rows, total_g, total_h = n[0].sum(), g[0].sum(), h[0].sum()
            at = 2**level - 1 + node
            if not rows:
                continue
            share = (model.classes - 1) / model.classes if model.classes > 1 else 1.0
            value[at] = step * share * total_g / (total_h + smooth)
            if last:
                continue
            ln, lg, lh = (np.cumsum(x, axis=1)[:, :-1] for x in (n, g, h))
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = lg**2 / (lh + smooth) + (total_g - lg) ** 2 / (total_h - lh + smooth) - total_g**2 / (total_h + smooth)
            gain[(ln == 0) | (ln == rows) | ~np.isfinite(gain)] = 0
            best = int(np.argmax(gain))
            f, b = divmod(best, gain.shape[1])
            if gain[f, b] > 4 * rows * quantum**2:  # more than rounding explains
                feature[at], cut[at] = f, b
                split_any = True
    return split_any


def _step(model: Trees, turn: int) -> float:
    return OF_CLASSES if model.classes > 1 else FIRST if turn == 0 else LATER


def _matrix(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    rows = batch.column("bins").to_pylist()
    return np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1) if rows else np.empty((0, 0), np.uint8)


def _cells(batch: pa.RecordBatch | pa.Table) -> Cells:
    return Cells(_matrix(batch), *[batch.column(c).to_numpy().astype(float) for c in ("y", "n", "s")])


def cells_of(train: DataFrame, models: Sequence[Trees]) -> DataFrame:
    """(model, y, bins, n, s): the training rows (run, y, bins) of each model, equal ones as one cell."""
    runs = list(dict.fromkeys(m.fold for m in models))
    parts = []
    for i, m in enumerate(models):
        some = F.concat(*[F.substring("bins", int(f) + 1, 1) for f in m.features])
        parts.append((m.fold, F.struct(F.lit(i).alias("model"), some.alias("bins"), F.lit(m.scale * _QUANTUM).alias("unit"))))
    own = F.lit(None)
    for j in runs:
        own = F.when(F.col("run") == j, F.array(*[x for fold, x in parts if fold == j])).otherwise(own)
    rows = train.select("y", F.inline(own))
    if models[0].classes > 1:
        return rows.groupBy("model", "y", "bins").agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("s"))
    target = F.rint(F.col("y") / F.col("unit")).cast("long")
    return rows.groupBy("model", F.lit(0.0).alias("y"), "bins").agg(F.count(F.lit(1)).alias("n"), F.sum(target).alias("s"))


def grow_alone(model: Trees, cells: Cells, width: int, rounds: int, depth: int) -> None:
    """All trees of a model, on all of its cells at once."""
    raw = np.zeros((len(cells.n), model.classes))
    for turn in range(rounds):
        g, h = gradients(model, cells, raw)
        model.plant(depth)
        for level in range(depth + 1):
            sums = np.zeros((model.classes, 2**level, len(model.features), width, 3))
            add_histogram(sums, model, level, cells, g, h)
            if not grow_level(model, level, sums, level == depth, _step(model, turn)):
                break
        grown = any((feature >= 0).any() for feature, _, _ in model.growing)
        model.finish_round()
        if not grown:
            return
        raw += model.raw(cells.bins, turn)


def _grown_alone(models: Mapping[int, Trees], width: int, rounds: int, depth: int):
    def grow(part: pa.Table) -> pa.Table:
        number = part.column("model")[0].as_py()
        model = models[number]
        grow_alone(model, _cells(part.combine_chunks()), width, rounds, depth)
        blob = np.array([[[*tree] for tree in trees] for trees in model.done]).tobytes()
        return pa.table({"model": pa.array([number], pa.int32()), "trees": pa.array([blob], pa.binary())})

    return grow


def _read_trees(blob: bytes, model: Trees, depth: int) -> None:
    shape = (-1, model.classes, 3, 2 ** (depth + 1) - 1)
    for trees in np.frombuffer(blob).reshape(shape):
        model.done.append([(f.astype(np.int64), cut.astype(np.int64), value) for f, cut, value in trees])


def _histograms(models: Mapping[int, Trees], level: int, width: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((m.classes, 2**level, len(m.features), width, 3)) for m in models.values()]
        slot = 0
        for whole in batches:
            for lo in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(lo, _ROWS)
                number = batch.column("model").to_numpy()
                slot += batch.num_rows
                for out, (i, m) in zip(sums, models.items(), strict=True):
                    own = np.flatnonzero(number == i)
                    if len(own):
                        cells = _cells(batch.take(pa.array(own)))
                        add_histogram(out, m, level, cells, *gradients(m, cells, m.raw(cells.bins)))
        if slot:
            blob = np.concatenate([s.ravel() for s in sums]).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([slot % _SUMS], pa.int32()), pa.array([blob], pa.binary())], names=["slot", "sums"])

    return scan


def _added(part: pa.Table) -> pa.Table:
    """The sum of some arrays, one at a time in memory."""
    blobs = part.column("sums")
    total = np.zeros(len(blobs[0].as_py()) // 8)
    for b in blobs:
        total += np.frombuffer(b.as_py(), np.float64)
    return pa.table({"slot": part.column("slot")[:1].cast(pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})


def _level_sums(cells: DataFrame, models: Mapping[int, Trees], level: int, width: int) -> list[np.ndarray]:
    rows = cells.mapInArrow(_histograms(models, level, width), "slot int, sums binary")
    # at most ``_SUMS`` rows; sums are whole numbers, so their order does not matter
    parts = rows.groupBy("slot").applyInArrow(_added, "slot int, sums binary").collect()
    shapes = [(m.classes, 2**level, len(m.features), width, 3) for m in models.values()]
    sizes = [int(np.prod(s)) for s in shapes]
    total = np.sum([np.frombuffer(r["sums"], np.float64) for r in parts], axis=0) if parts else np.zeros(sum(sizes))
    return [x.reshape(s) for x, s in zip(np.split(total, np.cumsum(sizes)[:-1]), shapes, strict=True)]


def _grow_together(cells: DataFrame, models: Mapping[int, Trees], width: int, rounds: int, depth: int) -> None:
    """Trees of models of many cells; a model whose round splits nothing is finished."""
    active = dict(models)
    for turn in range(rounds):
        for m in active.values():
            m.plant(depth)
        going, grown = dict(active), set()
        for level in range(depth + 1):
            sums = _level_sums(cells, going, level, width)
            split = [i for (i, m), s in zip(going.items(), sums, strict=True) if grow_level(m, level, s, level == depth, _step(m, turn))]
            grown.update(split)
            going = {i: going[i] for i in split}
            if not going:
                break
        for m in active.values():
            m.finish_round()
        active = {i: m for i, m in active.items() if i in grown}
        if not active:
            break


def fit(train: DataFrame, models: list[Trees], width: int, rounds: int = ROUNDS, depth: int = DEPTH, at_once: int = CELLS_AT_ONCE) -> None:
    """Grow the trees of all models on rows (run, y, bins)."""
    largest = {r["run"]: r["y"] for r in train.groupBy("run").agg(F.max(F.abs("y")).alias("y")).collect()}  # one row per fold
    empty = sorted({m.fold for m in models} - set(largest))
    if empty:
        raise ValueError(f"folds {empty} have no rows to train on")
    for m in models:
        m.scale = 1.0 if m.classes > 1 else largest[m.fold] or 1.0
    cells = cut_lineage(cells_of(train, models), "cells")
    sizes = {r["model"]: r["count"] for r in cells.groupBy("model").count().collect()}  # one row per model
    small = {i: m for i, m in enumerate(models) if sizes[i] <= at_once}
    if small:
        # more partitions than models, so that few of them meet in one task
        own = cells.filter(F.col("model").isin(*small)).repartition(4 * len(small), "model")
        found = own.groupBy("model").applyInArrow(_grown_alone(small, width, rounds, depth), "model int, trees binary")
        for r in found.collect():  # some trees per model
            _read_trees(r["trees"], models[r["model"]], depth)
    large = {i: m for i, m in enumerate(models) if i not in small}
    if large:
        _grow_together(cells.filter(F.col("model").isin(*large)), large, width, rounds, depth)


def _predicted(models: list[tuple[str, Trees]], keep: Sequence[str]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(lo, _ROWS)
                bins, run = _matrix(batch), batch.column("run").to_numpy()
                for name, m in models:
                    own = np.flatnonzero(run == m.fold)
                    if not len(own):
                        continue
                    raw = m.raw(bins[np.ix_(own, m.features)])
                    best = raw[:, 0] if m.classes == 1 else raw.argmax(axis=1).astype(float)
                    columns = [batch.column(c).take(pa.array(own)) for c in keep]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([name] * len(own)), pa.array(best)], names=[*keep, "candidate", "prediction"])

    return scan


def binned_rows(rows: DataFrame, n_features: int, keep: Sequence[str]) -> DataFrame:
    """(run, held, y, keep…, bins): the values ``xs`` cut at the quantiles of the rows of their run that are not held out."""
    cuts = packed_quantiles(rows.filter(~F.col("held")), "xs", [i / BINS for i in range(BINS)], "run")
    edges = {(r["run"], r["f"]): np.unique(np.array(r["q"], float)) for r in cuts.collect()}  # one row per run and feature

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            run = batch.column("run").to_numpy()
            xs = unpacked(batch, "xs")
            bins = np.zeros(xs.shape, np.uint8)
            for j in np.unique(run):
                own = np.flatnonzero(run == j)
                for f in range(n_features):
                    x = xs[own, f]
                    known = ~np.isnan(x)
                    bins[own[known], f] = np.searchsorted(edges.get((int(j), f), np.empty(0)), x[known]) + 1
            columns = [batch.column(c) for c in ("run", "held", "y", *keep)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([r.tobytes() for r in bins], pa.binary())], names=["run", "held", "y", *keep, "bins"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in ("run", "held", "y", *keep))
    return cut_lineage(rows.mapInArrow(cut, f"{schema}, bins binary"), "bins")


def out_of_fold(
    tables: Mapping[int, DataFrame],
    candidates: Mapping[str, Sequence[str]],
    target: str,
    fold: str,
    ordered: bool,
    classes: int | None = None,
    rounds: int = ROUNDS,
    depth: int = DEPTH,
    parallel: int = 4,
    at_once: int = CELLS_AT_ONCE,
) -> DataFrame:
    """(fold, target, candidate, prediction): every row of fold ``j`` of ``tables[j]``, by trees of the other rows it trains on.

    ``candidates`` name the columns that each of them reads. Category codes are learned from the training rows of a fold. Rows
    with an unknown target are not trained on. ``classes`` is None for a numeric target, else the target is a code.
    """
    columns = list(dict.fromkeys(c for some in candidates.values() for c in some))

    def numbers(j: int) -> list[DataFrame]:
        table, train = tables[j], is_train(F.col(fold), j, ordered)
        used = table.select(target, fold, *[F.col(f"`{c}`").alias(f"__x{i}") for i, c in enumerate(columns)])
        learned, test, _ = encode.train_test_tables(used.filter(train | (F.col(fold) == j)), train, [target, fold])
        xs = F.array(*[F.col(f"__x{i}") for i in range(len(columns))]).alias("xs")
        return [
            part.select(F.lit(j).alias("run"), F.lit(held).alias("held"), F.col(target).cast("double").alias("y"), fold, xs)
            for part, held in ((learned.filter(F.col(target).isNotNull()), False), (test, True))
        ]

    spark = next(iter(tables.values())).sparkSession
    parts = [part for some in side_by_side(spark, numbers, list(tables), parallel) for part in some]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows = binned_rows(cut_lineage(rows, "values"), len(columns), [fold])
    place = {c: i for i, c in enumerate(columns)}
    models = [(name, Trees(j, np.array([place[c] for c in some]), classes or 1)) for name, some in candidates.items() for j in tables]
    fit(rows.filter(~F.col("held")).select("run", "y", "bins"), [m for _, m in models], BINS + 2, rounds, depth, at_once)
    held = rows.filter("held")
    fold_type = held.schema[fold].dataType.simpleString()
    found = held.mapInArrow(_predicted(models, [fold, "y"]), f"`{fold}` {fold_type}, y double, candidate string, prediction double")
    return found.withColumnRenamed("y", target)
