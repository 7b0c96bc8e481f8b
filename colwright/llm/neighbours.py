"""Approximate nearest neighbours by a forest of random-projection trees.

The trees are fitted on a bounded sample of the vectors and have a fixed depth, so the forest has a proven size; every
vector is indexed in one leaf of each tree. A query walks all trees through one shared priority queue, ordered by the
largest margin by which a branch was missed, and takes the best leaves of the whole forest. Queries and vectors meet by
leaf, both cut into blocks, so a task holds one block of each however full a leaf is. Candidates are ranked by their exact
cosine.

Equal vectors are indexed once, with the smallest ids that any result can need: a result of ``k`` rows never shows more than
``k + 1`` copies of one vector, ties going to smaller ids.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from colwright.storage import cut_lineage

TREES = 8
DEPTH = 7
#: Vectors on which the trees are fitted, about, drawn by a hash of the vector.
SAMPLE_ROWS = 16_384
#: Sample vectors per leaf at least; smaller tables have shallower trees.
LEAF_ROWS = 8
#: Part of all leaves of the forest that a query visits. Vectors without any structure need about this much for a recall
#: of 0.95; clustered ones far less.
VISITED = 0.22
#: Rows and queries of one leaf that meet in one task.
BLOCK_ROWS = 8_192
BLOCK_QUERIES = 4_096


@dataclass
class Forest:
    """Per tree the split directions (nodes x dimensions) and offsets of a complete binary tree of ``depth`` levels."""

    directions: np.ndarray
    offsets: np.ndarray
    depth: int

    @property
    def leaves(self) -> int:
        return 1 << self.depth

    def leaf_of(self, unit: np.ndarray) -> np.ndarray:
        """The leaf in each tree (columns) of each vector (rows)."""
        out = np.zeros((len(unit), len(self.directions)), np.int32)
        for t, (d, o) in enumerate(zip(self.directions, self.offsets, strict=True)):
            node = np.zeros(len(unit), np.int64)
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", unit, d[node]) >= o[node]
                node = 2 * node + 1 + side
            out[:, t] = node - (self.leaves - 1)
        return out

    def best_leaves(self, unit: np.ndarray, visits: int) -> list[list[int]]:
        """Per vector the ``visits`` best leaves of all trees (tree * leaves + leaf) through one queue."""
        if not self.depth:
            return [list(range(len(self.directions)))] * len(unit)
        margins = np.einsum("qd,tnd->qtn", unit, self.directions) - self.offsets
        inner = self.leaves - 1
        out = []
        for m in margins.tolist():
            queue = [(0.0, t, 0) for t in range(len(m))]
            found: list[int] = []
            while queue and len(found) < visits:
                missed, t, node = heapq.heappop(queue)
                while node < inner:
                    margin = m[t][node]
                    near, far = (2 * node + 2, 2 * node + 1) if margin >= 0 else (2 * node + 1, 2 * node + 2)
                    heapq.heappush(queue, (max(missed, abs(margin)), t, far))
                    node = near
                found.append(t * self.leaves + node - inner)
            out.append(found)
        return out


def fit_forest(unit: np.ndarray, trees: int, depth: int, seed: int = 7) -> Forest:
    """Each node splits its sample at the median along the difference of two of its vectors."""
    rng = np.random.default_rng(seed)
    inner = (1 << depth) - 1
    directions, offsets = np.zeros((trees, inner, unit.shape[1])), np.zeros((trees, inner))
    for t in range(trees):
        members = {0: np.arange(len(unit))}
        for node in range(inner):
            own = members.pop(node)
            gap = np.zeros(unit.shape[1])
            if len(own) > 1:
                a, b = rng.choice(own, 2, replace=False)
                gap = unit[a] - unit[b]
            if not gap.any():
                gap = rng.normal(size=unit.shape[1])
            gap /= np.linalg.norm(gap)
            along = unit[own] @ gap
            directions[t, node], offsets[t, node] = gap, np.median(along) if len(own) else 0.0
            side = along >= offsets[t, node]
            members[2 * node + 1], members[2 * node + 2] = own[~side], own[side]
    return Forest(directions, offsets, depth)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part: of the commonest length, all components finite, not all zero."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    slim = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v")).dropna()
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    slim = slim.filter(finite & F.exists("v", lambda x: x != 0))
    sizes = slim.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return slim.filter(F.size("v") == (sizes[0]["d"] if sizes else 0))


def distinct_vectors(points: DataFrame, copies: int) -> DataFrame:
    """(v, ids): each different vector with its smallest ``copies`` ids.

    The row limit per vector is applied in the tasks before rows move, so a very common vector does not meet in one task.
    """
    same = Window.partitionBy("v").orderBy("vec_id")
    first = points.distinct().withColumn("n", F.row_number().over(same)).filter(F.col("n") <= copies)
    return first.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def _matrix(column) -> np.ndarray:
    """One vector a row, each scaled by the power of two that brings its largest component to 0.5 up to 1.

    Such a scale changes no digit of a cosine, and squares of components neither overflow nor all vanish.
    """
    m = np.stack(column.to_numpy()).astype(np.float64)
    return np.ldexp(m, -np.frexp(np.abs(m).max(axis=1, keepdims=True))[1])


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def nearest(
    vectors: DataFrame,
    query_rule,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    trees: int = TREES,
    depth: int = DEPTH,
    visited: float = VISITED,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """The ``k`` nearest found for every row that meets ``query_rule`` (a condition on ``vec_id``): query_id, rank, vec_id, score.

    Nearness is the cosine in double precision; ties go to the smaller id, a query does not find its own id, and fewer than
    ``k`` rows come back only where the visited leaves hold fewer. Vectors that are NULL, zero, of another length than most, or
    hold NULL or non-finite components take no part, those of any finite size do; rows with equal id and vector count once.
    An empty table gives no rows.
    """
    spark = vectors.sparkSession
    points = usable(vectors, id_col, vector_col)
    classes = cut_lineage(distinct_vectors(points, k + 1), "vectors")
    n = classes.count()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not n:
        return spark.createDataFrame([], schema)
    share = min(1.0, sample_rows / n)
    drawn = classes.filter(F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("v").toPandas()
    sample = _unit(_matrix(drawn["v"])) if len(drawn) else np.zeros((0, 1))
    sample = sample[np.lexsort(sample.T)] if len(sample) else sample
    while depth and len(sample) < LEAF_ROWS << depth:
        depth -= 1
    forest = fit_forest(sample, trees, depth)
    if depth == 0:
        forest = Forest(np.zeros((1, 0, sample.shape[1])), np.zeros((1, 0)), 0)
    visits = max(1, int(np.ceil(visited * len(forest.directions) * forest.leaves)))
    # plain values: executors need no copy of this package to read them
    shared = spark.sparkContext.broadcast((forest.directions, forest.offsets, forest.depth))
    leaves = forest.leaves
    queries = points.filter(query_rule).distinct()
    n_queries = queries.count()
    row_blocks = -(-n // (forest.leaves * BLOCK_ROWS))
    query_blocks = max(1, -(-int(n_queries * min(1.0, 2 * visited)) // BLOCK_QUERIES))

    def index(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                leaf = Forest(*shared.value).leaf_of(_unit(_matrix(part["v"])))
                cells = leaf + np.arange(leaf.shape[1]) * leaves
                yield pd.DataFrame({"cell": list(cells), "ids": part["ids"], "v": part["v"]})

    def visit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for lo in range(0, len(part), 256):
                few = part.iloc[lo : lo + 256]
                cells = Forest(*shared.value).best_leaves(_unit(_matrix(few["v"])), visits)
                yield pd.DataFrame({"cell": cells, "query_id": few["vec_id"], "v": few["v"]})

    def in_blocks(df: DataFrame, own: str, blocks: int, others: str, copies: int, key: str) -> DataFrame:
        """One row per cell, in its own block and in a copy for each block of the other side."""
        df = df.withColumn("cell", F.explode("cell")).withColumn(own, F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
        return df.withColumn(others, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))

    indexed = in_blocks(classes.mapInPandas(index, "cell array<int>, ids array<bigint>, v array<double>"), "rb", row_blocks, "qb", query_blocks, "v")
    visiting = in_blocks(queries.mapInPandas(visit, "cell array<int>, query_id bigint, v array<double>"), "qb", query_blocks, "rb", row_blocks, "query_id")

    def rank(queries_here: pd.DataFrame, rows_here: pd.DataFrame) -> pd.DataFrame:
        if not len(queries_here) or not len(rows_here):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        rows, asked = _matrix(rows_here["v"]), _matrix(queries_here["v"])
        rows_norm, asked_norm = np.linalg.norm(rows, axis=1), np.linalg.norm(asked, axis=1)
        ids = [np.asarray(x) for x in rows_here["ids"]]
        found_q, found_v, found_s = [], [], []
        for lo in range(0, len(asked), 512):
            near = (asked[lo : lo + 512] @ rows.T) / rows_norm
            # k + 1 different vectors hold the k best ids, the query's own among them
            last = -np.partition(-near, min(k, near.shape[1] - 1), axis=1)[:, min(k, near.shape[1] - 1)]
            for i, (line, bound) in enumerate(zip(near, last, strict=True)):
                q, own = asked[lo + i], queries_here["query_id"].iat[lo + i]
                kept = np.flatnonzero(line >= bound - 1e-9 * abs(bound) - 1e-12)
                exact = (rows[kept] * q).sum(axis=1) / (rows_norm[kept] * asked_norm[lo + i])
                pairs = sorted((-s, v) for s, j in zip(exact.tolist(), kept, strict=True) for v in ids[j].tolist() if v != own)[:k]
                found_q += [own] * len(pairs)
                found_v += [v for _, v in pairs]
                found_s += [-s for s, _ in pairs]
        return pd.DataFrame({"query_id": found_q, "vec_id": found_v, "score": found_s})

    keys = ["cell", "rb", "qb"]
    pairs = visiting.groupBy(*keys).cogroup(indexed.groupBy(*keys)).applyInPandas(rank, "query_id bigint, vec_id bigint, score double")
    best = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
