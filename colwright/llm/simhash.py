"""Near duplicates by SimHash fingerprints, joined through a hierarchical index in Gray order.

Fingerprints that are near in Gray order share many bits. Sorted by Gray rank, neighbouring fingerprints are put together, a
few at a time, level by level. A node keeps the *masked pattern* of the bits that all fingerprints under it share; a child
adds only bits that its parent has not fixed yet. Two nodes are compared on the bits that both have fixed: differences
found higher up are carried along, and only those of newly fixed bits are added. A pair of nodes with more differences
than allowed is dropped with everything under it; a pair whose free bits cannot bring it over the limit is linked as a whole.

The uppermost nodes deal the index out to tasks. The bits are cut into ``blocks``; two fingerprints with at most ``radius``
different bits agree in all but ``radius`` blocks, so for each choice of the agreeing blocks an upper node fixes exactly their
bits, and each fingerprint stands under one upper node per choice. No link between different upper nodes of a choice need
be sought: under some choice its two ends have the same one. The number of blocks follows the number of fingerprints, so that
an upper node holds few of them.

An upper node with more than ``NODE`` fingerprints (a large group of near copies) is replaced by finer ones: its free bits are
cut into blocks in the same way, as often as it takes. So a task never holds more than ``NODE`` fingerprints of a node, no
link is lost, and no fingerprint is left out. Of the links under a node as many are kept as connect the same fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from colwright.llm.common import binary_column, slices
from colwright.llm.components import smallest_reachable
from colwright.storage import cut_lineage

SHINGLE = 4
SEED = 42
#: Differing bits of linked fingerprints.
RADIUS = 4
#: Fingerprints that a task holds of one upper node.
NODE = 8192
#: Fingerprints per upper node that the number of blocks aims at, if they were spread evenly.
AIM = 64
#: Nodes that are put together on the next level.
FANOUT = 8
#: Rows that are indexed together, and pairs of nodes that are compared together.
_ROWS, _PAIRS = 1 << 16, 1 << 18
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


# --- fingerprints


def shingle_hashes(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle of a text, repeats included; of fewer words of the whole sequence; nothing without words."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, len(words) - shingle + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit ``i`` is set if it is set in over half of the hashes; 0 of none."""
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[lo : lo + (1 << 16)]).astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def _fingerprints(shingle: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [fingerprint(shingle_hashes(t, shingle)) for t in binary_column(batch, "text")]
            codes = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), codes], names=["doc_id", "code"])

    return scan


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, code) of every row; codes are 64 bits in a signed column."""
    slim = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return slim.mapInArrow(_fingerprints(shingle), "doc_id bigint, code bigint")


# --- upper nodes


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@lru_cache(maxsize=4096)
def finer_masks(mask: int, blocks: int, radius: int) -> tuple[int, ...]:
    """Masks that fix the bits of ``mask`` and all but ``radius`` of the blocks into which the other bits are cut."""
    free = [i for i in range(64) if not mask >> i & 1]
    blocks = min(blocks, len(free))
    if blocks <= radius:
        return (mask,)
    cuts = [len(free) * b // blocks for b in range(blocks + 1)]
    parts = [sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    return tuple(mask | sum(kept) for kept in combinations(parts, blocks - radius))


def block_count(n: int, radius: int = RADIUS, aim: int = AIM) -> int:
    """The fewest blocks whose upper nodes fix enough bits for ``n`` fingerprints."""
    blocks = radius + 1
    while blocks < 2 * radius + 4 and n > aim << (64 * (blocks - radius) // blocks):
        blocks += 1
    return blocks


def gray_rank(code: Column) -> Column:
    """Place of a code in Gray order: each bit is the parity of itself and all higher bits."""
    return reduce(lambda x, k: x.bitwiseXOR(F.shiftrightunsigned(x, k)), (1, 2, 4, 8, 16, 32), code)


def _finer(blocks: int, radius: int):
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks, codes = batch.column("mask").to_numpy(), batch.column("code").to_numpy()
            for mask in np.unique(masks).tolist():
                own = codes[masks == mask]
                for finer in finer_masks(mask & 0xFFFFFFFFFFFFFFFF, blocks, radius):
                    fixed = pa.array(np.full(len(own), _signed(finer), np.int64))
                    yield pa.RecordBatch.from_arrays([fixed, pa.array(own)], names=["mask", "code"])

    return spread


# --- the index below an upper node


def _levels(group: np.ndarray, codes: np.ndarray, fanout: int):
    """Levels from the fingerprints up, each (mask, pattern, group, first child, one past the last child, first row, one past the last row)."""
    n = len(codes)
    rows = np.arange(n)
    levels = [(np.full(n, _ALL), codes, group, rows, rows + 1, rows, rows + 1)]
    while True:
        mask, pattern, own, _, _, low, high = levels[-1]
        starts = np.concatenate(([0], np.flatnonzero(own[1:] != own[:-1]) + 1))
        if len(starts) == len(own):
            return levels
        place = np.arange(len(own)) - np.repeat(starts, np.diff(np.concatenate((starts, [len(own)]))))
        first = np.flatnonzero(place % fanout == 0)
        last = np.concatenate((first[1:], [len(own)]))
        differs = pattern ^ np.repeat(pattern[first], last - first)
        fixed = np.bitwise_and.reduceat(mask & ~differs, first)
        levels.append((fixed, pattern[first] & fixed, own[first], first, last, low[first], high[last - 1]))


class _Components:
    """Smallest row of the component of each row."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while True:
                further = self.label[self.label]
                if np.array_equal(further, self.label):
                    break
                self.label = further


def _expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, value): all values of the ranges, with the place of their range."""
    sizes = hi - lo
    place = np.repeat(np.arange(len(lo)), sizes)
    return place, np.arange(len(place)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + lo[place]


def linked(group: np.ndarray, codes: np.ndarray, radius: int = RADIUS, fanout: int = FANOUT) -> np.ndarray:
    """For each row the first row of its component within its group.

    Rows are sorted by group and, within a group, by Gray rank; equal codes do not occur twice in a group.
    """
    levels = _levels(group, codes, fanout)
    found = _Components(len(codes))
    top = len(levels) - 1
    roots = np.arange(len(levels[top][0]))
    # (level, a, b, differences so far, bits compared so far)
    todo = [(top, roots, roots, np.zeros(len(roots), np.uint8), np.zeros(len(roots), np.uint64))]
    while todo:
        level, a, b, seen, compared = todo.pop()
        if len(a) > _PAIRS:
            for lo in range(0, len(a), _PAIRS):
                part = slice(lo, lo + _PAIRS)
                todo.append((level, a[part], b[part], seen[part], compared[part]))
            continue
        mask, pattern, _, first, last, low, high = levels[level]
        both = mask[a] & mask[b]
        seen = seen + np.bitwise_count((pattern[a] ^ pattern[b]) & both & ~compared)
        near = seen <= radius
        a, b, seen, both = a[near], b[near], seen[near], both[near]
        whole = seen + (64 - np.bitwise_count(both)) <= radius
        if whole.any():
            x, y = a[whole], b[whole]
            if level:  # any two rows of such a pair of nodes are linked
                for nodes, others in ((x, y), (y, x)):
                    at, rows = _expand(low[nodes], high[nodes])
                    head = low[others][at]
                    found.join(rows, head)
            else:
                found.join(x, y)
        rest = ~whole
        if not level or not rest.any():
            continue
        a, b, seen, both = a[rest], b[rest], seen[rest], both[rest]
        at, child = _expand(first[a], last[a])
        pair, other = _expand(first[b][at], last[b][at])
        child, at = child[pair], at[pair]
        ordered = (a[at] != b[at]) | (child <= other)
        at = at[ordered]
        todo.append((level - 1, child[ordered], other[ordered], seen[at], both[at]))
    return found.label


def _search(radius: int):
    """Links (a, b) under the upper nodes of a sorted partition, a few thousand rows at a time."""

    def links(mask: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
        upper = codes & mask
        new = np.concatenate(([False], (mask[1:] != mask[:-1]) | (upper[1:] != upper[:-1])))
        label = linked(np.cumsum(new), codes.view(np.uint64), radius)
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(codes[moved]), pa.array(codes[label[moved]])], names=["a", "b"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks, codes, size = [], [], 0
        for batch in batches:
            masks.append(batch.column("mask").to_numpy())
            codes.append(batch.column("code").to_numpy())
            size += batch.num_rows
            if size < _ROWS:
                continue
            m, c = np.concatenate(masks), np.concatenate(codes)
            upper = c & m
            same = (m == m[-1]) & (upper == upper[-1])
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0  # the last node may go on
            if cut:
                yield links(m[:cut], c[:cut])
            masks, codes, size = [m[cut:]], [c[cut:]], len(m) - cut
        if size:
            yield links(np.concatenate(masks), np.concatenate(codes))

    return search


def connecting_links(codes: DataFrame, radius: int = RADIUS, node: int = NODE, blocks: int | None = None) -> DataFrame:
    """Links (a, b) of distinct fingerprints (column ``code``) that connect exactly those that all links connect."""
    if node < 1 << radius:
        raise ValueError("a node with all bits but the differing ones fixed must fit")
    n = codes.count()
    blocks = blocks or block_count(n, radius)
    masks = F.array(*[F.lit(_signed(m)) for m in finer_masks(0, blocks, radius)])
    rows = codes.select(F.explode(masks).alias("mask"), "code")
    links = None
    while True:
        keyed = rows.withColumn("upper", F.col("code").bitwiseAND(F.col("mask")))
        full = keyed.groupBy("mask", "upper").agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") > node)
        full = cut_lineage(full.select(F.col("mask").alias("m"), F.col("upper").alias("u")), "full_nodes")
        same = (F.col("mask") == F.col("m")) & (F.col("upper") == F.col("u"))
        some_full = not full.isEmpty()
        small = keyed.join(full, same, "left_anti") if some_full else keyed
        dealt = small.repartition("mask", "upper").withColumn("rank", gray_rank(F.col("code"))).sortWithinPartitions("mask", "upper", "rank")
        found = cut_lineage(dealt.select("mask", "code").mapInArrow(_search(radius), "a bigint, b bigint").distinct(), "links")
        links = found if links is None else links.union(found)
        if not some_full:
            return links
        large = keyed.join(full, same, "left_semi").select("mask", "code")
        finer = large.mapInArrow(_finer(radius + 2, radius), "mask bigint, code bigint")
        rows = cut_lineage(finer.distinct(), "finer_nodes")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, node: int = NODE) -> DataFrame:
    """One row per row of ``df``: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints link at ``radius`` or fewer differing bits; ``component_id`` is the smallest doc_id reachable over links, its
    own included. A text that is NULL, empty or blank has the fingerprint zero, which links like any other. Equal fingerprints
    always link. Rows that repeat an id are documents of their own; NULL ids are never the smallest unless all are. An
    empty table gives no rows; other columns are not looked at. Texts are read whole, one document in memory at a time.
    """
    rows = cut_lineage(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    codes = cut_lineage(rows.groupBy("code").agg(F.min("doc_id").alias("least")), "codes")
    roots = smallest_reachable(connecting_links(codes.select("code"), radius, node))
    grouped = codes.join(roots, codes["code"] == roots["node"], "left").select("code", "least", F.coalesce("root", "code").alias("root"))
    grouped = cut_lineage(grouped, "grouped")
    smallest = cut_lineage(grouped.groupBy("root").agg(F.min("least").alias("component_id")), "smallest")
    named = cut_lineage(grouped.join(smallest, "root").select(F.col("code").alias("of"), "component_id"), "named")
    own = rows.join(named, F.col("code") == F.col("of"), "left")
    return own.select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")
