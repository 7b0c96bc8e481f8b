"""Periodic runs in word sequences, found with a dictionary of basic factors.

A *basic factor* is a stretch of ``2^k`` words. Level by level every basic factor gets a name, equal for equal factors: a
factor of level ``k + 1`` is named by the names of its two halves, so names are exact. The places of one name in one document
are put in order; where the successor of a place lies at a distance ``d`` of at most twice the factor's length, and so does
its successor in turn, the places form an arithmetic progression, and ``d`` is proposed as a period. Neighbouring places that
propose the same ``d`` belong to one run; it is extended as far as words ``d`` apart are identical, and runs that several
levels propose are kept once.

A run with period ``q`` that holds four periods is proposed at the level with ``2^(k-1) < q <= 2^k``: factors at least as long
as the period occur in the run exactly every ``q`` words. A smaller distance would make the repeated part a power of a shorter
one, so proposed distances are smallest periods.

Only factors whose both halves are repeated in their document get a name at the next level: all factors of a run are. In
prose few factors of four words and more are left, so upper levels cost little.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from colwright.llm.common import binary_column, covered, slices

#: A run has at least so many words, and so many times its period.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Bytes of text whose words are named together.
_TEXT_AT_ONCE = 1 << 21


def _successors(places: np.ndarray, names: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, their next places of the same name in the same document), for those that have one."""
    order = np.argsort(names, kind="stable")
    at, named = places[order], names[order]
    same = (named[1:] == named[:-1]) & (doc[at[1:]] == doc[at[:-1]])
    return at[:-1][same], at[1:][same]


def find_runs(ids: np.ndarray, first: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs in some documents end to end.

    ``ids`` are the numbers of the words, document ``i`` has those from ``first[i]`` up to ``first[i + 1]``. ``periods`` must be
    at least four, which the levels rest on.
    """
    if periods < 4:
        raise ValueError("runs of fewer than four periods are not all proposed")
    lengths = np.diff(first)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    end = first[1:][doc]
    runs: set[tuple[int, int, int]] = set()
    longest = int(lengths.max(initial=0)) // periods
    places, names, span = np.arange(len(ids)), ids.astype(np.int64), 1
    while len(places):
        here, there = _successors(places, names, doc)
        runs.update(_proposed(ids, first, doc, here, there - here, span, least, periods))
        if span >= longest:
            break
        repeated = np.union1d(here, there)
        name_at = np.full(len(ids), -1, np.int64)
        name_at[places] = names
        left = repeated[repeated + 2 * span <= end[repeated]]
        known = np.zeros(len(ids) + 1, bool)
        known[repeated] = True
        left = left[known[left + span]]
        pairs = name_at[left] * (int(names.max()) + 1) + name_at[left + span]
        names = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
        places, span = left, 2 * span
    return sorted(runs)


def _proposed(ids, first, doc, here, distance, span, least, periods) -> Iterator[tuple[int, int, int]]:
    """Runs that the progressions of one level propose."""
    near = distance <= 2 * span
    here, distance = here[near], distance[near]
    order = np.argsort(here)
    here, distance = here[order], distance[order]
    if not len(here):
        return
    cut = (np.diff(here) != 1) | (np.diff(distance) != 0) | (np.diff(doc[here]) != 0)
    lo = np.concatenate(([0], np.flatnonzero(cut) + 1))
    hi = np.concatenate((np.flatnonzero(cut) + 1, [len(here)]))
    # places more than d long hold i and i + d, whose successors i + d and i + 2 d make a progression
    long = hi - lo > distance[lo]
    for a, b in zip(lo[long].tolist(), hi[long].tolist(), strict=True):
        d = int(distance[a])
        start, stop = int(here[a]), int(here[b - 1]) + d + span
        low, high = int(first[doc[here[a]]]), int(first[doc[here[a]] + 1])
        while start > low and ids[start - 1] == ids[start - 1 + d]:
            start -= 1
        while stop < high and ids[stop] == ids[stop - d]:
            stop += 1
        if stop - start >= max(least, periods * d):
            yield start, stop, d


def _documents(texts: list[bytes | None], codes: list, arrange) -> Iterator[tuple[list[list[bytes]], list[np.ndarray]]]:
    """Words of some texts and the order in which they are read, about 2 MB of text at a time."""
    words, orders, size = [], [], 0
    for text, code in zip(texts, codes, strict=True):
        own = (text or b"").split()  # at ASCII white space, as bytes
        order = arrange(code, len(own)) if arrange is not None and code is not None and own else None
        words.append(own)
        orders.append(order if order is not None else np.arange(len(own)))
        size += len(text or b"")
        if size >= _TEXT_AT_ONCE:
            yield words, orders
            words, orders, size = [], [], 0
    if words:
        yield words, orders


_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_SCHEMA = pa.schema([("n_words", pa.int64()), ("runs", _RUN), ("collapsed", pa.binary())])


def _collapse(own: list[bytes], order: np.ndarray, runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run drops, joined by one space; a run keeps its first period."""
    if runs:
        order = order[~covered([(s + p, e) for s, e, p in runs], len(order))]
    elif len(order) == len(own) and (not len(order) or order[-1] == len(own) - 1):
        return b" ".join(own) if np.array_equal(order, np.arange(len(own))) else b" ".join([own[i] for i in order.tolist()])
    return b" ".join([own[i] for i in order.tolist()])


def _scan(arrange, least: int, periods: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for words, orders in _documents(binary_column(batch, "text"), batch.column("code").to_pylist(), arrange):
                numbers: dict[bytes, int] = {}
                ids = [
                    np.array([numbers.setdefault(w, len(numbers)) for w in own], np.int64)[order] for own, order in zip(words, orders, strict=True)
                ]
                first = np.cumsum([0] + [len(i) for i in ids])
                found: list[list[tuple[int, int, int]]] = [[] for _ in ids]
                runs = find_runs(np.concatenate(ids), first, least, periods)
                homes = np.searchsorted(first, [s for s, _, _ in runs], "right") - 1
                for home, (s, e, p) in zip(homes.tolist(), runs, strict=True):
                    found[home].append((s - int(first[home]), e - int(first[home]), p))
                for own, order, mine in zip(words, orders, found, strict=True):
                    rows.append((len(order), [(s, e - s, p) for s, e, p in mine], _collapse(own, order, mine)))
            columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_SCHEMA)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", *_SCHEMA.names])

    return scan


def periodic_runs(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    code: Column | None = None,
    arrange: Callable[[int, int], np.ndarray | None] | None = None,
    least: int = LEAST_WORDS,
    periods: int = LEAST_PERIODS,
) -> DataFrame:
    """One row per row of ``df``: doc_id, n_words, runs (array of start, length, period by start, then period) and collapsed.

    Words are separated by ASCII white space. A run is a stretch with smallest period ``q`` that has at least
    ``max(least, periods * q)`` words and that no neighbouring word extends. ``collapsed`` are the words left when of every run
    only its first ``q`` words stay (a word goes if any run drops it), joined by one space.

    ``arrange(code, n)`` may give the order in which the ``n`` words of a document are read, as word numbers with repeats; None
    leaves the text as it is. It is not asked where ``code`` is NULL. A text that is NULL, empty or blank has no words and no
    runs; rows that repeat an id are documents of their own; an empty table gives no rows; other columns of ``df`` are not
    looked at. A document is handled by one task, in memory that grows with its length; there is no shuffle.
    """
    slim = df.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
        (F.lit(None) if code is None else code).cast("long").alias("code"),
    )
    out = slim.mapInArrow(
        _scan(arrange, least, periods),
        "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed binary",
    )
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))


def longest_run(runs: Column) -> Column:
    """Of an array of runs the longest, of equals the one that starts first, then the one with the smallest period; NULL of none."""
    ranked = F.transform(runs, lambda r: F.struct((-r["length"]).alias("shortness"), r["start"].alias("start"), r["period"].alias("period")))
    return F.array_min(ranked)


def run_digests(found: DataFrame) -> DataFrame:
    """Counts, the longest run, and digests of all runs and of the collapsed text, of the rows of ``periodic_runs``."""
    top = longest_run(F.col("runs"))
    length = -top["shortness"]
    lines = F.transform("runs", lambda r: F.concat_ws(",", *[r[k].cast("string") for k in ("start", "length", "period")]))
    listed = F.concat_ws("", F.transform(lines, lambda x: F.concat(x, F.lit("\n"))))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        top["start"].alias("start"),
        length.alias("length"),
        top["period"].alias("period"),
        F.floor(F.lit(1000) * length / top["period"]).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def periodic_tail(code: int, n: int) -> np.ndarray | None:
    """Word order of a text whose end is overwritten with a repeated part, so that every corpus holds long runs.

    ``code`` is a digest: where its last digit is 0, the other digits choose the place and the length of the part.
    """
    if code % 10:
        return None
    g = code // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    order = np.arange(n)
    order[a:] = a + (order[a:] - a) % p
    return order
