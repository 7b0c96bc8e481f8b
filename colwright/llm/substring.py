"""Removal of long word sequences that a document with a smaller id has.

Matching is done by suffix automata of reference shards. A shard is all text around one *anchor*: the least of the hashes of
the ``gram``-word runs inside a window. Equal windows have equal anchors, so the window and every earlier copy of it meet in
the same shard, and only there. In a shard, pieces of text come in order of id. A piece is streamed through the automaton
of the pieces before it: wherever the matching statistic reaches ``window`` words and the matched words first started in a
smaller id, they are removed. Then the piece extends the automaton. Every transition compares a word itself, so
hashes only route and never decide.

A passage that very many documents share has anchors at its edges whose windows reach into different text in each of them.
Such *hot* anchors are split: each of their windows is a piece of its own, in the shard of its own hash, so that a shard
holds few different pieces however many documents share an anchor.

Sending whole automata of the corpus to all tasks would cost shards times documents; here only text whose anchor
occurs in at least two documents moves, and a piece is kept once per task however often it is copied.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from colwright.llm.common import (
    Words,
    ascii_space_split,
    binary_column,
    bit_filter,
    covered,
    filter_size,
    gram_hashes,
    key_of,
    passes,
    runs,
    signed,
    slices,
    to_batch,
    winnow,
    word_batches,
)
from colwright.storage import cut_lineage

WINDOW = 13
GRAM = 6
#: An anchor that occurs more often is hot.
HOT = 1000


class SuffixAutomaton:
    """Automaton of all word sequences of the added texts; each state knows the first id in which its sequences start."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [None]

    def _state(self, transitions: dict, link: int, length: int, first) -> int:
        self.next.append(transitions)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.next) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        """A state for the sequences of ``q`` that follow from ``p`` in one step."""
        clone = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1, self.first[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: list[bytes], owner: int) -> None:
        """Add one text. Owners must come in ascending order."""
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:  # the sequence is known from an earlier text
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
                continue
            new, p = self._state({}, 0, self.length[last] + 1, owner), last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
            last = new

    def spans(self, words: list[bytes], owner: int, least: int) -> list[tuple[int, int]]:
        """Maximal spans of ``words`` covered by sequences of ``least`` words that start in an owner before this one."""
        out: list[tuple[int, int]] = []
        state, matched = 0, 0
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            state = self.next[state].get(word, 0)
            matched = matched + 1 if state else 0
            while matched > least and self.length[self.link[state]] >= least:
                state = self.link[state]
                matched = self.length[state]
            if matched >= least and self.first[state] < owner:
                start = i - least + 1
                if out and start <= out[-1][1]:
                    out[-1] = (out[-1][0], i + 1)
                else:
                    out.append((start, i + 1))
        return out


def anchored(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first word, one past the last word) of each anchor, with the text that its windows cover."""
    text = words.text_of()
    grams = gram_hashes(words.hashes, gram)
    places = winnow(grams, window - gram + 1)
    inside = np.flatnonzero(text[: len(places)] == text[window - 1 :][: len(places)])
    places = places[inside]
    # the windows of one anchor are neighbours; anchors of neighbouring texts differ in place
    begin, end = runs(places)
    return grams[places[begin]], inside[begin], inside[end - 1] + window


def _anchors(window: int, gram: int):
    schema = pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = np.array(batch.column("doc_id").to_pylist(), np.int64)
            for begin, words in word_batches(binary_column(batch, "text"), ascii_space_split()):
                anchor, start, _ = anchored(words, window, gram)
                text = np.searchsorted(words.first, start, "right") - 1
                owner = ids[begin + text]
                order = np.lexsort((owner, anchor))
                anchor, owner = anchor[order], owner[order]
                # of one anchor the least and the largest id of these texts are enough
                b, e = runs(anchor)
                keep = np.unique(np.concatenate((b, e - 1)))
                n = np.zeros(len(anchor), np.int64)
                n[b] = e - b
                yield pa.RecordBatch.from_arrays([pa.array(signed(anchor[keep])), pa.array(owner[keep]), pa.array(n[keep])], schema=schema)

    return find


def shared_anchors(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """Anchors that occur in at least two ids, and how often they occur."""
    found = docs.mapInArrow(_anchors(window, gram), "anchor bigint, doc_id bigint, n bigint")
    ends = found.groupBy("anchor").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.sum("n").alias("n"))
    return ends.filter("least < most").select("anchor", "n")


_PIECE = "anchor bigint, doc_id bigint, text_key bigint, start int, stop int, piece binary"


def _copies_apart(rows: list[tuple]) -> list[tuple]:
    """A copy of a piece that a smaller id among these rows has is removed whole: its text need not move, and it goes to any
    shard, so that a common passage does not fill the shard of its anchor."""
    least = {}
    for a, owner, *_, piece in rows:
        if piece is not None:
            least[a, piece] = min(owner, least.get((a, piece), owner))
    return [r if r[5] is None or least[r[0], r[5]] == r[1] else (r[0] ^ r[2], *r[1:5], None) for r in rows]


def _by_window(rows: list[tuple], hot: set[int], window: int) -> Iterator[tuple]:
    """The rows, pieces of hot anchors as their single windows, whose shard is that of their own hash."""
    for row in rows:
        anchor, owner, key, start, _, piece = row
        if piece is None or anchor not in hot:
            yield row
            continue
        words = piece.split(b" ")
        for i in range(len(words) - window + 1):
            one = b" ".join(words[i : i + window])
            yield key_of(one), owner, key, start + i, start + i + window, one


def _pieces(shared, hot, window: int, gram: int):
    schema = pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("piece", pa.binary())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, texts = batch.column("doc_id").to_pylist(), binary_column(batch, "text")
            keys = [key_of(t or b"") for t in texts]
            for begin, words in word_batches(texts, ascii_space_split()):
                anchor, start, stop = anchored(words, window, gram)
                likely = np.flatnonzero(passes(anchor, shared.value))
                text = np.searchsorted(words.first, start[likely], "right") - 1
                rows = []
                for a, s, e, t in zip(signed(anchor[likely]).tolist(), start[likely].tolist(), stop[likely].tolist(), text.tolist(), strict=True):
                    piece = b" ".join(words.raw[words.starts[s] : words.ends[e - 1]].split())
                    zero = int(words.first[t])
                    rows.append((a, ids[begin + t], keys[begin + t], s - zero, e - zero, piece))
                rows = _copies_apart(rows)
                split = set(signed(anchor[likely][passes(anchor[likely], hot.value)]).tolist())
                if split:
                    rows = _copies_apart(list(_by_window(rows, split, window)))
                yield to_batch(schema, list(zip(*rows, strict=True)) if rows else [[]] * 6)

    return find


def _match(window: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])
    names = ("anchor", "doc_id", "text_key", "start", "stop", "piece")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shards follow each other in the order of anchors, pieces of a shard in the order of ids."""
        shard, automaton, known, waiting = None, SuffixAutomaton(), {}, []
        for batch in slices(batches):
            out = []
            for anchor, owner, key, start, stop, piece in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
                if anchor != shard:
                    shard, automaton, known, waiting = anchor, SuffixAutomaton(), {}, []
                if piece is None or known.get(piece, owner) < owner:
                    out.append((owner, key, start, stop))
                    continue
                if piece not in known or known[piece] == owner:
                    words = piece.split(b" ")
                    if known:  # the first piece of a shard has nothing before it
                        for text, first in waiting:
                            automaton.add(text, first)
                        waiting = []
                        out += [(owner, key, start + s, start + e) for s, e in automaton.spans(words, owner, window)]
                    if piece not in known:
                        known[piece] = owner
                        waiting.append((words, owner))
            yield to_batch(schema, list(zip(*out, strict=True)) if out else [[]] * 4)

    return match


def routed_pieces(docs: DataFrame, window: int, gram: int, hot: int | None = None) -> DataFrame:
    """The text around shared anchors, by shard (``anchor``); the piece of a row is NULL if a smaller id is known to have it."""
    spark = docs.sparkSession
    anchors = cut_lineage(shared_anchors(docs, window, gram), "anchors")
    shared = spark.sparkContext.broadcast(bit_filter(anchors.select("anchor"), filter_size(anchors.count())))
    # an anchor that only shares the bit of a hot one is split too, in all tasks alike, which changes no result
    often = anchors.filter(F.col("n") > (HOT if hot is None else hot)).select("anchor")
    split = spark.sparkContext.broadcast(bit_filter(often, filter_size(16 * often.count())))
    return docs.mapInArrow(_pieces(shared, split, window, gram), _PIECE)


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int | None = None) -> DataFrame:
    """(doc_id, text_key, start, stop), in words: what is covered by windows that start in a smaller id.

    ``docs`` has doc_id (bigint) and text. Documents without an id neither give nor lose anything. Spans of a document may
    overlap. Two rows of one id never lose words to each other; ``text_key`` tells their texts apart.
    """
    pieces = routed_pieces(docs.filter("doc_id IS NOT NULL"), window, gram, hot)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = pieces.repartition(parts, "anchor").sortWithinPartitions("anchor", "doc_id")
    return shards.mapInArrow(_match(window), "doc_id bigint, text_key bigint, start int, stop int")


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        kept, total, removed = [], [], []
        for text, spans in zip(binary_column(batch, "text"), batch.column("spans").to_pylist(), strict=True):
            words = (text or b"").split()
            out = covered([(s["start"], s["stop"]) for s in spans or []], len(words))
            total.append(len(words))
            removed.append(int(out.sum()))
            kept.append(b" ".join(words[i] for i in np.flatnonzero(~out).tolist()) if removed[-1] else b" ".join(words))
        columns = [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept"])


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int | None = None) -> DataFrame:
    """Per row: doc_id, n_words, n_removed and ``kept``, the words left, joined by one blank.

    Words are runs of characters other than ASCII white space. Each word is removed that a window of ``window`` words covers
    whose word sequence also starts in a document with a smaller id; windows are judged on the input. NULL and empty texts
    have no words; texts shorter than a window lose nothing; copies of a text keep it at the smallest id only.
    """
    spark = df.sparkSession
    slim = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    spans = repeated_spans(slim, window, gram, hot).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    spans = cut_lineage(spans, "spans")
    # most texts lose nothing: a filter of their keys tells which must meet the spans by shuffle
    losing = spark.sparkContext.broadcast(bit_filter(spans.select("text_key"), filter_size(spans.count())))

    def keyed(wanted: bool):
        def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                keys = np.array([key_of(t or b"") for t in binary_column(batch, "text")], np.int64)
                chosen = pa.array(passes(keys.view(np.uint64), losing.value) == wanted)
                full = pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys)], names=["doc_id", "text", "text_key"])
                yield full.filter(chosen)

        return slim.mapInArrow(select, "doc_id bigint, text string, text_key bigint")

    none = F.lit(None).cast("array<struct<start:int,stop:int>>").alias("spans")
    untouched = keyed(False).select("doc_id", "text", none)
    touched = keyed(True).join(spans, ["doc_id", "text_key"], "left").select("doc_id", "text", "spans")
    return untouched.unionByName(touched).mapInArrow(_cleaned, "doc_id bigint, n_words bigint, n_removed bigint, kept string")
