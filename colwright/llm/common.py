"""Words, hashes and written steps shared by the corpus operators.

Texts are handled as UTF-8 bytes, one document at a time, so that memory follows the longest document of a task.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)
_BYTE_BASE = 0x100000001B3
_WORD_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes hashed and bytes of text held at a time, which bounds the memory of many or long documents.
_BYTES_AT_ONCE = 1 << 18
_TEXT_AT_ONCE = 1 << 21


def crc_fold(column: Column, folds: int) -> Column:
    """``crc32`` of the value as text, modulo ``folds``; NULL for NULL."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(folds)


def ascii_space_split() -> np.ndarray:
    """Bytes that belong to words when words are separated by ASCII white space."""
    is_word = np.ones(256, bool)
    is_word[[0x20, *range(0x09, 0x0E)]] = False
    return is_word


def letters_and_digits_split() -> np.ndarray:
    """Bytes that belong to words of lower-cased text made of ASCII letters, digits and all other characters."""
    is_word = np.zeros(256, bool)
    is_word[0x30:0x3A] = True
    is_word[0x61:0x7B] = True
    is_word[0x80:] = True
    return is_word


def word_spans(raw: bytes, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every maximal run of word bytes."""
    flags = np.zeros(len(raw) + 2, np.int8)
    flags[1:-1] = is_word[np.frombuffer(raw, np.uint8)]
    edges = np.flatnonzero(np.diff(flags))
    return edges[::2], edges[1::2]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * _MIX_A
    h = (h ^ (h >> np.uint64(27))) * _MIX_B
    return h ^ (h >> np.uint64(31))


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, one per byte of a piece."""
    out = []
    for base in (_BYTE_BASE, pow(_BYTE_BASE, -1, 1 << 64)):
        steps = np.full(_BYTES_AT_ONCE, base, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def word_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray, powers: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """A 64-bit hash of each word, equal for equal bytes on every machine.

    A word is read as a polynomial; running sums over a piece of the text give all its words at once.
    """
    out = np.empty(len(starts), np.uint64)
    bytes_ = np.frombuffer(raw, np.uint8)
    power, inverse = powers or _powers()
    lo = 0
    while lo < len(starts):
        base = int(starts[lo])
        hi = int(np.searchsorted(ends, base + _BYTES_AT_ONCE, "right"))
        if hi <= lo:  # one word longer than a piece
            out[lo] = key_of(raw[base : int(ends[lo])]) & 0xFFFFFFFFFFFFFFFF
            lo += 1
            continue
        s, e = starts[lo:hi] - base, ends[lo:hi] - base
        n = int(e[-1])
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((bytes_[base : base + n].astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
        out[lo:hi] = mixed((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
        lo = hi
    return out


@dataclass
class Words:
    """Words of some texts, end to end; text ``i`` has the words from ``first[i]`` up to ``first[i + 1]``."""

    raw: bytes
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def text_of(self) -> np.ndarray:
        """Of each word the number of its text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def word(self, i: int) -> bytes:
        return self.raw[self.starts[i] : self.ends[i]]


def word_batches(texts: list[bytes | None], is_word: np.ndarray, lower: bool = False) -> Iterator[tuple[int, Words]]:
    """The words of all texts, some MB of text at a time, each with the place of its first text."""
    lo, powers = 0, _powers()
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi] or b"") <= _TEXT_AT_ONCE):
            size += len(texts[hi] or b"") + 1
            hi += 1
        part = [t or b"" for t in texts[lo:hi]]
        raw = b" ".join(part)
        raw = raw.lower() if lower else raw
        starts, ends = word_spans(raw, is_word)
        begins = np.cumsum([0] + [len(t) + 1 for t in part])
        yield lo, Words(raw, starts, ends, word_hashes(raw, starts, ends, powers), np.searchsorted(starts, begins))
        lo = hi


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of ``k`` neighbouring words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = out * _WORD_BASE + words[j : j + n]
    return mixed(out)


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """For each run of ``window`` neighbouring hashes the place of its least one (the first of equals)."""
    n = len(grams) - window + 1
    if n <= 0:
        return np.empty(0, np.int64)
    least, place = grams[:n], np.arange(n)
    for j in range(1, window):
        other = grams[j : j + n]
        place = np.where(other < least, np.arange(j, j + n), place)
        least = np.minimum(least, other)
    return place


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last index of every run of equal neighbours."""
    if not len(values):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
    return np.concatenate(([0], cuts)), np.concatenate((cuts, [len(values)]))


def covered(spans: list[tuple[int, int]], n: int) -> np.ndarray:
    """Flags of ``n`` words, true inside any span."""
    change = np.zeros(n + 1, np.int64)
    for s, e in spans:
        change[s] += 1
        change[e] -= 1
    return np.cumsum(change)[:n] > 0


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def key_of(raw: bytes) -> int:
    """A signed 64-bit key of a byte string."""
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


def binary_column(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    return batch.column(name).cast(pa.binary()).to_pylist()


#: Rows that move between the JVM and Python at a time; a row of a text table is some kB, of other tables some bytes.
ROWS_AT_ONCE = "1000"


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session, whose default of 10,000 rows suits narrow rows, not texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_AT_ONCE)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that what is made of a batch stays small in memory."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def to_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)],
        schema=schema,
    )


#: Bits of one of Spark's bitmaps, as a power of two.
_PART_BITS = 15


def bit_filter(keys: DataFrame, bits: int) -> bytes:
    """An array of ``2 ** bits`` bits in which the bits of all 64-bit keys (the only column) are set.

    Spark's bitmaps of 2^15 bits are its parts, so no Python worker is needed for it. The array has a fixed size and never
    misses a key; a fuller one lets more strangers through.
    """
    slot = F.shiftrightunsigned(F.col(keys.columns[0]), 64 - bits)
    part, place = F.shiftright(slot, _PART_BITS).cast("int").alias("part"), slot.bitwiseAND(F.lit((1 << _PART_BITS) - 1))
    # bitmaps begin with the lowest bit of a byte, the array with the highest
    bitmap = F.bitmap_construct_agg(place.bitwiseXOR(F.lit(7))).alias("bitmap")
    size = 1 << min(bits, _PART_BITS) >> 3
    out = bytearray(1 << bits >> 3)
    for r in keys.dropna().groupBy(part).agg(bitmap).collect():  # at most 32 MB
        out[r["part"] * size : (r["part"] + 1) * size] = r["bitmap"][:size]
    return bytes(out)


def passes(keys: np.ndarray, filter_: bytes) -> np.ndarray:
    """Whether the bit of each key (unsigned) is set."""
    flags = np.frombuffer(filter_, np.uint8)
    bits = (len(filter_) * 8).bit_length() - 1
    slot = (keys >> np.uint64(64 - bits)).astype(np.int64)
    return (flags[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1


def filter_size(n_keys: int, least: int = 16, most: int = 28) -> int:
    """Bits (as a power of two) for about one stranger in 16, up to 32 MB."""
    return max(least, min(most, (16 * max(1, n_keys)).bit_length() - 1))


def id_text(df: DataFrame, id_col: str, text_col: str, *others: str) -> DataFrame:
    """Only the named columns, under fixed names, so that further columns of any name do no harm."""
    return df.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
        *[F.col(f"`{c}`").alias(c) for c in others],
    )


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
