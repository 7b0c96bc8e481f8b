"""Set similarity join on word shingles by token-combination prefixes.

Tokens (hashes of ``SHINGLE``-word shingles) are ordered from rare to frequent. Sets that are similar enough share ``m``
tokens among their first ``n - need + m`` ones, where ``need`` is the overlap that any partner must have, for any ``m``. The
prefix is extended to an ``m`` that follows the size of the set. A rare token is an index key by itself. Frequent tokens,
whose lists would be long, are not: keys are the pairs of frequent tokens of the prefix.

Two sets whose overlap must be ``both`` share even ``both - need + m`` tokens of their prefixes (the larger need of the two),
as at most ``n - both`` tokens of a set are not shared. Of so many shared tokens r rare and f frequent ones give
r + f (f - 1) / 2 common keys, at least their number less one: pairs with fewer common keys are never verified. A set with very many frequent tokens would have very many pairs; it indexes its frequent tokens
singly instead, under keys of their own, which all sets also look up but only such *heavy* sets are joined through.

The order comes from a count of all tokens of the corpus in an array of fixed size (tokens that share a slot share its
count), so it is one bounded broadcast. Any order gives the same result; a finer one only saves work.

Most keys are held by one class and find nothing. They are told apart before anything moves by key: tasks send 31 bits of each
key, packed into one array per bucket of keys, and a bucket tells which it has met twice. Only keys that pass a bit filter of
those are entered in the index, so strangers cost some work and no link. A class is looked at in one of its documents only, or its
copies would make all its keys look shared.

For this the prefix is a long one, as similar sets share the more of it the longer it is: a class with fewer keys that pass than
any similar set has in common with it has no partner and is not entered. Of the others only the keys of a short prefix are.

Equal sets are one class. Links between classes are verified by the exact overlap of their token sets. For groups, candidates
come in rounds: first each class with one pivot per key, which joins large groups of near copies by few links, then the
pairs of a key that are not yet in one group. Of these only keys within the shortest prefix are looked at: the first token that
similar sets of known sizes share lies so early that the tokens from there on can still make up their overlap. Sets whose
own edits fill that prefix never meet, however large the group of near copies they are in.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from colwright.llm.common import (
    ascii_space_split,
    binary_column,
    bit_filter,
    filter_size,
    gram_hashes,
    key_of,
    mixed,
    passes,
    runs,
    slices,
    to_batch,
    word_batches,
)
from colwright.llm.components import smallest_reachable
from colwright.storage import cut_lineage, scratch

SHINGLE = 5
#: Similarity in percent.
PERCENT = 75
#: Slots of the token count, as a power of two.
COUNT_BITS = 21
#: Parts in which the token counts of a task are summed up.
_PIECES = 64
#: A token is frequent if its slot counts this much above twice the mean of all slots.
FREQUENT = 64
#: Sets with more frequent tokens than this in their prefix are heavy.
HEAVY = 16
#: Roles of keys: a rare token, a light set's look-up of a frequent one, a heavy set's frequent token, a pair of frequent tokens.
RARE, LOOK_UP, HEAVY_TOKEN, PAIR = range(4)
#: Bits of a key that are packed within its bucket, and how many keys a bucket should hold.
_PACKED_BITS, _BUCKET_KEYS = 31, 1 << 20
#: Keys that a task holds before it sends them.
_FLUSH_KEYS = 1 << 18
_SHORT = np.uint64(0x2545F4914F6CDD1D)


def shingle_sets(texts: list[bytes | None], shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; of fewer words the whole sequence; nothing without words."""
    for _, words in word_batches(texts, ascii_space_split(), lower=True):
        grams = gram_hashes(words.hashes, shingle)
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            if b - a >= shingle:
                yield np.unique(grams[a : b - shingle + 1])
            elif b > a:
                yield gram_hashes(words.hashes[a:b], b - a) ^ _SHORT
            else:
                yield np.empty(0, np.uint64)


def class_key(tokens: np.ndarray) -> int | None:
    """A 64-bit key of a set; None for the empty set."""
    return key_of(tokens.tobytes()) if len(tokens) else None


def _slots(tokens: np.ndarray, bits: int) -> np.ndarray:
    return (mixed(tokens) >> np.uint64(64 - bits)).astype(np.int64)


_MEMBER = "doc_id bigint, cls bigint, n bigint, counts binary"


def _members(shingle: int, bits: int):
    schema = pa.schema([("doc_id", pa.int64()), ("cls", pa.int64()), ("n", pa.int64()), ("counts", pa.binary())])

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per document, and at the end of each task rows with the token counts of its part, numbered by ``n``."""
        counts = np.zeros(1 << bits, np.uint32)
        for batch in slices(batches):
            keys, sizes, slots = [], [], [np.empty(0, np.int64)]
            for tokens in shingle_sets(binary_column(batch, "text"), shingle):
                slots.append(_slots(tokens, bits))
                keys.append(class_key(tokens))
                sizes.append(len(tokens))
            counts += np.bincount(np.concatenate(slots), minlength=1 << bits).astype(np.uint32)
            yield to_batch(schema, [batch.column("doc_id"), keys, sizes, [None] * len(keys)])
        pieces = [zlib.compress(c.tobytes(), 1) for c in np.split(counts, _PIECES)]
        yield to_batch(schema, [[None] * _PIECES, [None] * _PIECES, list(range(_PIECES)), pieces])

    return members


def _sum_counts(rows: DataFrame, bits: int) -> np.ndarray:
    def add(piece: pa.Table) -> pa.Table:
        total = np.zeros((1 << bits) // _PIECES, np.uint32)
        for c in piece.column("counts"):
            total += np.frombuffer(zlib.decompress(c.as_py()), np.uint32)
        return pa.table({"n": piece.column("n")[:1], "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    out = np.zeros((_PIECES, (1 << bits) // _PIECES), np.uint32)
    for r in rows.select("n", "counts").groupBy("n").applyInArrow(add, "n bigint, counts binary").collect():
        out[r["n"]] = np.frombuffer(zlib.decompress(r["counts"]), np.uint32)
    return out.ravel()


@dataclass
class Order:
    """Frequency class of each slot (the binary logarithm of its count), and the first class that counts as frequent."""

    level: np.ndarray
    frequent: int
    bits: int

    def prefix(self, tokens: np.ndarray, percent: int, common: int) -> tuple[np.ndarray, np.ndarray]:
        """The first tokens from rare to frequent, of which similar sets share ``common``, and which of them are frequent."""
        level = self.level[_slots(tokens, self.bits)]
        need = -(-percent * len(tokens) // 100)
        # tokens are sorted, so equal levels stay in the order of their hashes
        chosen = np.argsort(level, kind="stable")[: len(tokens) - need + common]
        return tokens[chosen], level[chosen] >= self.frequent


def order_of(counts: np.ndarray, bits: int) -> Order:
    level = np.ceil(np.log2(counts.astype(np.float64) + 1)).astype(np.uint8)
    return Order(level, int(np.ceil(np.log2(2 * counts.mean() + FREQUENT))), bits)


def extra_common(n: int) -> int:
    """How many tokens beyond two the extended prefixes of similar sets must share, 0 to 7, for a set of ``n``."""
    return min(7, n // 32)


def more_common(n: int) -> int:
    """The same for the long prefix, by which classes without a partner are told."""
    return n // 8


def least_keys(n: int, percent: int) -> int:
    """How many keys of its long prefix a set has in common with any similar one, at least.

    The smaller of the two has ``percent`` of the other's tokens, and the keys may be one fewer than the tokens they share.
    """
    smaller = -(-percent * n // 100)
    return min(2 + more_common(smaller), smaller) - 1


def index_keys(tokens: np.ndarray, order: Order, percent: int, heavy: int = HEAVY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, roles, places) of the long prefix of a set. A look-up meets only tokens of heavy sets; all others meet their like.

    The place of a key is that of its last token in the prefix.
    """
    prefix, frequent = order.prefix(tokens, percent, 2 + more_common(len(tokens)))
    rare, common = mixed(prefix[~frequent]), prefix[frequent]
    rare_at, common_at = np.flatnonzero(~frequent), np.flatnonzero(frequent)
    single = mixed(common ^ np.uint64(0xA0761D6478BD642F))
    if len(common) > heavy:
        return np.concatenate((rare, single)), np.repeat([RARE, HEAVY_TOKEN], [len(rare), len(single)]), np.concatenate((rare_at, common_at))
    # all sets list their tokens in one order, so a pair has one key
    i, j = np.triu_indices(len(common), 1)
    pairs = mixed(mixed(common[i]) * np.uint64(3) + common[j])
    roles = np.repeat([RARE, PAIR, LOOK_UP], [len(rare), len(pairs), len(single)])
    return np.concatenate((rare, pairs, single)), roles, np.concatenate((rare_at, common_at[j], common_at))


def _at_home(batch: pa.RecordBatch, homes: bytes) -> pa.RecordBatch:
    """The rows whose id (column ``id_hash``) passes the filter, some of which need not be asked for."""
    ids = batch.column("id_hash").to_numpy(zero_copy_only=False).view(np.uint64)
    return batch.filter(pa.array(passes(ids, homes)))


def _entries(shared: Broadcast, homes: Broadcast, shingle: int, percent: int, heavy: int, wanted: Broadcast):
    """Short-prefix keys that pass a bit filter, without their lowest two bits, of the sets that may have a similar one."""
    schema = pa.schema([("key", pa.int64()), ("cls", pa.int64()), ("n", pa.int32()), ("place", pa.int32())])

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Order(*shared.value)
        seen: set[int] = set()  # classes of this task, so that its copies are indexed once
        for batch in slices(batches):
            keys, owners, sizes, places = [], [], [], []
            for tokens in shingle_sets(binary_column(_at_home(batch, homes.value), "text"), shingle):
                cls = class_key(tokens)
                if cls is None or cls in seen:
                    continue
                seen.add(cls)
                own, role, place = index_keys(tokens, order, percent, heavy)
                likely = passes(own & ~np.uint64(3), wanted.value)
                n = len(tokens)
                if np.count_nonzero(likely) < least_keys(n, percent):
                    continue
                likely &= place < n + percent * n // -100 + 2 + extra_common(n)
                own, role, place = own[likely], role[likely], place[likely]
                # the role takes the lowest two bits; keys differ in the others
                keys.append((own & ~np.uint64(3)) | role.astype(np.uint64))
                owners.append(np.full(len(own), cls, np.int64))
                sizes.append(np.full(len(own), n, np.int32))
                places.append(place.astype(np.int32))
            if keys:
                columns = (np.concatenate(keys).view(np.int64), np.concatenate(owners), np.concatenate(sizes), np.concatenate(places))
                yield to_batch(schema, [pa.array(c) for c in columns])

    return entries


def _packed_keys(shared: Broadcast, homes: Broadcast, shingle: int, percent: int, heavy: int, bucket_bits: int):
    """(bucket, keys): of the keys of all classes 31 bits and whether they are look-ups, those of a bucket in one array."""
    schema = pa.schema([("bucket", pa.int32()), ("keys", pa.binary())])
    shift = np.uint64(64 - bucket_bits - _PACKED_BITS)

    def flush(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        values, counts = np.unique(np.concatenate(found), return_counts=True)
        # whether a key has been met once or more often is all that counts, for look-ups whether at all
        twice = values[(counts > 1) & (values & np.uint64(1) == 0)]
        values = np.sort(np.concatenate((values, twice)))
        buckets = (values >> np.uint64(_PACKED_BITS + 1)).astype(np.int32)
        lo, hi = runs(buckets)
        packed = (values & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        yield to_batch(schema, [buckets[lo], [packed[a:b].tobytes() for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Order(*shared.value)
        seen: set[int] = set()
        found, held = [], 0
        for batch in slices(batches):
            for tokens in shingle_sets(binary_column(_at_home(batch, homes.value), "text"), shingle):
                cls = class_key(tokens)
                if cls is None or cls in seen:
                    continue
                seen.add(cls)
                own, role, _ = index_keys(tokens, order, percent, heavy)
                found.append((((own & ~np.uint64(3)) >> shift) << np.uint64(1)) | (role == LOOK_UP).astype(np.uint64))
                held += len(own)
            if held >= _FLUSH_KEYS:
                yield from flush(found)
                found, held = [], 0
        if found:
            yield from flush(found)

    return pack


def _met_twice(bucket: pa.Table) -> pa.Table:
    """The keys of a bucket that more than one class may have, and not as look-ups only."""
    values = np.sort(np.concatenate([np.frombuffer(k, np.uint32) for k in bucket.column("keys").to_pylist()]))
    lo, hi = runs(values >> np.uint32(1))
    useful = values[lo[(hi - lo > 1) & (values[lo] & np.uint32(1) == 0)]] >> np.uint32(1)
    return pa.table({"bucket": bucket.column("bucket")[:1].cast(pa.int32()), "n": pa.array([len(useful)], pa.int64()), "keys": pa.array([useful.tobytes()], pa.binary())})


def _wanted_keys(slim: DataFrame, level: Broadcast, homes: Broadcast, members: DataFrame, shingle: int, percent: int, heavy: int) -> bytes:
    """A bit filter of bounded size that all keys of several classes pass, by the uppermost bits of a key."""
    tokens, docs = members.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    expected = tokens * (100 - percent) // 100 + more_common(tokens) + 2 * docs
    bucket_bits = max(5, min(14, (expected // _BUCKET_KEYS).bit_length()))
    packed = slim.select("text", "id_hash").mapInArrow(_packed_keys(level, homes, shingle, percent, heavy, bucket_bits), "bucket int, keys binary")
    useful = cut_lineage(packed.groupBy("bucket").applyInArrow(_met_twice, "bucket int, n bigint, keys binary"), "keys")
    bits = filter_size(2 * useful.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], least=bucket_bits + 3)  # one stranger in 32
    # a bucket holds the keys with the same first bits, so it fills a part of the filter by itself
    parts = useful.select("bucket", "keys").mapInArrow(_filter_parts(bits - bucket_bits), "bucket int, part binary").collect()
    size = 1 << bits - bucket_bits >> 3
    out = bytearray(1 << bits >> 3)  # at most 32 MB
    for r in parts:
        out[r["bucket"] * size : (r["bucket"] + 1) * size] = r["part"]
    return bytes(out)


def _filter_parts(bits: int):
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for keys in batch.column("keys").to_pylist():
                places = (np.frombuffer(keys, np.uint32) >> np.uint32(_PACKED_BITS - bits)).astype(np.int64)
                flags = np.zeros(1 << bits, bool)
                flags[places] = True
                parts.append(np.packbits(flags).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("bucket"), pa.array(parts, pa.binary())], names=["bucket", "part"])

    return fill


@dataclass
class Index:
    """``members``: doc_id, cls, n per document. ``shared``: (key, role, cls, n, place, held) of keys that several classes have."""

    docs: DataFrame
    members: DataFrame
    shared: DataFrame
    shingle: int
    percent: int


def build_index(df: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, heavy: int = HEAVY) -> Index:
    with scratch("members", "shared"):
        return _built(df, id_col, text_col, shingle, percent, heavy)


def _built(df: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, heavy: int) -> Index:
    spark = df.sparkSession
    own_id = F.col(f"`{id_col}`").cast("long")
    slim = df.select(own_id.alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), _id_hash(own_id).alias("id_hash"))
    rows = cut_lineage(slim.select("doc_id", "text").mapInArrow(_members(shingle, COUNT_BITS), _MEMBER), "members")
    members = rows.filter("counts IS NULL").select("doc_id", "cls", "n")
    order = order_of(_sum_counts(rows.filter("counts IS NOT NULL"), COUNT_BITS), COUNT_BITS)
    level = spark.sparkContext.broadcast((order.level, order.frequent, order.bits))
    ids = cut_lineage(members.filter("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("home")).select(_id_hash(F.col("home"))), "ids")
    homes = spark.sparkContext.broadcast(bit_filter(ids, filter_size(ids.count())))

    wanted = spark.sparkContext.broadcast(_wanted_keys(slim, level, homes, members, shingle, percent, heavy))
    entries = slim.select("text", "id_hash").mapInArrow(_entries(level, homes, shingle, percent, heavy, wanted), "key bigint, cls bigint, n int, place int")
    role = F.col("key").bitwiseAND(F.lit(3)).cast("int")
    found = entries.select(F.shiftrightunsigned("key", 2).alias("key"), role.alias("role"), "cls", "n", "place")
    found = cut_lineage(found, "entries")
    # a key may be in any share of the sets: it is summed up in all tasks, and only its sums meet
    least, most, top, low = F.min("cls").alias("least"), F.max("cls").alias("most"), F.max("role").alias("top"), F.min("role").alias("low")
    sums = found.groupBy("key").agg(least, most, top, low, F.count(F.lit(1)).alias("held"))
    # keys of one class, and look-ups that no heavy set answers, find nothing
    useful = sums.filter((F.col("least") < F.col("most")) & ((F.col("low") == RARE) | (F.col("top") >= HEAVY_TOKEN)))
    useful = cut_lineage(useful.select(F.col("key").alias("of"), "held"), "keys")
    # keys grow with the corpus, so they are never broadcast; a class whose home shares its id with a copy is entered once
    shared = cut_lineage(found.join(useful.hint("merge"), F.col("key") == F.col("of")).drop("of").distinct(), "shared")
    return Index(slim, members, shared, shingle, percent)


def _id_hash(doc_id: Column) -> Column:
    return F.xxhash64(F.coalesce(doc_id, F.lit(0).cast("long")))


def token_sets(index: Index, classes: DataFrame) -> DataFrame:
    """(cls, n, tokens) of the given classes (column ``cls``), each from its document with the least id.

    Two bit filters of bounded size, of those ids and of the classes, pick the documents. What they let through besides is a
    set that is not asked for, or one more copy of a set; neither changes a result.
    """
    spark = index.docs.sparkSession
    members = index.members.filter("cls IS NOT NULL")
    homes = cut_lineage(members.join(classes, "cls", "left_semi").groupBy("cls").agg(F.min("doc_id").alias("home")), "homes")
    size = filter_size(homes.count())
    wanted = spark.sparkContext.broadcast(
        (bit_filter(homes.select(_id_hash(F.col("home"))), size), bit_filter(homes.select("cls"), size))
    )
    shingle = index.shingle
    schema = pa.schema([("cls", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary())])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [t for t in shingle_sets(binary_column(_at_home(batch, wanted.value[0]), "text"), shingle) if len(t)]
            keys = np.array([class_key(t) for t in found], np.int64)
            asked = np.flatnonzero(passes(keys.view(np.uint64), wanted.value[1])).tolist()
            yield to_batch(schema, [keys[asked], [len(found[i]) for i in asked], [found[i].tobytes() for i in asked]])

    found = index.docs.select("text", "id_hash").mapInArrow(sets, "cls bigint, n bigint, tokens binary")
    return cut_lineage(found, "sets")


def _classes(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 256):
        shared = [
            len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)
        ]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("a", "b", "na", "nb")], pa.array(shared, pa.int64())], names=["a", "b", "na", "nb", "both"])


def verified(index: Index, pairs: DataFrame) -> DataFrame:
    """Of pairs of classes (a, b) those whose sets are similar: (a, b, shared, union)."""
    with scratch("similar"):
        pairs = cut_lineage(pairs.select("a", "b"), "pairs")
        sets = token_sets(index, _classes(pairs))
        x = sets.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("x"))
        y = sets.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("y"))
        alike = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * index.percent
        both = pairs.join(x, "a").join(y, "b").filter(alike)
        counted = both.select("a", "b", "na", "nb", "x", "y").mapInArrow(_overlaps, "a bigint, b bigint, na bigint, nb bigint, both bigint")
        union = F.col("na") + F.col("nb") - F.col("both")
        similar = counted.filter(F.col("both") * 100 >= union * index.percent)
        similar = similar.select("a", "b", F.col("both").alias("shared"), union.alias("union")).distinct()
        return cut_lineage(similar, "similar")


def _meets(x: str, y: str) -> Column:
    """Two look-ups of light sets under a key of heavy sets need not meet; their pairs of tokens do."""
    return ~((F.col(x) == LOOK_UP) & (F.col(y) == LOOK_UP))


def _both(na: Column, nb: Column, percent: int) -> Column:
    """The overlap that sets of these sizes have at least if they are similar."""
    return F.ceil((na + nb) * percent / F.lit(100.0 + percent))


def _common(na: Column, nb: Column) -> Column:
    return 2 + F.least(F.lit(7), F.floor(F.least(na, nb) / F.lit(32)))


def _counted(met: DataFrame, least_keys: Column) -> DataFrame:
    """The pairs (a, na, b, nb), one row per common key, that have at least so many common keys."""
    pairs = met.groupBy("a", "na", "b", "nb").agg(F.count(F.lit(1)).alias("keys"))
    return pairs.filter(F.col("keys") >= least_keys).select("a", "b")


def _pivot_pairs(shared: DataFrame, percent: int) -> DataFrame:
    """Each class with one central class of its key, that whose keys are held by the most classes, as the origin of near copies is.

    Under a key with look-ups only heavy classes serve. A pair must meet under half the keys that similar sets have; these pairs
    only save work for the remaining ones, which miss nothing.
    """
    central = cut_lineage(shared.groupBy("cls").agg(F.sum("held").alias("weight")), "central")
    rank = F.struct((F.col("role") == LOOK_UP).alias("light"), (-F.col("weight")).alias("r"), F.struct("cls", "role", "n").alias("pivot"))
    best = shared.join(central, "cls").groupBy("key").agg(F.min(rank).alias("best")).select("key", F.col("best.pivot").alias("pivot"))
    best = cut_lineage(best, "pivots")
    alike = F.least("n", "pivot.n") * 100 >= F.greatest("n", "pivot.n") * percent
    met = shared.join(best.hint("merge"), "key").filter((F.col("cls") != F.col("pivot.cls")) & _meets("role", "pivot.role") & alike)
    own, pivot = F.struct("cls", "n"), F.struct("pivot.cls", "pivot.n")
    low, high = F.least(own, pivot), F.greatest(own, pivot)
    met = met.select(low["cls"].alias("a"), low["n"].alias("na"), high["cls"].alias("b"), high["n"].alias("nb"))
    na, nb = F.col("na"), F.col("nb")
    need = F.ceil(F.greatest(na, nb) * percent / F.lit(100.0))
    return _counted(met, (_both(na, nb, percent) - need + _common(na, nb) - 1) / 2)


def _rooted(index: Index, links: DataFrame) -> DataFrame:
    """Entries with the group of their class; only of keys whose classes are still in different groups.

    Of each class only the places are left that its pairs with any partner look at (see ``_all_pairs``).
    """
    roots = smallest_reachable(links)
    need = F.ceil(F.col("n") * index.percent / F.lit(100.0))
    shared = index.shared.filter(F.col("place") <= F.col("n") - need + (F.col("role") == PAIR).cast("int"))
    rooted = shared.join(roots, shared["cls"] == roots["node"], "left").select("key", "role", "cls", "n", "place", F.coalesce("root", "cls").alias("root"))
    rooted = cut_lineage(rooted, "rooted")
    apart = rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x != y").select(F.col("key").alias("of"))
    return rooted.join(cut_lineage(apart, "apart"), F.col("key") == F.col("of")).drop("of")


def class_links(index: Index) -> DataFrame:
    """Verified links that connect exactly the classes that all links connect."""
    with scratch("verified"):
        links = verified(index, _pivot_pairs(index.shared, index.percent)).select("a", "b")
        rest = verified(index, _all_pairs(cut_lineage(_rooted(index, links), "rooted"), F.col("x.root") != F.col("y.root"), index.percent))
        return cut_lineage(links.union(rest.select("a", "b")).distinct(), "verified")


def _all_pairs(entries: DataFrame, condition: Column, percent: int) -> DataFrame:
    """Pairs of classes that have a common key in the places where similar sets have one.

    Of sets of known sizes that are similar, at most ``n - both`` tokens of either lie before the first one they share, and one
    more before the second. So their first shared token, if it is rare or one of them is heavy, else the pair of their first
    two, is a common key in such an early place of both; later keys need not be looked at.
    """
    x, y = entries.alias("x"), entries.alias("y")
    na, nb = F.col("x.n"), F.col("y.n")
    alike = F.least(na, nb) * 100 >= F.greatest(na, nb) * percent
    both = _both(na, nb, percent)
    later = (F.col("x.role") == PAIR).cast("int")
    near = (F.col("x.place") <= na - both + later) & (F.col("y.place") <= nb - both + later)
    same = (F.col("x.key") == F.col("y.key")) & (F.col("x.cls") < F.col("y.cls"))
    met = x.join(y, same & condition & _meets("x.role", "y.role") & alike & near)
    return met.select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct()


def similar_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(members, links): doc_id, cls, n per document, and every pair of classes that is similar, with its exact overlap."""
    index = build_index(df, id_col, text_col, shingle, percent)
    return index.members, verified(index, _all_pairs(index.shared, F.lit(True), percent))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``df``: doc_id, n_shingles, cls (a key of its shingle set) and component_id.

    Two documents link when ``100 * shared >= percent * union`` of their distinct shingles. ``component_id`` is the smallest
    doc_id reachable over links, its own included. Texts that are NULL or have no words link with nothing and keep their own
    id; equal sets always link; rows that repeat an id are documents of their own. NULL ids are never the smallest unless all
    are.
    """
    with scratch("members", "grouped", "smallest"):
        index = build_index(df, id_col, text_col, shingle, percent)
        roots = smallest_reachable(class_links(index))
        classes = index.members.filter("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("least"))
        grouped = classes.join(roots, classes["cls"] == roots["node"], "left").select("cls", "least", F.coalesce("root", "cls").alias("root"))
        grouped = cut_lineage(grouped, "grouped")
        smallest = cut_lineage(grouped.groupBy("root").agg(F.min("least").alias("component_id")), "smallest")
    named = grouped.join(smallest, "root").select("cls", "component_id")
    own = index.members.join(named, "cls", "left")
    return own.select("doc_id", F.col("n").alias("n_shingles"), "cls", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that head their group, with their columns: of each group the one with the smallest id.

    Rows whose text is NULL or has no words all stay. Of rows that repeat the head's id and shingle set one stays.
    """
    with scratch("heads"):
        found = near_duplicates(docs, id_col, text_col, **options).filter("cls IS NOT NULL")
        heads = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component_id").agg(F.min("cls").alias("__cls"))
        heads = cut_lineage(heads.withColumnRenamed("component_id", "__head"), "heads")
        repeated = found.groupBy("doc_id", "cls").count().filter("count > 1").limit(1).count()
    shingle = options.get("shingle", SHINGLE)

    @F.pandas_udf("bigint")
    def cls_of(texts: pd.Series) -> pd.Series:
        keys = [class_key(t) for t in shingle_sets([x.encode("utf-8", "surrogatepass") for x in texts], shingle)]
        return pd.Series(keys, dtype="Int64")

    keyed = docs.withColumn("__own", cls_of(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))))
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("__head")) & (F.col("__own") == F.col("__cls"))
    kept = keyed.join(heads, same, "left_semi")
    if repeated:  # ids are unique as a rule; then this shuffle of texts is not needed
        kept = kept.dropDuplicates([id_col, "__own"])
    return kept.unionByName(keyed.filter("__own IS NULL")).drop("__own")
