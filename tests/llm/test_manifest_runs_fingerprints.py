"""Merkle manifest, periodic runs and fingerprint groups against plain versions."""

from __future__ import annotations

import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute
from test_corpus_operators import CLASH, SCHEMA, corpus, words

from colwright.llm import manifest, periodic, queries, simhash

ROWS = corpus()


def repeats():
    """Texts with runs of many kinds: at both ends, nested, next to each other, sharing words, and nearly periodic."""
    rng = random.Random(11)
    out = ["a a a a a", "a a a a a a", "a b a b a b a", "a b a b a b a b", "x " + "p q r " * 9 + "p y", ("a a a a a a b " * 5).strip()]
    out += [" ".join(["u v w"] * 4 + ["v w u"] * 4), "z z " * 8, "a\nb\ta\x0bb\x0ca b a b\r\na b", "A a A a a A a A"]
    for _ in range(40):
        part = [rng.choice("abc") for _ in range(rng.randrange(1, 9))]
        text = [rng.choice("abcd") for _ in range(rng.randrange(0, 20))] + part * rng.randrange(2, 8) + part[: rng.randrange(len(part))]
        text += [rng.choice("abcd") for _ in range(rng.randrange(0, 20))]
        out.append(" ".join(text))
    out.append(" ".join([f"t{i}" for i in range(700)] * 6 + ["end"]))
    return [(1000 + i, t, "en", "s3", len(t)) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS + repeats(), SCHEMA).repartition(3).withColumns({k: F.lit(v) for k, v in CLASH.items()}).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def tables(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{path}/documents.parquet")
    return path


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def ordered(found):
    return sorted(found, key=repr)


# --- manifest


def test_manifest_equals_plain(spark, tables):
    found = queries.all_queries()["op12_manifest"](spark, tables)
    want = brute.manifest([(i, s, lang, n, t) for i, t, lang, s, n in ROWS + repeats()])
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert rows(found) == ordered(want)


@pytest.mark.parametrize("sizes", [[1], [1, 1], [3, 1, 2], [4, 9, 10, 27, 28], [81, 82, 80], [243, 244, 1], [700]])
def test_manifest_of_every_height(spark, sizes):
    data = [(1000 * g + i, f"text {i}\n", "en", f"s{g}", i) for g, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(data, SCHEMA)
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    found = manifest.document_manifest(df, F.when(even, F.replace("text", F.lit("\n"), F.lit(""))))
    assert rows(found) == ordered(brute.manifest([(i, s, lang, n, t) for i, t, lang, s, n in data]))


@pytest.mark.parametrize("arity, stride", [(3, 1), (3, 2), (3, 7)])
def test_levels_between_checkpoints_do_not_change_proofs(spark, docs, arity, stride):
    def folded(**options):
        made = manifest.manifest(docs, "source", "doc_id", manifest.leaf_digest(F.col("doc_id"), F.col("text")), **options)
        return rows(made.select("leaf", "subroot", "root", "way"))

    assert folded(arity=arity, stride=stride) == folded()


def test_manifest_detects_any_change(docs):
    untouched = manifest.document_manifest(docs)
    assert untouched.filter(~F.col("verified")).isEmpty()
    changed = manifest.document_manifest(docs, F.concat("text", F.lit(" ")))
    assert changed.filter("verified").join(docs.filter("text IS NULL"), "doc_id", "left_anti").isEmpty()


def test_manifest_of_nothing(empty):
    assert manifest.document_manifest(empty).isEmpty()


# --- runs


def test_runs_equal_plain(spark, tables):
    found = queries.all_queries()["op13_periodic_runs"](spark, tables)
    assert rows(found) == ordered([brute.run_row(i, t) for i, t, *_ in ROWS + repeats()])
    tails = [i for i, *_ in ROWS + repeats() if i is not None and zlib.crc32(str(i).encode()) % 10 == 0]
    assert len(tails) > 5 and found.filter("n_runs > 0").count() > 30


def test_runs_of_random_words_equal_plain():
    rng = np.random.default_rng(3)
    for trial in range(150):
        texts = []
        for _ in range(4):
            pattern = rng.integers(0, 3, rng.integers(1, 7))
            texts.append(np.concatenate([rng.integers(0, 3, rng.integers(0, 12)), np.tile(pattern, rng.integers(1, 9)), rng.integers(0, 3, rng.integers(0, 12))]))
        first = np.cumsum([0] + [len(t) for t in texts])
        found = periodic.find_runs(np.concatenate(texts), first)
        want = [(int(a) + s, int(a) + s + n, q) for a, t in zip(first, texts) for s, n, q in brute.runs(t.tolist())]
        assert found == sorted(want), trial


def test_runs_do_not_cross_documents():
    assert periodic.find_runs(np.zeros(10, np.int64), np.array([0, 5, 10])) == []
    assert periodic.find_runs(np.zeros(12, np.int64), np.array([0, 6, 12])) == [(0, 6, 1), (6, 12, 1)]


def test_runs_of_a_long_text():
    rng = np.random.default_rng(7)
    part = rng.integers(0, 1000, 20_000)
    ids = np.concatenate([np.tile(part, 5), np.zeros(50_000, np.int64)])
    found = periodic.find_runs(ids, np.array([0, len(ids)]))
    assert (0, 100_000, 20_000) in found and any(p == 1 and e == 150_000 for _, e, p in found)


def test_collapsed_text_and_nothing(docs, empty):
    made = {r.doc_id: r for r in periodic.periodic_runs(docs).filter("doc_id >= 1000").collect()}
    assert made[1001].collapsed == "a" and made[1003].collapsed == "a b" and made[1000].collapsed == "a a a a a"
    assert periodic.run_digests(periodic.periodic_runs(empty)).isEmpty()
    with pytest.raises(ValueError):
        periodic.find_runs(np.zeros(3, np.int64), np.array([0, 3]), periods=3)


# --- fingerprints


def test_fingerprint_groups_equal_plain(spark, tables):
    found = queries.all_queries()["op11_simhash"](spark, tables)
    codes = [(i, brute.fingerprint(t)) for i, t, *_ in ROWS + repeats()]
    want = [(i, f"{c:016x}", root) for (i, c), (_, root) in zip(codes, brute.fingerprint_groups(codes))]
    assert rows(found) == ordered(want)


def test_hash_is_that_of_the_engine(spark):
    texts = ["one two three four", "É ß x y", "solo"]
    want = [r[0] & (2**64 - 1) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t")).collect()]
    assert [int(simhash.shingle_hashes(t.encode())[0]) for t in texts][::2] == want[::2]
    assert int(simhash.shingle_hashes("É ß x y".encode())[0]) == want[1]


def clustered(seed, centres, near, most):
    """Random codes, and others a few bits from some of them."""
    rng = random.Random(seed)
    codes = {rng.getrandbits(64) for _ in range(centres)}
    for c in sorted(codes)[: centres // 4]:
        for _ in range(near):
            codes.add(c ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(most + 1))}))
    return sorted(codes | {0, 1, 3, 2**63, 2**64 - 1})


@pytest.mark.parametrize("radius", [0, 1, 4])
def test_index_links_equal_all_pairs(radius):
    codes = np.array(clustered(2, 120, 12, 6), np.uint64)
    rank = codes.copy()
    for k in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(k)
    codes = codes[np.argsort(rank)]
    for group in (np.zeros(len(codes), np.int64), np.arange(len(codes)) // 50):
        label = simhash.linked(group, codes, radius)
        want = np.arange(len(codes))
        near = (np.bitwise_count(codes[:, None] ^ codes[None, :]) <= radius) & (group[:, None] == group[None, :])
        while True:
            least = np.where(near, want[None, :], len(codes)).min(axis=1)
            if np.array_equal(least, want):
                break
            want = least
        assert np.array_equal(label, want)


@pytest.mark.parametrize("node, blocks", [(8192, None), (16, None), (40, 6), (16, 8)])
def test_full_nodes_are_split_without_loss(spark, node, blocks):
    codes = clustered(9, 60, 60, 5)
    df = spark.createDataFrame([(c - 2**64 if c >= 2**63 else c,) for c in codes], "code bigint")
    links = [(r.a, r.b) for r in simhash.connecting_links(df, node=node, blocks=blocks).collect()]
    root = {c: c for c in codes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = a & (2**64 - 1), b & (2**64 - 1)
        root[find(a)] = find(b)
    mine: dict = {}
    for c in codes:
        mine.setdefault(find(c), set()).add(c)
    want: dict = {}
    for c, r in brute.fingerprint_groups([(c, c) for c in codes]):
        want.setdefault(r, set()).add(c)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_blocks_fix_enough_bits():
    assert simhash.block_count(1000) == 5
    assert all(simhash.block_count(10**e) <= simhash.block_count(10 ** (e + 1)) for e in range(3, 14))
    masks = simhash.finer_masks(0, 6, 4)
    assert len(masks) == 15 and all(20 <= m.bit_count() <= 22 for m in masks)
    assert simhash.finer_masks(2**60 - 1, 6, 4) == (2**60 - 1,)


def test_no_documents(empty):
    assert simhash.near_duplicates(empty).isEmpty()
