"""What the n-gram join writes: only sets that may have a similar one are indexed, and no table outlives its use."""

from __future__ import annotations

import os
import random
import zlib

import brute
import numpy as np

from colwright.llm import jaccard
from colwright.llm.common import bit_filter
from colwright.storage import shared_dir

SCHEMA = "doc_id bigint, text string"


def _texts(n: int) -> list[str]:
    """Texts of 80 words that share six words, two shingles, with the next one and nothing with others."""
    rng = random.Random(7)
    lines = [" ".join(f"s{i}x{j}" for j in range(6)) for i in range(n + 1)]
    return [" ".join([lines[i], *[f"w{rng.randrange(10**9)}" for _ in range(68)], lines[i + 1]]) for i in range(n)]


def test_copies_and_strangers_are_not_indexed(spark, monkeypatch):
    rows = [(1000 * c + i, t) for c in range(3) for i, t in enumerate(_texts(50))]
    counts, write = {}, jaccard.cut_lineage

    def written(df, label):
        counts[label] = (out := write(df, label)).count()
        return out

    monkeypatch.setattr(jaccard, "cut_lineage", written)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    index = jaccard.build_index(df, "doc_id", "text", 5, 75)
    assert index.members.count() == 150 and counts["entries"] == 0 == counts["shared"]


def test_a_set_that_just_has_a_similar_one_is_indexed():
    for n in range(3, 400):
        for m in range(n, n * 100 // 75 + 1):
            both = max(-(-75 * (n + m) // 175), -(-75 * m // 100))
            need = [-(-75 * x // 100) for x in (n, m)]
            met = min(both, *(both - k + 2 + jaccard.more_common(x) for x, k in zip((n, m), need, strict=True)))
            # of the tokens met in both prefixes one may be lost where frequent ones are paired
            assert met - 1 >= max(jaccard.least_keys(n, 75), jaccard.least_keys(m, 75))


def test_only_tables_that_the_result_reads_stay(spark):
    folder = shared_dir(spark).removeprefix("file:")
    texts = _texts(12)
    rows = [(i, t) for i, t in enumerate([*texts, *texts[:3], *[t.replace("s", "q", 1) for t in texts]])]
    df = spark.createDataFrame(rows, SCHEMA)
    before = set(os.listdir(folder))
    out = jaccard.near_duplicates(df)
    labels = {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before}
    assert labels == {"members", "grouped", "smallest"}
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out.collect())
    assert got == sorted(brute.components(rows))
    before = set(os.listdir(folder))
    assert jaccard.one_per_group(df).count() == len({c for _, _, c in got})
    assert {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before} == {"heads"}


def test_filters_and_counts_start_no_second_kind_of_python_worker(spark, monkeypatch):
    """RDD code runs in workers of its own beside those of data frames, so each executor would hold both."""
    rng = np.random.default_rng(3)
    keys = rng.integers(-(2**63), 2**63 - 1, 500)
    df = spark.createDataFrame([(int(k),) for k in keys], "k bigint").repartition(3)
    parts = spark.createDataFrame([(p, zlib.compress(np.full((1 << 10) // 64, p + t, np.uint32).tobytes())) for p in range(64) for t in (1, 5)], "n bigint, counts binary")

    def refused(self):
        raise AssertionError("an RDD of a data frame")

    monkeypatch.setattr(type(df), "rdd", property(refused))
    for bits in (8, 15, 18):
        want = np.zeros(1 << bits, bool)
        want[(keys.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)] = True
        assert bit_filter(df, bits) == np.packbits(want).tobytes()
    assert jaccard._sum_counts(parts, 10).tolist() == np.repeat(np.arange(64) * 2 + 6, 16).tolist()
    assert not any(bit_filter(df.limit(0), 16)) and not jaccard._sum_counts(parts.limit(0), 10).any()
