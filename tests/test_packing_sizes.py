"""Batch packing of records of size 0 and of unknown size."""

from __future__ import annotations

import numpy as np
import pytest

from colwright.plans import batches


def _as_sql(sizes, budget):
    """Batches by the rule of the SQL: fills are added up record by record, and NULL (None) is neither below nor above the budget."""
    out, fill, batch = [], None, 0
    for i, size in enumerate(sizes):
        total = size if i == 0 else None if fill is None or size is None else fill + size
        if i and total is not None and total > budget:
            total, batch = size, batch + 1
        fill = total
        out.append(batch)
    return out


def _odd(rng, budget, length, unknown):
    sizes = rng.integers(1, budget, length)
    sizes[rng.random(length) < 0.3] = 0
    sizes[rng.random(length) < 0.1] = budget + 5
    return [None if rng.random() < unknown else int(s) for s in sizes]


@pytest.mark.parametrize("unknown", [0, 0.02])
def test_chained_transfers_take_empty_and_unknown_records(unknown):
    rng = np.random.default_rng(3)
    for _ in range(300):
        budget = int(rng.integers(2, 40))
        parts = [np.array([-1 if s is None else s for s in _odd(rng, budget, int(rng.integers(1, 9)), unknown)]) for _ in range(4)]
        chained = batches.block_transfer(parts[0], budget)
        for part in parts[1:]:
            chained = chained.then(batches.block_transfer(part, budget))
        assert (np.diff(chained.low) > 0).all()
        for entry in range(budget + 4):
            fill, started = entry, 0
            for size in np.concatenate(parts):
                if fill is not None:
                    if size >= 0 and fill + size > budget:
                        fill, started = 0, started + 1
                    fill = None if size < 0 else fill + int(size)
            got, more = chained.at(np.array([entry]))
            assert (None if got[0] < 0 else got[0], more[0]) == (fill, started)


@pytest.mark.parametrize("block_rows", [1, 7, 1000])
def test_batches_of_empty_and_unknown_records(spark, block_rows):
    rng = np.random.default_rng(block_rows)
    runs = {"zeros": _odd(rng, 50, 200, 0), "nulls": _odd(rng, 50, 200, 0.02), "begins": [None, 60, 60], "over": [60, None, 0, 60]}
    runs |= {"empty": [0, 0, 0], "full": [50, 0, 0, 1, 0], "over_empty": [60, 0, 0, 50]}
    rows = [(run, i, s) for run, sizes in runs.items() for i, s in enumerate(sizes)]
    df = spark.createDataFrame(rows, "run string, i long, size long").repartition(3)
    got = batches.pack_batches(df, ["run"], ["i"], "size", 50, block_rows=block_rows, fan=4).toPandas()
    for run, sizes in runs.items():
        part = got[got.run == run].sort_values("i")
        assert part["batch_id"].tolist() == _as_sql(sizes, 50), run


def test_registered_packing_takes_documents_without_size(spark, tmp_path):
    """The registered queries against their rule, on documents some of which are empty or have no size."""
    from colwright.catalog import all_queries

    sizes = [30_000, 0, 10_000, 1, 50_000, 0, 39_999, None, 40_000, 40_000]
    rows = [(i, f"src{i % 2}", s) for i, s in enumerate(sizes)]
    spark.createDataFrame(rows, "doc_id long, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    one = all_queries()["pack_batches_one_run"](spark, str(tmp_path)).toPandas().sort_values("doc_id")
    assert one["batch_id"].tolist() == _as_sql(sizes, 40_000)
    runs = all_queries()["pack_batches"](spark, str(tmp_path)).toPandas().sort_values("doc_id")
    for k in (0, 1):
        assert runs["batch_id"].tolist()[k::2] == _as_sql(sizes[k::2], 40_000)


def test_negative_sizes_stop_the_job(spark):
    df = spark.createDataFrame([(0, 5), (1, -5)], "i long, size long")
    with pytest.raises(Exception, match="must not be negative"):
        batches.pack_batches(df, [], ["i"], "size", 10).collect()
