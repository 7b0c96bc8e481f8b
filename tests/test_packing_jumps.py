"""Doubled jumps of batch packing against one step per record."""

from __future__ import annotations

import numpy as np
import pytest

from colwright.plans.batches import _chains, _next_starts, _opened_from, block_transfer


def _plain(sizes, budget, fill):
    """(fill on exit, batches opened, their first records) of greedy packing."""
    opened = []
    for i, size in enumerate(sizes.tolist()):
        if fill + size > budget:
            opened.append(i)
            fill = 0
        fill += size
    return fill, len(opened), opened


@pytest.mark.parametrize("budget", [1, 7, 40, 10_000])
@pytest.mark.parametrize("seed", range(5))
def test_transfer_and_openers_equal_plain_packing(budget, seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 30, rng.integers(1, 200))  # some exceed the budget
    transfer = block_transfer(sizes, budget)
    following = _next_starts(np.cumsum(sizes), budget)
    for fill in {1, budget // 2 + 1, budget}:
        left, opened, first = _plain(sizes, budget, fill)
        after, more = transfer.at(np.array([fill]))
        assert (int(after[0]), int(more[0])) == (left, opened)
        start = first[0] if first else len(sizes)
        assert sorted(_opened_from(following, start).tolist()) == first


def test_chains_of_a_long_block_take_few_steps():
    sizes = np.ones(1_000_000, dtype=np.int64)
    opened, last = _chains(_next_starts(np.cumsum(sizes), 2))
    assert opened[0] == 500_000 and last[0] == 999_998 and last[-1] == 999_999
    assert len(_opened_from(_next_starts(np.cumsum(sizes), 2), 0)) == 500_000
