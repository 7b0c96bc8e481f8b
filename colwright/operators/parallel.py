"""Jobs that the driver submits side by side."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target


def side_by_side(spark, work: Callable, items: Sequence, parallel: int) -> list:
    """``work`` on each item, ``parallel`` jobs at a time; results in the order of the items."""
    with ThreadPoolExecutor(max(1, min(len(items), parallel))) as pool:
        return list(pool.map(inheritable_thread_target(spark)(work), items))
