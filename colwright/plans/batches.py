"""Packing of records into batches under a size budget, in order.

A batch is closed when the next record would push it over the budget; a record larger than the budget has a batch to
itself. Where a batch starts depends on all records before it. What a block of records does to an open batch, though,
depends on how full that batch is and on nothing else: a *transfer* maps the fill on entry to the fill on exit and
the number of batches started. Transfers are step functions of at most ``budget + 3`` pieces, and two in a row make
one. So blocks are summarised side by side, the transfers of neighbouring blocks are merged level by level until one
group is left per run, and the fills are handed back down. No task sees more than one block, or ``FAN`` transfers.

A record of size 0 takes no room. From a record of unknown size on the fill is unknown too, so that nothing can push it over
the budget: no further batch of the run is opened, as where fills are added up in SQL.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from colwright.operators.lookup import null_safe_join
from colwright.operators.ordered import BLOCK, BLOCK_ROWS, POS, lay_out
from colwright.storage import cut_lineage

#: Transfers that one task merges.
FAN = 64
#: Stands for an unknown fill: so little that no records fill it up.
UNKNOWN = -(1 << 62)


@dataclass
class Transfer:
    """Piece i holds for fills from ``low[i]`` up to the next piece: exit fill and batches started.

    Where ``grows[i]`` is set, no batch starts and ``fill[i]`` is added to the entry fill. The first piece begins at ``UNKNOWN``;
    only that one may grow.
    """

    low: np.ndarray
    fill: np.ndarray
    started: np.ndarray
    grows: np.ndarray

    def at(self, fills: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.low, fills, side="right") - 1
        return np.where(self.grows[i], fills + self.fill[i], self.fill[i]), self.started[i]

    def then(self, later: "Transfer") -> "Transfer":
        fixed = ~self.grows
        fill, more = later.at(self.fill[fixed])
        low, started = self.low[fixed], self.started[fixed] + more
        grows = np.zeros(len(low), dtype=bool)
        if self.grows.any():
            # fills that only grow here meet the later steps earlier by the amount they grew
            grown = self.fill[0]
            upper = self.low[1] if len(self.low) > 1 else np.iinfo(np.int64).max
            moved = np.append(UNKNOWN, np.maximum(later.low[1:] - grown, 0))
            keep = (moved < upper) & np.append(moved[:-1] < moved[1:], True)  # of steps met by a fill of 0, the last
            both = later.grows[keep]
            low = np.concatenate([moved[keep], low])
            fill = np.concatenate([later.fill[keep] + np.where(both, grown, 0), fill])
            started = np.concatenate([later.started[keep], started])
            grows = np.concatenate([both, grows])
        return Transfer(low, fill, started, grows)

    def frame(self) -> pd.DataFrame:
        return pd.DataFrame({"low": self.low, "fill": self.fill, "started": self.started, "grows": self.grows})


def _read(pdf: pd.DataFrame) -> Transfer:
    pdf = pdf.sort_values("low")
    return Transfer(*[pdf[c].to_numpy() for c in ("low", "fill", "started", "grows")])


def _next_starts(upto: np.ndarray, budget: int) -> np.ndarray:
    """For a batch opened at each record, the record that opens the next one (the length if none does)."""
    before = np.concatenate([[0], upto[:-1]])
    following = np.searchsorted(upto, before + budget, side="right")
    return np.maximum(following, np.arange(1, len(upto) + 1))


def _chains(following: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From each record along ``following`` to the end: how many batches are opened, and the record that opens the last.

    Jumps are doubled until all of them reach the end, so the steps grow with the logarithm of the batches.
    """
    length = len(following)
    jump = np.append(following, length)
    opened = np.append(np.ones(length, dtype=np.int64), 0)
    last = np.arange(length + 1)
    while (jump < length).any():
        last = np.where(jump < length, last[jump], last)
        opened, jump = opened + opened[jump], jump[jump]
    return opened[:length], last[:length]


def _opened_from(following: np.ndarray, start: int) -> np.ndarray:
    """The records that open a batch, from ``start`` along ``following``, found by doubled jumps."""
    length = len(following)
    if start >= length:
        return np.empty(0, dtype=np.int64)
    jumps = [np.append(following, length)]
    while jumps[-1][start] < length:
        jumps.append(jumps[-1][jumps[-1]])
    found = np.array([start], dtype=np.int64)
    for jump in reversed(jumps):
        further = jump[found]
        found = np.concatenate([found, further[further < length]])
    return found


def _known(sizes: np.ndarray) -> np.ndarray:
    """The sizes before the first unknown one, which is negative."""
    unknown = np.flatnonzero(sizes < 0)
    return sizes[: unknown[0]] if len(unknown) else sizes


def block_transfer(sizes: np.ndarray, budget: int) -> Transfer:
    """The transfer of a block of records; a negative size is an unknown one."""
    known = _known(sizes)
    upto = np.cumsum(known)
    started, last = _chains(_next_starts(upto, budget))
    # record i opens the first batch for fills above budget - upto[i]; records of size 0 open none after another
    openers = int(np.searchsorted(upto, budget, side="right")) + 1
    first = np.unique(upto[:openers], return_index=True)[1][::-1]
    low = np.maximum(budget - upto[first] + 1, 0)
    whole = len(known) == len(sizes)
    fill = (upto[-1] - upto[last] + known[last])[first] if whole else np.full(len(first), UNKNOWN)
    return Transfer(
        np.append(UNKNOWN, low),
        np.append(upto[-1] if whole else UNKNOWN, fill),
        np.append(0, started[first]),
        np.append(whole, np.zeros(len(first), dtype=bool)),
    )


def pack_batches(
    records: DataFrame,
    run: Sequence[str],
    order_by: Sequence[str],
    size: str,
    budget: int,
    out: str = "batch_id",
    block_rows: int = BLOCK_ROWS,
    fan: int = FAN,
) -> DataFrame:
    """Adds the 0-based batch number within the run. Sizes may be 0 or NULL, but not negative."""
    keys, held = list(run), F.col(size)
    negative = F.raise_error(F.lit("record sizes must not be negative")).cast("long")
    sized = records.withColumn("__size", F.when(held.isNull(), -1).when(held >= 0, held.cast("long")).otherwise(negative))
    layout = lay_out(sized, keys, order_by, block_rows)
    slim = layout.table.select(*keys, BLOCK, POS, "__size")
    key_ddl = "".join(f"`{k}` {slim.schema[k].dataType.simpleString()}, " for k in keys)
    transfer_ddl = f"{key_ddl}{BLOCK} long, low long, fill long, started long, grows boolean"
    entry_ddl = f"{key_ddl}{BLOCK} long, fill long, started long"

    def labelled(table: pd.DataFrame, like: pd.DataFrame, block: int) -> pd.DataFrame:
        return table.assign(**{k: [like[k].iloc[0]] * len(table) for k in keys}, **{BLOCK: block})

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf.sort_values(POS)["__size"].to_numpy()
        return labelled(block_transfer(sizes, budget).frame(), pdf, pdf[BLOCK].iloc[0])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        merged = None
        for _, part in pdf.groupby(BLOCK, sort=True):
            merged = _read(part) if merged is None else merged.then(_read(part))
        return labelled(merged.frame(), pdf, pdf[BLOCK].iloc[0] // fan)

    def hand_down(pdf: pd.DataFrame) -> pd.DataFrame:
        fill, started = int(pdf["__fill"].iloc[0]), int(pdf["__started"].iloc[0])
        rows = []
        for block, part in pdf.groupby(BLOCK, sort=True):
            rows.append((block, fill, started))
            after, more = _read(part).at(np.array([fill]))
            fill, started = int(after[0]), started + int(more[0])
        table = pd.DataFrame(rows, columns=[BLOCK, "fill", "started"])
        return table.assign(**{k: [pdf[k].iloc[0]] * len(table) for k in keys})

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(POS)
        upto = np.cumsum(_known(pdf["__size"].to_numpy()))
        opens = np.zeros(len(pdf), dtype=np.int64)
        first = int(np.searchsorted(upto, budget - int(pdf["__fill"].iloc[0]), side="right"))
        opens[_opened_from(_next_starts(upto, budget), first)] = 1
        batch = np.maximum(int(pdf["__started"].iloc[0]) - 1 + np.cumsum(opens), 0)  # a run of unknown fill is batch 0
        return pd.DataFrame({POS: pdf[POS].to_numpy(), "__batch": batch})

    levels = [cut_lineage(slim.groupBy(*keys, BLOCK).applyInPandas(summarise, transfer_ddl), "transfers")]
    blocks = (slim.agg(F.max(BLOCK)).first()[0] or 0) + 1
    while blocks > fan:
        above = F.floor(F.col(BLOCK) / fan).alias("__above")
        merged = levels[-1].groupBy(*keys, above).applyInPandas(merge, transfer_ddl)
        levels.append(cut_lineage(merged, "transfers"))
        blocks = -(-blocks // fan)

    # a run begins with an overfull batch of number -1, so that its first record opens batch 0; so does one of unknown size
    begin = {"__fill": F.lit(budget + 1).cast("long"), "__started": F.lit(0).cast("long")}
    entries = levels[-1].withColumns(begin).groupBy(*keys).applyInPandas(hand_down, entry_ddl)
    for level in reversed(levels[:-1]):
        parents = entries.withColumnsRenamed({BLOCK: "__above", "fill": "__fill", "started": "__started"})
        children = level.withColumn("__above", F.floor(F.col(BLOCK) / fan))
        entered = null_safe_join(children, cut_lineage(parents, "entries"), ["__above", *keys])
        entries = entered.groupBy(*keys, "__above").applyInPandas(hand_down, entry_ddl)
    fills = cut_lineage(entries.withColumnsRenamed({"fill": "__fill", "started": "__started"}), "entries")
    numbered = null_safe_join(slim, fills, [BLOCK, *keys]).groupBy(*keys, BLOCK).applyInPandas(
        number, f"{POS} long, __batch long"
    )
    result = layout.table.join(numbered, [POS])
    return result.withColumn(out, F.col("__batch")).drop("__batch", "__size", POS, BLOCK)
