"""Declarative features.

A ``FeatureSpec`` names an operator, its inputs (columns or other specs) and its parameters. ``with_features`` adds
any number of specs to a table. Equal specs are computed once, and specs that depend on each other are added in turns:
all row-wise columns of a turn in one projection, all series columns in one windowed projection, the statistics of all
groups in one aggregate. A group operator takes one or more keys and, last, the column it summarises.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from colwright.functions import dates, numeric as num, text
from colwright.operators import groups, ordered, quantiles, rolling
from colwright.operators.ordered import BLOCK, BLOCK_ROWS, KEY_ROWS, POS

#: Columns that one projection adds at most; wider batches are split.
BATCH = 200


@dataclass(frozen=True)
class FeatureSpec:
    op: str
    inputs: tuple["FeatureSpec | str", ...]
    params: tuple[tuple[str, object], ...] = ()
    name: str | None = field(default=None, compare=False)

    @property
    def key(self) -> str:
        """Canonical text: equal for specs that compute the same."""
        inner = [i.key if isinstance(i, FeatureSpec) else i for i in self.inputs]
        inner += [f"{k}={v}" for k, v in sorted(self.params)]
        return f"{self.op}({', '.join(inner)})"

    @property
    def label(self) -> str:
        return self.name or self.key

    def param(self, name: str, default=None):
        return dict(self.params).get(name, default)

    @property
    def family(self) -> str:
        for family, ops in FAMILIES.items():
            if self.op in ops:
                return family
        raise ValueError(f"unknown operator {self.op}")


def spec(op: str, *inputs: "FeatureSpec | str", name: str | None = None, **params) -> FeatureSpec:
    made = FeatureSpec(op, tuple(inputs), tuple(sorted(params.items())), name)
    made.family  # an unknown operator is refused here
    if made.family == "group" and len(inputs) < 2:
        raise ValueError(f"{op} needs one or more keys and then its input")
    if made.family == "series" and params.get("n", 1) <= 0:
        raise ValueError(f"{op} must look at past rows: n is {params['n']}")
    return made


Scalar = Callable[..., Column]

SCALAR: dict[str, Scalar] = {
    "absolute": num.absolute,
    "log_safe": num.log_safe,
    "log": num.log_plain,
    "sqrt": num.sqrt_abs,
    "signed_sqrt": num.sqrt_signed,
    "sigmoid": num.sigmoid,
    "square": num.square,
    "power": lambda x, exponent: num.power(x, exponent),
    "round": lambda x, digits=2: num.round_half_even(x, digits),
    "minimum": num.minimum,
    "maximum": num.maximum,
    "add": num.row_sum,
    "subtract": num.subtract,
    "absolute_difference": num.absolute_difference,
    "multiply": lambda *xs, scale=1.0: num.product(*xs, scale=scale),
    "mean": num.row_mean,
    "ratio": num.ratio,
    "ratio_guarded": num.ratio_guarded,
    "clip": lambda x, low, high: num.clip(x, low, high),
    "above": lambda x, threshold: num.flag(x > F.lit(threshold)),
    "scale_range": lambda x, low, high: num.scale_range(x, low, high),
    "linear": lambda x, factor=1.0, shift=0.0: num.finite(x.cast("double") * F.lit(factor) + F.lit(shift)),
    "combine": text.combine,
    "recode": lambda x, mapping, default: text.recode(x, dict(mapping), default),
    "day_of_week": dates.day_of_week,
    "month": dates.month,
    "quarter": dates.quarter,
    "year": dates.year,
    "days_since": lambda d, event: dates.days_since(d, event),
    "cyclic_sin": lambda x, period: dates.cyclic_sin(x, period),
    "cyclic_cos": lambda x, period: dates.cyclic_cos(x, period),
    "magnitude": dates.parse_magnitude,
}

#: Series operators: the formula over frames, and how many rows back it reads.
SERIES: dict[str, tuple[Callable[..., Column], Callable[[FeatureSpec], int]]] = {
    "lag": (rolling.lag, lambda s: s.param("n")),
    "delta": (rolling.delta, lambda s: s.param("n")),
    "rolling_mean": (rolling.rolling_mean, lambda s: s.param("n") - 1),
    "rolling_std": (rolling.rolling_std, lambda s: s.param("n") - 1),
    "rolling_min": (rolling.rolling_min, lambda s: s.param("n") - 1),
    "rolling_max": (rolling.rolling_max, lambda s: s.param("n") - 1),
    "rolling_zscore": (rolling.rolling_zscore, lambda s: s.param("n") - 1),
    "rolling_rank": (rolling.rolling_rank, lambda s: s.param("n") - 1),
    "rolling_correlation": (rolling.rolling_correlation, lambda s: s.param("n") - 1),
    "ratio_to_mean": (rolling.ratio_to_mean, lambda s: s.param("n") - 1),
    "distance_from_mean": (rolling.distance_from_mean, lambda s: s.param("n") - 1),
    "log_return": (rolling.log_return, lambda s: s.param("n")),
    "band_width": (rolling.band_width, lambda s: s.param("n") - 1),
    "true_range": (rolling.true_range, lambda s: 1),
    "gain": (rolling.gain, lambda s: 1),
    "loss": (rolling.loss, lambda s: 1),
    "strength_index": (rolling.strength_index, lambda s: s.param("n") - 1),
    "range_position": (rolling.range_position, lambda s: s.param("n") - 1),
    "breakout_up": (rolling.breakout_up, lambda s: s.param("n")),
    "breakout_down": (rolling.breakout_down, lambda s: s.param("n")),
    "change_of_known": (rolling.rate_of_change, lambda s: s.param("n")),
    "confirmed_change": (rolling.volume_confirmation, lambda s: max(1, s.param("n") - 1)),
}

GROUP = {f"group_{s}": s for s in groups.STATISTICS}
TABLE = ("frequency", "value_count", "residual", "group_rank", "quantile_bin", "range_scaled")

FAMILIES = {
    "scalar": SCALAR,
    "series": SERIES,
    "fill": ("known",),
    "exponential": ("exponential_part",),
    "group": GROUP,
    "table": TABLE,
}


# Specs that stand for several steps -----------------------------------------------------------------------------


def rate_of_change(x, n: int, name: str | None = None) -> FeatureSpec:
    return spec("change_of_known", spec("known", x), n=n, name=name)


def volume_confirmation(price, volume, n: int, name: str | None = None) -> FeatureSpec:
    return spec("confirmed_change", spec("known", price), volume, n=n, name=name)


def exponential_mean(x, span: int, name: str | None = None) -> FeatureSpec:
    return spec("known", spec("exponential_part", x, span=span), name=name)


def strength_index(x, n: int, name: str | None = None) -> FeatureSpec:
    return spec("strength_index", spec("gain", x), spec("loss", x), n=n, name=name)


def average_true_range(high, low, close, n: int, name: str | None = None) -> FeatureSpec:
    return spec("rolling_mean", spec("true_range", high, low, close), n=n, name=name)


def group_deviation(x, by: str, name: str | None = None) -> FeatureSpec:
    return spec("subtract", x, spec("group_mean", by, x), name=name)


def combined_frequency(a, b, name: str | None = None) -> FeatureSpec:
    return spec("frequency", spec("combine", a, b), name=name)


# Evaluation -----------------------------------------------------------------------------------------------------


def _ordered(specs: Sequence[FeatureSpec]) -> dict[str, FeatureSpec]:
    """All specs and their inputs by key, inputs first."""
    found: dict[str, FeatureSpec] = {}

    def visit(s: FeatureSpec) -> None:
        for i in s.inputs:
            if isinstance(i, FeatureSpec):
                visit(i)
        found.setdefault(s.key, s)

    for s in specs:
        visit(s)
    return found


def _turns(found: dict[str, FeatureSpec], made: Iterable[str] = ()) -> list[tuple[str, list[FeatureSpec]]]:
    """Groups of specs of one family whose inputs are all ready; those of the keys ``made`` are from the start."""
    ready = set(made)
    waiting = dict(found)
    turns = []
    while waiting:
        free = [
            s for s in waiting.values() if all(not isinstance(i, FeatureSpec) or i.key in ready for i in s.inputs)
        ]
        # row-wise columns cost nothing extra, so they go first and unblock the most
        family = next(f for f in FAMILIES if any(s.family == f for s in free))
        batch = [s for s in free if s.family == family][:BATCH]
        turns.append((family, batch))
        for s in batch:
            ready.add(s.key)
            del waiting[s.key]
    return turns


def row_inputs(specs: Sequence[FeatureSpec]) -> list[str] | None:
    """The columns that specs read, where rows equal in them have equal features and no statistic is learned from another; else None."""
    found = list(_ordered(specs).values())
    if any(s.family not in ("scalar", "group", "table") for s in found):
        return None
    if any(i.family != "scalar" for s in found for i in _ordered(_specs_below(s)).values() if s.family != "scalar"):
        return None
    return sorted({i for s in found for i in s.inputs if isinstance(i, str)})


def _specs_below(s: FeatureSpec) -> list[FeatureSpec]:
    return [i for i in s.inputs if isinstance(i, FeatureSpec)]


def _column(i: "FeatureSpec | str", names: dict[str, str]) -> str:
    return names[i.key] if isinstance(i, FeatureSpec) else i


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def with_features(
    df: DataFrame,
    specs: Sequence[FeatureSpec],
    partition_by: Sequence[str] = (),
    order_by: Sequence[str] = (),
    fit_on: Column | None = None,
    key_rows: int = KEY_ROWS,
    block_rows: int = BLOCK_ROWS,
    learned: DataFrame | None = None,
) -> DataFrame:
    """``df`` with one column per spec, named by its label.

    Series operators run along ``order_by`` (a total order) within ``partition_by``. If the fullest key has more than
    ``key_rows`` rows, the table is cut into blocks of ``block_rows`` instead of one task per key. Group and table
    statistics are learned from the rows where ``fit_on`` holds. Where ``row_inputs`` names the columns that the specs read, ``df``
    may hold one row for equal ones, with all rows in ``learned``.
    """
    if learned is not None and row_inputs(specs) is None:
        raise ValueError("these specs need all rows in one table")
    found = _ordered(specs)
    names = {key: f"__f{i}" for i, key in enumerate(found)}
    serial = [s for s in found.values() if s.family in ("series", "fill", "exponential")]
    layout = None
    if serial:
        if not order_by:
            raise ValueError("series operators need order_by")
        if any(_long_rank(s) for s in serial) or ordered.largest_key(df, partition_by) > key_rows:
            layout = ordered.lay_out(df, partition_by, order_by, block_rows)
            df = layout.table
    # statistics are learned from a frame without the lookups of other statistics, as long as it has their inputs; row-wise columns
    # that nothing else reads come last, so that no shuffle carries them
    learned = df if learned is None else learned
    read = _ordered([s for s in found.values() if s.family != "scalar"])
    for family, batch in [*_turns(read), *_turns({key: s for key, s in found.items() if key not in read}, read)]:
        inputs = {_column(i, names) for s in batch for i in s.inputs}
        learned = learned if inputs <= set(learned.columns) else df
        if family == "scalar":
            columns = {names[s.key]: _scalar(s, names) for s in batch}
            df, learned = df.withColumns(columns), learned.withColumns(columns)
        elif family == "group":
            df = _group_turn(df, learned, batch, names, fit_on)
        elif family == "table":
            for s in batch:
                df = _table_step(df, learned, s, names, fit_on, key_rows, block_rows)
        elif layout is None:
            df = learned = _key_turn(df, family, batch, names, partition_by, order_by)
        else:
            layout = ordered.Layout(df, layout.keys, layout.block_rows)
            df = learned = _block_turn(layout, family, batch, names).table
    drop = list(names.values()) + ([POS, BLOCK] if layout is not None else [])
    return df.withColumns({s.label: _col(names[s.key]) for s in specs}).drop(*drop)


def _scalar(s: FeatureSpec, names: dict[str, str]) -> Column:
    return SCALAR[s.op](*[_col(_column(i, names)) for i in s.inputs], **dict(s.params))


def _long_rank(s: FeatureSpec) -> bool:
    """Ranks in long frames are counted block by block, whatever the size of the keys."""
    return s.op == "rolling_rank" and s.param("n") > rolling.LONG_FRAME


def _series(df: DataFrame, batch: Sequence[FeatureSpec], names: dict[str, str], w, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """All series columns of a turn; frames that several of them use are computed once."""
    frames = rolling.Frames(w, keys, order)
    features = {
        names[s.key]: SERIES[s.op][0](*[_col(_column(i, names)) for i in s.inputs], f=frames, **dict(s.params))
        for s in batch
    }
    return frames.add_to(df, features)


def _key_turn(df, family, batch, names, partition_by, order_by) -> DataFrame:
    w = Window.partitionBy(*partition_by).orderBy(*order_by)
    if family == "series":
        return _series(df, batch, names, w, partition_by, order_by)
    if family == "fill":
        return df.withColumns(
            {names[s.key]: ordered.running_value("last", _col(_column(s.inputs[0], names)), w) for s in batch}
        )
    for s in batch:
        levels, helpers = rolling.exponential_levels(
            _col(_column(s.inputs[0], names)), s.param("span"), w, list(partition_by), list(order_by), names[s.key]
        )
        for level in levels:
            df = df.withColumns(level)
        df = df.drop(*helpers)
    return df


def _rank_blocks(df: DataFrame, keys: Sequence[str], wanted: dict[str, tuple[str, int]]) -> DataFrame:
    schema = StructType(df.schema.fields + [StructField(name, DoubleType()) for name in wanted])
    return df.groupBy(BLOCK).applyInArrow(lambda block: rolling.block_ranks(block, keys, POS, wanted), schema)


def _block_turn(layout: ordered.Layout, family, batch, names) -> ordered.Layout:
    w = layout.window()
    if family == "series":
        ranks = [s for s in batch if _long_rank(s)]
        rest = [s for s in batch if not _long_rank(s)]
        if ranks:
            wanted = {names[s.key]: (_column(s.inputs[0], names), s.param("n")) for s in ranks}
            layout = ordered.bounded_frames(layout, max(s.param("n") for s in ranks) - 1, lambda df: _rank_blocks(df, layout.keys, wanted))
        if not rest:
            return layout
        depth = max(SERIES[s.op][1](s) for s in rest)
        return ordered.bounded_frames(layout, depth, lambda df: _series(df, rest, names, w, [BLOCK, *layout.keys], [POS]))
    if family == "fill":
        return ordered.running_blocks(
            layout, {names[s.key]: ("last", _col(_column(s.inputs[0], names))) for s in batch}
        )
    for s in batch:
        levels, helpers = rolling.exponential_levels(
            _col(_column(s.inputs[0], names)), s.param("span"), w, [BLOCK, *layout.keys], [POS], names[s.key]
        )

        def mean(df: DataFrame, levels=levels, helpers=helpers) -> DataFrame:
            for level in levels:
                df = df.withColumns(level)
            return df.drop(*helpers)

        layout = ordered.bounded_frames(layout, rolling.exponential_depth(s.param("span")), mean)
    return layout


def _group_turn(df, learned, batch, names, fit_on) -> DataFrame:
    by_key: dict[tuple[str, ...], dict[str, tuple[str, str]]] = {}
    for s in batch:
        *by, x = (_column(i, names) for i in s.inputs)
        by_key.setdefault(tuple(by), {})[names[s.key]] = (GROUP[s.op], x)
    if len(by_key) > 1 or sum(s.op == "group_nunique" for s in batch) > 1:
        return groups.with_statistics_by_keys(df, by_key, fit_on, learned)
    for by, wanted in by_key.items():
        df = groups.with_group_statistics(df, by, wanted, fit_on, learned)
    return df


def _table_step(df, learned, s, names, fit_on, key_rows, block_rows) -> DataFrame:
    out = names[s.key]
    inputs = [_column(i, names) for i in s.inputs]
    if s.op == "frequency":
        return groups.with_frequency(df, inputs[0], out, fit_on, learned=learned)
    if s.op == "value_count":
        return groups.with_frequency(df, inputs[0], out, fit_on, relative=False, learned=learned)
    if s.op == "residual":
        return groups.with_residual(df, inputs[0], out, fit_on, learned)
    if s.op == "range_scaled":
        return groups.with_range_scaled(df, inputs[0], out, fit_on, learned)
    if s.op == "group_rank":
        return quantiles.group_rank(df, [inputs[0]], inputs[1], out, key_rows, block_rows, learned)
    edges = quantiles.quantile_edges(learned if fit_on is None else learned.filter(fit_on), inputs[0], s.param("q"))
    return df.withColumn(out, num.bin_index(_col(inputs[0]), edges))


def to_json(s: FeatureSpec) -> str:
    """A spec with its inputs and all parameters as JSON."""

    def plain(x: FeatureSpec | str):
        if isinstance(x, str):
            return x
        return {"op": x.op, "inputs": [plain(i) for i in x.inputs], "params": dict(x.params), "name": x.name}

    return json.dumps(plain(s))


def from_json(text: str) -> FeatureSpec:
    def fixed(value):
        return tuple(fixed(v) for v in value) if isinstance(value, list) else value

    def built(x) -> FeatureSpec | str:
        if isinstance(x, str):
            return x
        params = {k: fixed(v) for k, v in x["params"].items()}
        return spec(x["op"], *[built(i) for i in x["inputs"]], name=x["name"], **params)

    return built(json.loads(text))


def specs_table(spark, specs: Sequence[FeatureSpec], fit: bool = False) -> DataFrame:
    """Specs as rows (feature, op, family, inputs, n, fitted, spec) for rules, review and storage.

    ``spec`` holds all of it as JSON; ``specs_from`` reads it back.
    """
    rows = [
        (
            s.label,
            s.op,
            s.family,
            [i.key if isinstance(i, FeatureSpec) else i for i in s.inputs],
            s.param("n"),
            fit and s.family in ("group", "table"),
            to_json(s),
        )
        for s in specs
    ]
    return spark.createDataFrame(
        rows, "feature string, op string, family string, inputs array<string>, n int, fitted boolean, spec string"
    )


def specs_from(rows: DataFrame) -> list[FeatureSpec]:
    """The specs of a table with a ``spec`` column; a table of proposals is read whole, as specs are built on the driver."""
    return [from_json(r["spec"]) for r in rows.select("spec").collect()]
