"""Search over features: propose specs, score a whole round in few passes, validate the best, keep a population."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations, permutations

from pyspark.sql import DataFrame, Window, functions as F

from colwright.operators import boosting, folds as folding, metrics, models, profile
from colwright.plans import spec as specs_of
from colwright.plans.protocol import Protocol
from colwright.plans.spec import FeatureSpec, spec, specs_table, with_features
from colwright.storage import cut_lineage

# The operators that proposals are made from, by what they take.
ONE_NUMBER = ("absolute", "log_safe", "sqrt", "sigmoid", "square", "signed_sqrt", "round", "residual")
TWO_NUMBERS = ("multiply", "ratio", "subtract", "minimum", "maximum")
ANY_COLUMN = ("frequency",)
GROUP_AND_NUMBER = ("group_min", "group_max", "group_mean", "group_median", "group_std", "group_rank")
TWO_GROUPS = ("group_nunique",)
TWO_GROUPS_UNORDERED = ("combined_frequency",)
SERIES_OF_NUMBER = (
    "lag", "delta", "rolling_mean", "rolling_std", "rolling_min", "rolling_max", "rolling_zscore", "rolling_rank",
    "rate_of_change", "exponential_mean", "ratio_to_mean",
)
SERIES_OF_TWO = ("rolling_correlation",)
#: Rows that proposed series features look back.
SPANS = (3, 10)
#: Specs that are computed and scored together.
SPECS_AT_ONCE = 100
#: Rows per cell of equal ones from which on features are made per cell.
ROWS_OF_A_CELL = 4

_STEPS = {
    "combined_frequency": lambda a, b: specs_of.combined_frequency(a, b),
    "rate_of_change": lambda x, n: specs_of.rate_of_change(x, n),
    "exponential_mean": lambda x, n: specs_of.exponential_mean(x, n),
}


def _made(op: str, *inputs, n: int | None = None) -> FeatureSpec:
    params = {} if n is None else {"n": n}
    return _STEPS[op](*inputs, **params) if op in _STEPS else spec(op, *inputs, **params)


def propose(
    numeric: Sequence[str],
    categorical: Sequence[str] = (),
    series: bool = False,
    spans: Sequence[int] = SPANS,
    operators: Sequence[str] | None = None,
) -> list[FeatureSpec]:
    """All specs of the vocabulary over the columns, each once; ``series`` adds those that need an order of rows.

    ``operators`` restricts the vocabulary to some names.
    """
    made: list[tuple[str, FeatureSpec]] = []

    def add(ops: Sequence[str], inputs, n: int | None = None) -> None:
        made.extend((op, _made(op, *i, n=n)) for i in inputs for op in ops if operators is None or op in operators)

    add(ONE_NUMBER, [(x,) for x in numeric])
    add(TWO_NUMBERS, list(combinations(numeric, 2)))
    add(ANY_COLUMN, [(x,) for x in (*numeric, *categorical)])
    add(GROUP_AND_NUMBER, [(c, x) for c in categorical for x in numeric])
    add(TWO_GROUPS, list(permutations(categorical, 2)))
    add(TWO_GROUPS_UNORDERED, list(combinations(categorical, 2)))
    for n in spans if series else ():
        add(SERIES_OF_NUMBER, [(x,) for x in numeric], n)
        add(SERIES_OF_TWO, list(combinations(numeric, 2)), n)
    return list({s.key: s for _, s in made}.values())


def propose_for(df: DataFrame, target: str, skip: Sequence[str] = (), metadata: DataFrame | None = None, **options) -> list[FeatureSpec]:
    """Proposals over the columns of a table, by their measured kinds."""
    kinds = profile.infer_kinds(profile.column_statistics(df.drop(target, *skip)), metadata)
    rows = sorted((r["name"], r["kind"]) for r in kinds.select("name", "kind").collect())  # one row per column
    return propose([c for c, k in rows if k == "numeric"], [c for c, k in rows if k == "categorical"], **options)


def proposal_rows(spark, specs: Sequence[FeatureSpec]) -> DataFrame:
    """(op, columns, n, spec): proposals by their name in the vocabulary, the columns they read, and how far they look back."""
    inner = {"change_of_known": "rate_of_change", "known": "exponential_mean"}

    def leaves(s: FeatureSpec) -> list[str]:
        return [x for i in s.inputs for x in (leaves(i) if isinstance(i, FeatureSpec) else [i])]

    def span(s: FeatureSpec):
        return next((v for x in (s, *s.inputs) if isinstance(x, FeatureSpec) for k, v in x.params if k in ("n", "span")), None)

    rows = []
    for s in specs:
        combined = s.op == "frequency" and isinstance(s.inputs[0], FeatureSpec)
        op = "combined_frequency" if combined else inner.get(s.op, s.op)
        rows.append((op, leaves(s), span(s), specs_of.to_json(s)))
    return spark.createDataFrame(rows, "op string, columns array<string>, n int, spec string")


def deepen(
    survivors: Sequence[FeatureSpec],
    numeric: Sequence[str],
    categorical: Sequence[str] = (),
    series: bool = False,
    spans: Sequence[int] = SPANS,
    operators: Sequence[str] | None = None,
) -> list[FeatureSpec]:
    """Proposals of the next round: the vocabulary on top of the features that were kept."""

    def some(ops: Sequence[str]) -> list[str]:
        return [op for op in ops if operators is None or op in operators]

    made = [_made(op, s) for s in survivors for op in some(ONE_NUMBER) if s.op != op]
    made += [_made(op, s, x) for s in survivors for x in numeric for op in some(TWO_NUMBERS)]
    made += [_made(op, c, s) for s in survivors for c in categorical for op in some(GROUP_AND_NUMBER)]
    if series:
        made += [_made(op, s, n=n) for s in survivors for op in some(SERIES_OF_NUMBER) for n in spans]
    return list({s.key: s for s in made}.values())


def filter_scores(df: DataFrame, specs: Sequence[FeatureSpec], target: str, task: str, rows=None, **where) -> DataFrame:
    """(feature, correlation, eta_squared | mutual_information, score) for all specs from shared aggregates.

    Features are computed over all rows of ``df`` and scored over those that meet ``rows``. Specs are taken ``SPECS_AT_ONCE``
    at a time, so that no row holds more features than that.
    """
    return models.union_all([_scored(table, names, task) for names, table in _written(df, specs, target, task, rows=rows, **where)])


def cells_by(df: DataFrame, columns: Sequence[str] | None) -> Sequence[str] | None:
    """``columns`` to count rows by, if at most one in ``ROWS_OF_A_CELL`` rows (about) differs from all others in them."""
    if not columns:
        return None
    seen = F.approx_count_distinct(F.struct(*[F.col(f"`{c}`") for c in columns]))
    n, different = df.agg(F.count(F.lit(1)), seen).first()
    return columns if different * ROWS_OF_A_CELL <= n else None


def _written(df: DataFrame, specs: Sequence[FeatureSpec], target: str, task: str, keep: Sequence[str] = (), rows=None, **where):
    """(labels, written features) of ``SPECS_AT_ONCE`` specs at a time, of the rows that meet ``rows``.

    Where many rows agree in all that the specs read, features are made once for them, from statistics of all rows.
    """
    measured = metrics.counted if task == "classification" else metrics.measured
    for i in range(0, len(specs), SPECS_AT_ONCE):
        some = specs[i : i + SPECS_AT_ONCE]
        inputs = specs_of.row_inputs(some)
        used = df if rows is None else df.filter(rows)
        by = cells_by(used, None if inputs is None else sorted({*inputs, *keep}))
        if by is None:
            table = with_features(measured(df, target), some, **where)
            table = table if rows is None else table.filter(rows)
        else:
            table = with_features(measured(used, target, by), some, learned=df, **where)
        names = [s.label for s in some]
        yield names, metrics.written_features(table, names, keep)


def _scored(table: DataFrame, names: Sequence[str], task: str) -> DataFrame:
    if task == "classification":
        return metrics.information_of(table, names).withColumn("score", F.col("mutual_information"))
    return metrics.scores_of(table, names).withColumn("score", F.col("eta_squared"))


def _fitted(s: FeatureSpec) -> bool:
    """Whether a spec, or one of its inputs, learns from the training rows; ranks are places among all rows."""
    learns = s.family == "group" or (s.family == "table" and s.op != "group_rank")
    return learns or any(_fitted(i) for i in s.inputs if isinstance(i, FeatureSpec))


def candidate_scores(
    df: DataFrame,
    candidates: Mapping[str, Sequence[FeatureSpec]],
    target: str,
    protocol: Protocol,
    fold: str,
    folds: Sequence[int],
    ordered: bool,
    base: Sequence[str] = (),
    rounds: int = models.ROUNDS,
    seed: int = 42,
    parallel: int = 4,
    **where,
) -> DataFrame:
    """(candidate, fold, score, n, n_scored): boosted trees on ``base`` and the features of each candidate.

    Per fold, the features of all candidates are computed and written once, their statistics learned from the fold's training
    rows; ``parallel`` folds at a time. The trees of all candidates and folds then grow together (``operators.boosting``).
    ``seed`` is taken for callers that name one: these trees draw nothing at random.
    """
    spark, classes = df.sparkSession, None
    if protocol.task == "classification":
        df, classes = models.with_class_codes(df, target)
    wanted = list({s.key: s for specs in candidates.values() for s in specs}.values())
    column = {s.key: f"__c{i}" for i, s in enumerate(wanted)}

    def made(j: int) -> DataFrame:
        train = folding.is_train(F.col(fold), j, ordered)
        rows = with_features(df.filter(train | (F.col(fold) == j)), wanted, fit_on=train, **where)
        features = [F.col(f"`{s.label}`").alias(column[s.key]) for s in wanted]
        return cut_lineage(rows.select(target, fold, *[c for c in base if c not in (target, fold)], *features), "fold")

    tables = dict(zip(folds, models.side_by_side(spark, made, list(folds), parallel), strict=True))
    inputs = {name: [*base, *[column[s.key] for s in specs]] for name, specs in candidates.items()}
    scored = boosting.out_of_fold(tables, inputs, target, fold, ordered, classes, rounds, parallel=parallel)
    spread = None
    if protocol.metric == "nrmse":
        spread = metrics.train_spread(df, target, fold, max(folds) + 1, ordered)
    by_fold = scored.withColumn("fold", F.col(fold)) if fold != "fold" else scored
    spread = spread.withColumnRenamed(fold, "fold") if spread is not None else None
    if spread is None:
        return metrics.fold_scores(by_fold, protocol.metric, target, "prediction", ["candidate", "fold"])
    errors = metrics.fold_scores(by_fold, "rmse", target, "prediction", ["candidate", "fold"])
    relative = errors.join(F.broadcast(spread), "fold")
    return relative.select("candidate", "fold", metrics.num.ratio(F.col("score"), F.col("spread")).alias("score"), "n", "n_scored")


def evaluate_round(
    df: DataFrame,
    specs: Sequence[FeatureSpec],
    target: str,
    protocol: Protocol,
    fold: str,
    keep: int = 3,
    base: Sequence[str] = (),
    rounds: int = models.ROUNDS,
    seed: int = 42,
    parallel: int = 4,
    **where,
) -> DataFrame:
    """(feature, filter_score, score, signature), one row per spec; the ``keep`` best by filter are validated with trees.

    A filter score is the mean over the inner folds, each learned and measured on the fold's training rows. ``signature`` holds
    the scores of the folds; both it and ``score`` are NULL where no fit was paid for. ``parallel`` folds, and later fits, run at a time.
    """
    spark, ordered = df.sparkSession, protocol.ordered("inner")
    # every statistic reads the rows again, so folds are not placed again for each
    df = cut_lineage(df, "round")
    # features that learn nothing from the training rows are the same in all folds, unless folds hold different rows
    per_fold = [s for s in specs if ordered or _fitted(s)]
    same = list(_written(df, [s for s in specs if not (ordered or _fitted(s))], target, protocol.task, [fold], **where))

    def filtered(j: int) -> DataFrame:
        train = folding.is_train(F.col(fold), j, ordered)
        found = [_scored(table.filter(train), names, protocol.task) for names, table in same]
        if per_fold:
            used = df.filter(train | (F.col(fold) == j))
            found.append(filter_scores(used, per_fold, target, protocol.task, rows=train, fit_on=train, **where))
        return models.union_all([scores.select("feature", "score") for scores in found])

    parts = models.side_by_side(spark, filtered, range(protocol.inner_folds), parallel)
    mean = models.union_all(parts).groupBy("feature").agg(F.avg("score").alias("filter_score"))
    mean = cut_lineage(mean, "filter")
    # features that cut the rows alike differ in the last digits only, by the order of additions: their names decide
    rank = [F.desc(F.round("filter_score", 9)), F.col("feature")]
    best = mean.filter("filter_score IS NOT NULL").orderBy(*rank).limit(keep).select("feature").collect()
    by_label = {s.label: s for s in specs}
    listed = specs_table(spark, specs).select("feature", "op", "spec")
    out = listed.join(mean, "feature", "left")
    if not best:
        return out.withColumns({"score": F.lit(None).cast("double"), "signature": F.lit(None).cast("array<double>")})
    candidates = {r["feature"]: [by_label[r["feature"]]] for r in best}
    scored = candidate_scores(df, candidates, target, protocol, fold, range(protocol.inner_folds), ordered, base, rounds, seed, parallel, **where)
    scored = scored.groupBy(F.col("candidate").alias("feature")).agg(
        F.avg("score").alias("score"), F.transform(F.array_sort(F.collect_list(F.struct("fold", "score"))), lambda x: x["score"]).alias("signature")
    )
    return out.join(F.broadcast(scored), "feature", "left")  # at most ``keep`` rows


def hold_out_score(
    df: DataFrame,
    specs: Sequence[FeatureSpec],
    target: str,
    protocol: Protocol,
    outer: str,
    fold: int,
    base: Sequence[str] = (),
    rounds: int = models.ROUNDS,
    seed: int = 42,
    **where,
) -> DataFrame:
    """(outer_fold, score) on an outer fold that the search has not seen; statistics are learned from its training rows."""
    scores = candidate_scores(df, {"held": specs}, target, protocol, outer, [fold], protocol.ordered("outer"), base, rounds, seed, **where)
    return scores.select(F.col("fold").alias("outer_fold"), "score")


def search(
    df: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    target: str,
    protocol: Protocol,
    ids: Sequence[str],
    order_by: Sequence[str] = (),
    partition_by: Sequence[str] = (),
    generations: int = 1,
    keep: int = 2,
    rounds: int = models.ROUNDS,
    seed: int = 42,
    first: Sequence[FeatureSpec] | None = None,
    operators: Sequence[str] | None = None,
    parallel: int = 3,
) -> DataFrame:
    """All candidates of all outer folds: outer_fold, generation, feature, spec, filter_score, score, cluster, best, hold_out.

    The population keeps every validated candidate of every generation. ``cluster`` numbers the validated candidates of a fold
    with equal scores on all inner folds, best first; ``best`` marks the ``keep`` best of all generations, and ``hold_out`` is
    their joint score on the outer fold. With an order of rows, series features are proposed as well. ``first`` replaces the
    proposals of the first generation, ``operators`` restricts the vocabulary to some names. ``parallel`` outer folds run at a time.
    """
    where = {"partition_by": partition_by, "order_by": order_by} if order_by else {}
    placed = cut_lineage(protocol.assign(df, "outer", target, ids, order_by, "__outer", seed), "outer")

    def searched(j: int) -> DataFrame:
        train = placed.filter(folding.is_train(F.col("__outer"), j, protocol.ordered("outer")))
        train = cut_lineage(protocol.assign(train, "inner", target, ids, order_by, "__inner", seed), "inner")
        specs = list(first) if first is not None else propose(numeric, categorical, bool(order_by), operators=operators)
        population: dict[str, tuple[float, FeatureSpec]] = {}
        rounds_of_fold = []
        for generation in range(generations):
            specs = [s for s in specs if s.label not in population]
            scores = cut_lineage(evaluate_round(train, specs, target, protocol, "__inner", keep, numeric, rounds, seed, **where), "round")
            rounds_of_fold.append(scores.select(F.lit(generation).alias("generation"), "*"))
            by_label = {s.label: s for s in specs}
            for r in scores.filter("score IS NOT NULL").select("feature", "score").collect():  # at most ``keep`` rows
                population[r["feature"]] = (r["score"], by_label[r["feature"]])
            ranked = sorted(population.items(), key=lambda x: (-x[1][0], x[0]))[:keep]
            specs = deepen([s for _, (_, s) in ranked], numeric, categorical, bool(order_by), operators=operators)
        winners = [name for name, _ in ranked]
        held = hold_out_score(placed, [s for _, (_, s) in ranked], target, protocol, "__outer", j, numeric, rounds, seed, **where)
        rows = models.union_all(rounds_of_fold)
        best = F.col("score").isNotNull() & F.col("feature").isin(winners)
        return rows.withColumn("best", best).crossJoin(F.broadcast(held.select("outer_fold", F.col("score").alias("hold_out"))))

    found = models.union_all(models.side_by_side(df.sparkSession, searched, range(protocol.outer_folds), parallel))
    same = Window.partitionBy("outer_fold").orderBy(F.desc("score"), F.desc("signature"))
    validated = found.filter("score IS NOT NULL").withColumn("cluster", F.dense_rank().over(same))
    rest = found.filter("score IS NULL").withColumn("cluster", F.lit(None).cast("int"))
    return validated.unionByName(rest).select(
        "outer_fold", "generation", "feature", "spec", "filter_score", "score", "cluster", "best",
        F.when(F.col("best"), F.col("hold_out")).alias("hold_out"),
    )
