"""The population of candidates: islands, clusters of equal scores, sampling, and running statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from colwright.functions import numeric as num
from colwright.operators.lookup import attach
from colwright.operators.ordered import BLOCK_ROWS, KEY_ROWS, running

#: Digits that signatures are rounded to in histograms.
SIGNATURE_DIGITS = 6


def mean_score(scores: Column) -> Column:
    """Mean over the tests of a map test -> score."""
    values = F.map_values(scores)
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)


def signature(scores: Column) -> Column:
    """Scores in the order of their test names."""
    return F.transform(F.array_sort(F.map_entries(scores)), lambda e: e["value"])


def successes(candidates: DataFrame, code: str | None = None, function: str = "modify_features") -> DataFrame:
    """Candidates with a score; with ``code``, only those that do not call an earlier version of the function."""
    from colwright.functions.programs import calls_ancestor

    kept = candidates.filter(F.col("score").isNotNull() & ~F.isnan("score"))
    return kept if code is None else kept.filter(~calls_ancestor(F.col(code), function))


def clusters(candidates: DataFrame, island: str = "island_id", sig: str = "signature") -> DataFrame:
    """One row per island and signature: size, first step, and the first member's score."""
    return successes(candidates).groupBy(island, sig).agg(
        F.count(F.lit(1)).alias("n_programs"),
        F.min("step").alias("first_step"),
        F.min_by("score", "step").alias("score"),
    )


def island_best(candidates: DataFrame, island: str = "island_id") -> DataFrame:
    """Best score per island and the first step that reached it."""
    best = F.max(F.struct(F.col("score"), (-F.col("step")).alias("back")))
    return successes(candidates).groupBy(island).agg(best.alias("b")).select(
        island, F.col("b.score").alias("best_score"), (-F.col("b.back")).alias("best_step")
    )


def island_statistics(clusters_: DataFrame, island: str = "island_id") -> DataFrame:
    return clusters_.groupBy(island).agg(
        F.count(F.lit(1)).alias("num_clusters"),
        F.avg("score").alias("mean_score"),
        F.var_pop("score").alias("variance"),
        F.max("score").alias("best_score"),
    )


def softmax(df: DataFrame, by: Sequence[str], logit: str, temperature: float, id_: str, out: str) -> DataFrame:
    """Tempered softmax per group; the rounding rest goes to the largest entry.

    Group totals are aggregates joined back, so a group may be of any size. A missing or non-finite logit stops the
    job.
    """
    bad = F.col(logit).isNull() | num.finite(F.col(logit)).isNull()
    checked = F.when(bad, F.raise_error(F.lit("logits must be finite")).cast("double")).otherwise(F.col(logit))
    rows = df.withColumn("__l", checked / F.lit(float(temperature)))
    top = rows.groupBy(*by).agg(F.max(F.struct("__l", (-F.col(id_)).alias("back"))).alias("__top"))
    shifted = attach(rows, top, by).withColumn("__e", F.exp(F.col("__l") - F.col("__top.__l")))
    total = shifted.groupBy(*by).agg(F.sum("__e").alias("__sum"))
    p = F.col("__e") / F.col("__sum")
    is_top = (F.col("__l") == F.col("__top.__l")) & (-F.col(id_) == F.col("__top.back"))
    # the largest entry has exp(0) = 1, so the others sum to (total - 1) / total
    rest = (F.col("__sum") - F.lit(1.0)) / F.col("__sum")
    fixed = F.when(is_top, F.lit(1.0) - rest).otherwise(p)
    return attach(shifted, total, by).withColumn(out, fixed).drop("__l", "__top", "__e", "__sum")


def uniform(seed: int, *parts: Column) -> Column:
    """A number in (0, 1) that depends on the seed and the given values only."""
    digest = F.md5(F.concat_ws("~", F.lit(str(seed)), *[p.cast("string") for p in parts]))
    top = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")
    return (top + F.lit(0.5)) / F.lit(float(2**52))


def weighted_draws(
    df: DataFrame, by: Sequence[str], id_: str, probability: str, draws: int, seed: int = 42
) -> DataFrame:
    """``draws`` independent weighted draws with replacement per group: keys, draw, and the drawn id.

    In each draw all members race with exponential times of rate ``probability``; the first one wins, which has
    exactly that probability. The winner is a minimum, so groups of any size are reduced on the map side.
    """
    draw = F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")
    entries = df.filter(F.col(probability) > 0).select(*by, id_, probability, draw)
    time = -F.log(uniform(seed, F.col("draw"), F.col(id_))) / F.col(probability)
    return entries.groupBy(*by, "draw").agg(F.min_by(id_, F.struct(time, F.col(id_))).alias(id_))


def sample_clusters(
    clusters_: DataFrame, temperature: float, per_prompt: int = 2, seed: int = 42, island: str = "island_id"
) -> DataFrame:
    """Clusters for the next prompt of each island: min(number of clusters, ``per_prompt``) draws by score."""
    weighted = softmax(clusters_, [island], "score", temperature, "first_step", "p")
    sizes = clusters_.groupBy(island).agg(F.count(F.lit(1)).alias("__k"))
    drawn = weighted_draws(weighted, [island], "first_step", "p", per_prompt, seed)
    return attach(drawn, sizes, [island]).filter(F.col("draw") < F.col("__k")).drop("__k")


def sample_programs(
    candidates: DataFrame, length: str, draws: int = 1, seed: int = 42, by: Sequence[str] = ("island_id", "signature")
) -> DataFrame:
    """Programs drawn from each cluster, shorter ones with higher probability."""
    ends = candidates.groupBy(*by).agg(F.min(length).alias("__min"), F.max(length).alias("__max"))
    logit = -(F.col(length) - F.col("__min")) / (F.col("__max") + F.lit(1e-6))
    rows = attach(candidates, ends, by).withColumn("__logit", logit)
    weighted = softmax(rows, by, "__logit", 1.0, "step", "p")
    return weighted_draws(weighted, by, "step", "p", draws, seed)


def order_in_prompt(
    chosen: DataFrame, by: Sequence[str], key_rows: int = KEY_ROWS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Chosen programs of a prompt from worst to best; ``version`` is the position from 0."""
    counted = {"version": ("sum", F.lit(1).cast("long"))}
    placed = running(chosen, by, ["score", "step"], counted, key_rows, block_rows)
    return placed.withColumn("version", (F.col("version") - 1).cast("int"))


def best_updates(
    candidates: DataFrame,
    island: str = "island_id",
    step: str = "step",
    key_rows: int = KEY_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(island_id, updated_score, global_step) for every candidate that beats all earlier ones of its island."""
    scored = successes(candidates)
    best = {"__best": ("max", F.struct(F.col("score").alias("s"), (-F.col(step)).alias("back")))}
    ran = running(scored, [island], [step], best, key_rows, block_rows)
    # a candidate that only equals the best so far is not the first to reach it
    return ran.filter(-F.col("__best.back") == F.col(step)).select(
        F.col(island).alias("island_id"), F.col("score").alias("updated_score"), F.col(step).alias("global_step")
    )


def running_progress(
    candidates: DataFrame,
    run: Sequence[str] = ("run_id",),
    step: str = "step",
    key_rows: int = KEY_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Best score so far and its step, successes, failures and time spent, after every step of a run."""
    scored = F.col("score").isNotNull()
    best = F.when(scored, F.struct(F.col("score").alias("s"), (-F.col(step)).alias("back")))
    out = running(
        candidates,
        run,
        [step],
        {
            "__best": ("max", best),
            "successes": ("sum", scored.cast("long")),
            "failures": ("sum", (~scored).cast("long")),
            "total_sample_time": ("sum", F.coalesce("sample_time", F.lit(0.0))),
            "total_evaluate_time": ("sum", F.coalesce("evaluate_time", F.lit(0.0))),
        },
        key_rows,
        block_rows,
    )
    return out.withColumns({"best_score": F.col("__best.s"), "best_step": -F.col("__best.back")}).drop("__best")


def running_histogram(
    candidates: DataFrame,
    island: str = "island_id",
    value: str = "signature_value",
    step: str = "step",
    key_rows: int = KEY_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """How many programs the candidate's cluster holds after its step."""
    rounded = candidates.withColumn("cluster", F.round(value, SIGNATURE_DIGITS))
    counted = {"cluster_count": ("sum", F.lit(1).cast("long"))}
    return running(rounded, [island, "cluster"], [step], counted, key_rows, block_rows)


def split_metrics(candidates: DataFrame) -> DataFrame:
    """The label table of run metrics: one row per step."""
    return candidates.select(
        "run_id",
        F.col("split").alias("split_id"),
        F.col("step").alias("global_step"),
        "island_id",
        "score",
        "sample_time",
        "evaluate_time",
        F.when(F.col("score").isNotNull(), F.col("score")).alias("island_score"),
    )
