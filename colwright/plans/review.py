"""Reviews of candidate features: parsed review records, and a review by rules.

The rules look at what an operator does to the kinds of its inputs and to the data; the first rule that fires gives
the class, and a feature without a finding makes sense.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from colwright.functions import numeric as num, programs
from colwright.operators.lookup import coalesce_columns, with_program_score
from colwright.operators.ordered import BLOCK_ROWS, KEY_ROWS, running
from colwright.operators.quantiles import box_summary
from colwright.plans.search import cells_by
from colwright.storage import cut_lineage

# The three classes and the defaults of incomplete review records.
MAKES_SENSE, NO_IMPACT, NO_SENSE = "Makes sense", "No impact", "Makes no sense"
DEFAULTS = {"feature_name": "Unknown", "classification": "N/A", "reasoning": "N/A", "code_snippet": ""}

_REVIEW = (
    "array<struct<program_index:bigint,feature_name:string,code_snippet:string,classification:string,reasoning:string>>"
)


def parse_reviews(responses: DataFrame, column: str, *keys: str) -> DataFrame:
    """One row per review record; a response is a list, or an object with the list under ``review``."""
    as_list = F.from_json(F.col(column), _REVIEW)
    as_object = F.from_json(F.col(column), f"struct<review:{_REVIEW}>")
    is_list = F.startswith(F.ltrim(F.col(column)), F.lit("["))
    records = F.when(is_list, as_list).otherwise(as_object["review"])
    return responses.select(*keys, F.inline(records))


def concatenate_reviews(batches: Sequence[DataFrame]) -> DataFrame:
    out = batches[0]
    for batch in batches[1:]:
        out = out.unionByName(batch)
    return out


def review_table(reviews: DataFrame, candidates: DataFrame, run: Sequence[str] = ("run_id",)) -> DataFrame:
    """Review records with defaults for missing parts and the score of the reviewed program."""
    filled = coalesce_columns(reviews, {c: F.lit(v) for c, v in DEFAULTS.items()})
    scored = with_program_score(filled, candidates, (*run, "program_index"))
    return scored.select(
        *run, "program_index", "feature_name", "classification", "reasoning", "code_snippet", "score"
    )


def class_counts(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("classification").agg(F.count(F.lit(1)).alias("n"))


def class_scores(reviews: DataFrame) -> DataFrame:
    """Box summary of the program scores per class."""
    return box_summary(reviews, ["classification"], "score")


def token_usage(usage: DataFrame, *by: str) -> DataFrame:
    parts = ("input_tokens", "output_tokens", "thought_tokens", "total_tokens")
    return usage.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in parts])


def lint_programs(candidates: DataFrame, code: str) -> DataFrame:
    """Adds ``has_loop``, ``calls_ancestor`` and ``looks_ahead`` for the program text."""
    text = F.col(code)
    return candidates.withColumns(
        {
            "has_loop": programs.has_loop(text),
            "calls_ancestor": programs.calls_ancestor(text),
            "looks_ahead": programs.looks_ahead(text),
        }
    )


# --- review by rules ----------------------------------------------------------------------------------------------

# Operators by what they require of their inputs.
MULTIPLYING = ("multiply",)
ADDING = ("add", "subtract", "absolute_difference", "mean")
NUMERIC_ONLY = ("log", "log_safe", "sqrt", "signed_sqrt")
WHOLE_TABLE = ("group", "table")
LINEAR = ("linear",)


def input_kinds(specs: DataFrame, columns: DataFrame, *keys: str) -> DataFrame:
    """Per feature, how many inputs of each kind it has, and how many units; ``columns`` has (name, kind, unit, is_id)."""
    exploded = specs.select(*keys, "feature", F.explode("inputs").alias("name"))
    joined = exploded.join(columns, ["name"], "left")
    return joined.groupBy(*keys, "feature").agg(
        F.sum((F.col("kind") == "continuous").cast("int")).alias("n_continuous"),
        F.sum((F.col("kind") == "boolean").cast("int")).alias("n_boolean"),
        F.sum(F.col("kind").isin("ordinal", "nominal").cast("int")).alias("n_coded"),
        F.sum((F.col("kind").isin("ordinal", "nominal") | F.coalesce("is_id", F.lit(False))).cast("int")).alias(
            "n_not_numeric"
        ),
        F.count_distinct("unit").alias("n_units"),
    )


def _magnitude() -> Column:
    """A category code must not be multiplied, with whatever it is."""
    return F.col("op").isin(*MULTIPLYING) & (F.coalesce("n_coded", F.lit(0)) > 0)


def _type_error() -> Column:
    return F.col("op").isin(*NUMERIC_ONLY) & (F.coalesce("n_not_numeric", F.lit(0)) > 0)


def _leak() -> Column:
    learned = F.col("family").isin(*WHOLE_TABLE) & ~F.coalesce("fitted", F.lit(False))
    return learned | ((F.col("family") == "series") & (F.coalesce("n", F.lit(1)) <= 0))


def _units() -> Column:
    return F.col("op").isin(*ADDING) & (F.coalesce("n_units", F.lit(0)) > 1)


def review_specs(
    specs: DataFrame, columns: DataFrame, redundancy: DataFrame | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """Class and reason per feature. ``redundancy`` may add (keys, feature, linear, monotone) measured on data."""
    kinds = input_kinds(specs, columns, *keys)
    rows = specs.join(kinds, [*keys, "feature"], "left")
    if redundancy is not None:
        rows = rows.join(redundancy, [*keys, "feature"], "left")
    else:
        rows = rows.withColumns({"linear": F.lit(None).cast("boolean"), "monotone": F.lit(None).cast("boolean")})
    one_input = F.size("inputs") == 1
    reason = (
        F.when(_leak(), F.lit("leakage"))
        .when(_type_error(), F.lit("type error"))
        .when(_magnitude(), F.lit("magnitude of a category code"))
        .when(_units(), F.lit("incompatible units"))
        .when(F.coalesce("linear", F.lit(False)) | (F.col("op").isin(*LINEAR) & one_input), F.lit("linear copy"))
        .when(F.coalesce("monotone", F.lit(False)), F.lit("monotone copy"))
    )
    rejected = reason.isin("leakage", "type error", "magnitude of a category code", "incompatible units")
    label = F.when(reason.isNull(), F.lit(MAKES_SENSE)).when(rejected, F.lit(NO_SENSE)).otherwise(F.lit(NO_IMPACT))
    return rows.select(
        *keys, "feature", "op", label.alias("classification"), F.coalesce(reason, F.lit("")).alias("reasoning")
    )


def redundancy(
    df: DataFrame,
    pairs: Sequence[tuple[str, str]],
    tolerance: float = 1e-9,
    key_rows: int = KEY_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(feature, input, correlation, rank_correlation, linear, monotone) for pairs (feature, its only input).

    A perfect correlation is a linear copy, a perfect correlation of ranks a monotone one. Values are compared as doubles;
    a row counts for a pair if both are known, and ranks are those among all known values of a column, ties averaged. A
    column that is constant on the rows of a pair has no correlation.

    The jobs do not grow with the pairs: rows that repeat are counted once, all columns are counted by value in one pass and ranked
    in one running sum, and all pairs are counted by both values in another pass, so that only different pairs of values look up
    their ranks.
    """
    columns = sorted({c for pair in pairs for c in pair})
    at = {c: i for i, c in enumerate(columns)}
    wide = df.select(*[num.finite(F.col(f"`{c}`").cast("double")).alias(f"x{i}") for c, i in at.items()])
    # where many rows agree in all columns, they are counted once before they are unfolded
    by = cells_by(wide, wide.columns)
    rows = cut_lineage(wide.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), "cells") if by else wide.withColumn("n", F.lit(1).cast("long"))
    cells = [F.struct(F.lit(i).alias("c"), F.col(f"x{i}").alias("v"), F.col("n")) for i in at.values()]
    melted = rows.select(F.inline(F.array(*cells))).filter("v IS NOT NULL")
    counts = cut_lineage(melted.groupBy("c", "v").agg(F.sum("n").alias("n")), "counts")
    upto = running(counts, ["c"], ["v"], {"upto": ("sum", F.col("n"))}, key_rows, block_rows)
    centre = counts.groupBy("c").agg(((F.sum("n") + 1) / F.lit(2.0)).alias("centre"))
    # one row per column
    ranks = upto.join(F.broadcast(centre), "c").select("c", "v", (F.col("upto") - (F.col("n") - 1) / F.lit(2.0) - F.col("centre")).alias("d"))
    ranks = cut_lineage(ranks, "ranks")

    numbered = [(p, at[feature], at[source]) for p, (feature, source) in enumerate(pairs)]
    joint = [
        F.struct(F.lit(p).alias("p"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"x{a}").alias("x"), F.col(f"x{b}").alias("y"), F.col("n"))
        for p, a, b in numbered
    ]
    both = rows.select(F.inline(F.array(*joint))).filter("x IS NOT NULL AND y IS NOT NULL")
    met = both.groupBy("p", "a", "b", "x", "y").agg(F.sum("n").alias("n"))
    met = met.join(ranks.select(F.col("c").alias("a"), F.col("v").alias("x"), F.col("d").alias("dx")), ["a", "x"])
    met = met.join(ranks.select(F.col("c").alias("b"), F.col("v").alias("y"), F.col("d").alias("dy")), ["b", "y"])
    sums = {"n": "n", "sx": "n * dx", "sy": "n * dy", "sxx": "n * dx * dx", "syy": "n * dy * dy", "sxy": "n * dx * dy"}
    varies = F.expr("min(dx) < max(dx) AND min(dy) < max(dy)").alias("varies")
    summed = met.groupBy("p").agg(varies, *[F.expr(f"sum({of})").alias(name) for name, of in sums.items()])
    spread = F.sqrt(F.expr("(sxx - sx * sx / n) * (syy - sy * sy / n)"))
    ranked = summed.select("p", F.when(F.col("varies"), F.try_divide(F.expr("sxy - sx * sy / n"), spread)).alias("rank_correlation"))

    linear = wide.agg(*[num.correlation(F.col(f"x{a}"), F.col(f"x{b}")).alias(f"r{p}") for p, a, b in numbered])
    named = [
        F.struct(F.lit(p).alias("p"), F.lit(feature).alias("feature"), F.lit(source).alias("input"), F.col(f"r{p}").alias("correlation"))
        for p, (feature, source) in enumerate(pairs)
    ]
    table = linear.select(F.inline(F.array(*named))).join(F.broadcast(ranked), "p", "left").drop("p")
    return table.withColumns(
        {
            "linear": F.coalesce(F.abs("correlation") >= 1 - tolerance, F.lit(False)),
            "monotone": F.coalesce(F.abs("rank_correlation") >= 1 - tolerance, F.lit(False)),
        }
    )
