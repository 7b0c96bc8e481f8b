"""Column profiling: kinds, ranges, categories and one description line per column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from colwright.operators.lookup import describe_columns
from colwright.operators.ordered import running
from colwright.storage import cut_lineage

# Type hints of the metadata, by the kind they stand for.
CATEGORICAL_HINTS = ("categorical", "binary", "ordinal")
NUMERIC_HINTS = ("continuous", "numeric", "numerical")
# Fixed value: a column of this name is categorical whatever it holds.
RESULT_COLUMN = "Result"

def type_hint_kind(hint: Column) -> Column:
    """``categorical``, ``numeric``, or NULL where the hint does not tell."""
    hint = F.lower(hint)
    return F.when(hint.isin(*CATEGORICAL_HINTS), F.lit("categorical")).when(
        hint.isin(*NUMERIC_HINTS), F.lit("numeric")
    )


def column_statistics(df: DataFrame) -> DataFrame:
    """One row per column from a single aggregate over the table, unpivoted."""
    measures, rows = [], []
    for i, field in enumerate(df.schema.fields):
        c = F.col(f"`{field.name}`")
        numeric = isinstance(field.dataType, T.NumericType)
        as_number = c.cast("double") if numeric else F.lit(None).cast("double")
        measures += [
            F.count(c).alias(f"n{i}"),
            F.min(as_number).alias(f"lo{i}"),
            F.max(as_number).alias(f"hi{i}"),
            # exactly the values 0 and 1, both present, nothing missing
            (
                (F.min(as_number) == 0)
                & (F.max(as_number) == 1)
                & F.bool_and((as_number == 0) | (as_number == 1))
                & (F.count(c) == F.count(F.lit(1)))
            ).alias(f"z{i}"),
        ]
        rows.append(
            F.struct(
                F.lit(field.name).alias("name"),
                F.lit(field.dataType.simpleString()).alias("data_type"),
                F.col(f"n{i}").alias("n_known"),
                F.col(f"lo{i}").alias("low"),
                F.col(f"hi{i}").alias("high"),
                F.coalesce(F.col(f"z{i}"), F.lit(False)).alias("only_zero_one"),
            )
        )
    return df.agg(*measures).select(F.inline(F.array(*rows)))


_NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double")


def infer_kinds(
    statistics: DataFrame, metadata: DataFrame | None = None, numeric_hints: bool = True
) -> DataFrame:
    """Adds ``kind``: the metadata hint first, then name, type and values decide.

    Strings, zero-one columns and all non-numeric types are categorical; other numbers are numeric. Without
    ``numeric_hints`` the metadata can only make a column categorical.
    """
    numeric = F.col("data_type").isin(*_NUMERIC_TYPES) | F.startswith("data_type", F.lit("decimal"))
    inferred = (
        F.when(F.col("name") == RESULT_COLUMN, F.lit("categorical"))
        .when(numeric & ~F.col("only_zero_one"), F.lit("numeric"))
        .otherwise(F.lit("categorical"))
    )
    if metadata is None:
        return statistics.withColumn("kind", inferred)
    hint = type_hint_kind(F.col("type"))
    if not numeric_hints:
        hint = F.when(hint == "categorical", hint)
    hints = metadata.select("name", hint.alias("__hint"))
    joined = statistics.join(hints, ["name"], "left")
    return joined.withColumn("kind", F.coalesce("__hint", inferred)).drop("__hint")


def category_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All distinct known values as rows (name, value)."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]
    )
    return df.select(F.inline(pairs)).filter(F.col("value").isNotNull()).distinct()


def category_lists(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(name, position, value): all distinct known values of each column in their order, from position 1.

    Values are rows, so a column may have any number of them.
    """
    values = cut_lineage(category_values(df, columns), "categories")
    return running(values, ["name"], ["value"], {"position": ("sum", F.lit(1).cast("long"))}).select("name", "position", "value")


def _bound(end: str) -> Column:
    whole = F.col("data_type").isin("tinyint", "smallint", "int", "bigint")
    text = F.when(whole, F.col(end).cast("bigint").cast("string")).otherwise(F.col(end).cast("string"))
    return F.coalesce(text, F.lit("nan"))


def profile_lines(df: DataFrame, metadata: DataFrame | None = None, target: str | None = None) -> DataFrame:
    """(name, kind, description, position, line): what a reader needs to know about each input column.

    Position 0 is the line of the column: its description, and its range if it is numeric. The categories of a column
    follow as lines of their own from position 1, all of them, in their order.
    """
    inputs = df.drop(target) if target else df
    spark = df.sparkSession
    if metadata is None:
        metadata = spark.createDataFrame([], "name string, type string, description string, context string")
    kinds = cut_lineage(infer_kinds(column_statistics(inputs), metadata), "kinds")
    told = describe_columns(kinds, metadata).drop("type")
    # one row per column of the table
    listed_columns = [r["name"] for r in told.filter(F.col("kind") == "categorical").select("name").collect()]
    listed = F.lit(" (categorical variable with categories)")
    ranged = F.concat(
        F.lit(" (numerical variable within range ["), _bound("low"), F.lit(", "), _bound("high"), F.lit("])")
    )
    tail = F.when(F.col("kind") == "categorical", listed).otherwise(ranged)
    head = told.select(
        "name", "kind", "description", F.lit(0).cast("long").alias("position"),
        F.concat(F.lit("- "), "name", F.lit(": "), "description", tail).alias("line"),
    )
    if not listed_columns:
        return head
    values = category_lists(inputs, listed_columns)
    of_column = F.broadcast(told.select("name", "kind", "description"))  # one row per column of the table
    return head.unionByName(values.join(of_column, "name").select("name", "kind", "description", "position", F.col("value").alias("line")))
