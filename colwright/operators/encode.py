"""Category codes and the numeric model table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from colwright.functions import numeric as num
from colwright.operators.lookup import map_codes
from colwright.operators.ordered import KEY_ROWS, POS, lay_out
from colwright.storage import cut_lineage


def category_codes(
    df: DataFrame, column: str, fit_on: Column | None = None, with_null: bool = False, key_rows: int = KEY_ROWS
) -> DataFrame:
    """(value, code): distinct values in sorted order, numbered from 0.

    ``with_null`` gives NULL the last code; otherwise NULL has none.
    """
    rows = df if fit_on is None else df.filter(fit_on)
    values = rows.select(F.col(column).alias("value")).distinct()
    known = cut_lineage(values.filter(F.col("value").isNotNull()), "values")
    if known.count() <= key_rows:
        codes = known.select("value", (F.row_number().over(Window.orderBy("value")) - 1).alias("code"))
    else:
        codes = lay_out(known, [], ["value"]).table.select("value", F.col(POS).cast("int").alias("code"))
    if with_null:
        last = values.filter(F.col("value").isNull()).crossJoin(known.agg(F.count(F.lit(1)).cast("int").alias("code")))
        codes = codes.unionByName(last.select("value", "code"))
    return codes


def label_encode(df: DataFrame, column: str, out: str, fit_on: Column | None = None) -> DataFrame:
    """Sorted-order codes; NULL gets the code after the last value, unseen values get -1."""
    codes = cut_lineage(category_codes(df, column, fit_on, with_null=True), "codes")
    known = codes.filter(F.col("value").isNotNull())
    null_code = codes.filter(F.col("value").isNull()).agg(F.max("code").alias("__null_code"))
    coded = map_codes(df, known, column, out).crossJoin(F.broadcast(null_code))
    fixed = F.when(F.col(column).isNull(), F.coalesce("__null_code", F.lit(-1))).otherwise(F.col(out))
    return coded.withColumn(out, fixed).drop("__null_code")


def categorical_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def fit_mappings(df: DataFrame, columns: Sequence[str], fit_on: Column | None = None) -> dict[str, DataFrame]:
    """Codes per column, learned from the training rows only."""
    return {c: cut_lineage(category_codes(df, c, fit_on), "codes") for c in columns}


def mapping_table(mappings: Mapping[str, DataFrame]) -> DataFrame:
    """All mappings as rows (name, value, code)."""
    parts = [m.select(F.lit(c).alias("name"), F.col("value").cast("string"), "code") for c, m in mappings.items()]
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table


def apply_mappings(df: DataFrame, mappings: Mapping[str, DataFrame]) -> DataFrame:
    """Unseen and missing values get -1."""
    for column, codes in mappings.items():
        df = map_codes(df, codes, column, f"__coded_{column}")
    return df.withColumns({c: F.col(f"__coded_{c}") for c in mappings}).drop(*[f"__coded_{c}" for c in mappings])


def model_table(df: DataFrame, mappings: Mapping[str, DataFrame], keep: Sequence[str] = ()) -> DataFrame:
    """All columns but ``keep`` as finite doubles: codes for categories, NULL for missing and infinite numbers."""
    coded = apply_mappings(df, mappings)
    columns = [c for c in df.columns if c not in keep]
    return coded.select(*keep, *[num.finite(F.col(f"`{c}`")).alias(c) for c in columns])


def train_test_tables(
    df: DataFrame, is_train: Column, keep: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """Train and test model tables with the mappings of the training rows."""
    mappings = fit_mappings(df, categorical_columns(df, keep), is_train)
    table = model_table(df.withColumn("__train", is_train), mappings, [*keep, "__train"])
    return (
        table.filter(F.col("__train")).drop("__train"),
        table.filter(~F.col("__train")).drop("__train"),
        mappings,
    )


def impute_for_trees(
    df: DataFrame, columns: Sequence[str], sentinel: float = -999.0
) -> tuple[DataFrame, list[str]]:
    """Missing values as a sentinel plus an indicator column each, for tree models that refuse missing input."""
    filled = {c: F.coalesce(F.col(f"`{c}`"), F.lit(sentinel)) for c in columns}
    flags = {f"{c}__missing": F.col(f"`{c}`").isNull().cast("double") for c in columns}
    return df.withColumns({**flags, **filled}), [*columns, *flags]
