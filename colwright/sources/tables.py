"""Labelled data tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from colwright.functions import numeric as num

# A time column that is not a feature, and the prefix of stray index columns.
DATE_COLUMN = "date"
STRAY_PREFIX = "Unnamed:"


def clean(df: DataFrame) -> DataFrame:
    """NULL becomes the only missing value: NaN and infinities in floating columns are replaced."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: num.finite(F.col(f"`{c}`")) for c in floats}) if floats else df


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header. Give a schema for large files: without one, the types cost a pass over the data."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return clean(reader.csv(path))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return clean(spark.read.parquet(path))


def target_column(df: DataFrame, target: str | None = None) -> str:
    """The named target, or the last column."""
    return target or df.columns[-1]


def drop_stray_columns(df: DataFrame, prefix: str = STRAY_PREFIX) -> DataFrame:
    return df.select([F.col(f"`{c}`") for c in df.columns if not c.startswith(prefix)])


def split_features(
    df: DataFrame, target: str | None = None, reserved: Sequence[str] = (DATE_COLUMN,)
) -> tuple[DataFrame, DataFrame]:
    """Features without the target and reserved columns, and the target alone."""
    y = target_column(df, target)
    return df.drop(y, *reserved), df.select(F.col(f"`{y}`"))


def fill_missing(df: DataFrame, value: float = 0.0) -> DataFrame:
    """Missing numbers become ``value``."""
    return df.fillna(value)


def as_doubles(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    columns = [c for c in df.columns if c not in keep]
    return df.select(*keep, *[num.finite(F.col(f"`{c}`")).alias(c) for c in columns])
