"""Column metadata in JSON, flat or structured, as rows (name, type, description, context, note)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# The lists of a structured document and the type their entries have by default.
FEATURE_LISTS = {
    "continuous_features": "continuous",
    "categorical_features": "categorical",
    "temporal_features": "datetime",
}

_ENTRY = "struct<name:string,type:string,description:string,context:string,note:string>"
_DOCUMENT = "struct<" + ",".join(f"{name}:array<{_ENTRY}>" for name in FEATURE_LISTS) + ">"


def flat_metadata(documents: DataFrame, column: str, *keys: str) -> DataFrame:
    """Rows of documents that map a column name to its description."""
    entries = F.from_json(F.col(column), "map<string,string>")
    rows = documents.select(*keys, F.explode(entries).alias("name", "description"))
    return rows.select(
        *keys,
        "name",
        F.lit(None).cast("string").alias("type"),
        "description",
        F.lit(None).cast("string").alias("context"),
        F.lit(None).cast("string").alias("note"),
    )


def structured_metadata(documents: DataFrame, column: str, *keys: str) -> DataFrame:
    """Rows of documents with a list per feature role; unnamed entries are skipped."""
    parsed = documents.select(*keys, F.from_json(F.col(column), _DOCUMENT).alias("__doc"))
    out = None
    for field, kind in FEATURE_LISTS.items():
        rows = parsed.select(*keys, F.inline(F.col(f"__doc.{field}"))).filter(
            F.coalesce(F.col("name"), F.lit("")) != ""
        )
        rows = rows.select(
            *keys,
            "name",
            F.coalesce("type", F.lit(kind)).alias("type"),
            F.coalesce("description", F.lit("")).alias("description"),
            F.coalesce("context", F.lit("")).alias("context"),
            "note",
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def metadata_rows(documents: DataFrame, column: str, *keys: str) -> DataFrame:
    """Flat and structured documents together; a document is structured if it has one of the feature lists."""
    fields = F.coalesce(F.json_object_keys(F.col(column)), F.array().cast("array<string>"))
    listed = F.arrays_overlap(fields, F.array(*[F.lit(f) for f in FEATURE_LISTS]))
    return structured_metadata(documents.filter(listed), column, *keys).unionByName(
        flat_metadata(documents.filter(~listed), column, *keys)
    )


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per file."""
    return metadata_rows(spark.read.text(path, wholetext=True), "value")
