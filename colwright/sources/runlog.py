"""Tables of a search run: candidate log, candidate records, prompts, island statistics and reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamReader

from colwright.functions.programs import code_lines
from colwright.operators.ordered import running
from colwright.storage import cut_lineage

LOG_SCHEMA = (
    "run_id string, split int, sample_order long, timestamp long, prompt_id string, "
    "generated_program string, score double"
)

# Columns of the run tables.
RUN_TABLES = {
    "proposals": (
        "global_step", "split_id", "island_id", "score", "sample_time", "evaluate_time", "cluster_signature",
        "cluster_reduced_score", "function_str", "prompt_id", "head_type", "version_generated",
    ),
    "prompts": (
        "prompt_step", "split_id", "island_id", "prompt_id", "version_generated", "head_type", "num_samples",
    ),
    "pre_reseed": ("global_step", "island_id", "num_clusters", "mean_score", "variance", "best_score"),
    "best_updates": ("island_id", "updated_score", "global_step"),
    "reseeds": ("global_step", "island_id_updated", "island_id_seed", "seed_score"),
}


def append_log(candidates: DataFrame, path: str) -> None:
    """Append candidates as JSON lines under run and split; only the assigning code lines are kept.

    Lines of a run and split meet before they are written, so files grow in number with the bytes, not with the tasks.
    """
    rows = candidates.withColumn("generated_program", code_lines(F.col("generated_program")))
    fields = ("run_id", "split", "sample_order", "timestamp", "prompt_id", "generated_program", "score")
    by_file(rows.select(*fields)).write.mode("append").partitionBy("run_id", "split").json(path)


def by_file(rows: DataFrame) -> DataFrame:
    """Rows of a run and split side by side; adaptive execution joins small groups and splits large ones."""
    return rows.hint("rebalance", F.col("run_id"), F.col("split"))


_BROKEN = "_corrupt_record"


def logged_lines(reader: DataFrameReader | DataStreamReader, path: str) -> DataFrame:
    """The lines of a log in its schema, with the text of those that do not fit it in a column of its own."""
    return reader.schema(f"{LOG_SCHEMA}, {_BROKEN} string").option("columnNameOfCorruptRecord", _BROKEN).json(path)


def refused_line(rows: DataFrame) -> Column:
    """The text of a line that is no JSON, holds a value of another type or has no program index; NULL for others."""
    again = F.to_json(F.struct(*[c for c in rows.columns if c != _BROKEN]))
    bad = F.col(_BROKEN).isNotNull() | F.col("sample_order").isNull()
    return F.when(bad, F.coalesce(F.col(_BROKEN), again))


def read_log(spark: SparkSession, path: str, malformed: str = "raise") -> DataFrame:
    """The candidate log; ``sample_order`` is the stored program index, blank lines are skipped.

    A line that is no JSON, holds a value of another type, or has no program index stops the job; with
    ``malformed="skip"`` it is left out, and ``malformed_lines`` lists it.
    """
    rows = logged_lines(spark.read, path)
    broken = F.col(_BROKEN).isNotNull() | F.col("sample_order").isNull()
    if malformed == "skip":
        return rows.filter(~broken).drop(_BROKEN)
    told = F.concat(F.lit("malformed log line: "), F.coalesce(_BROKEN, F.lit("no sample_order")))
    return rows.filter(F.when(broken, F.raise_error(told).cast("boolean")).otherwise(True)).drop(_BROKEN)


def malformed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, split, line) of the lines that ``read_log`` refuses; lines without a program index show as JSON again."""
    rows = logged_lines(spark.read, path)
    return rows.select("run_id", "split", refused_line(rows).alias("line")).filter(F.col("line").isNotNull())


def write_candidates(candidates: DataFrame, path: str) -> None:
    """Records (sample_order, island_id, cluster_signature, function, score) as one data set."""
    signature = F.try_element_at("signature", F.lit(1)).alias("cluster_signature")
    candidates.select("run_id", "sample_order", "island_id", signature, "function", "score").write.mode(
        "append"
    ).partitionBy("run_id").parquet(path)


def write_run_table(rows: DataFrame, name: str, path: str) -> None:
    """Append rows to one of the run tables."""
    rows.select(*RUN_TABLES[name]).write.mode("append").parquet(f"{path}/{name}")


def read_run_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}").select(*RUN_TABLES[name])


def write_reviews(reviews: DataFrame, path: str) -> None:
    reviews.select(
        "run_id", "program_index", "feature_name", "code_snippet", "classification", "reasoning"
    ).write.mode("append").json(path)


def new_candidates(candidates: DataFrame, logged: DataFrame | None = None) -> DataFrame:
    """First record per (run, sample order), without those that are already logged."""
    key = ["run_id", "sample_order"]
    rest = [c for c in candidates.columns if c not in key]
    first = candidates.groupBy(*key).agg(
        F.min_by(F.struct(*rest), F.struct("timestamp", "prompt_id")).alias("__r")
    )
    out = first.select(*key, "__r.*").select(*candidates.columns)
    return out if logged is None else out.join(logged.select(*key).distinct(), key, "left_anti")

# Fields of a plain log line, and the name of a plain log file.
_LINE = "timestamp long, prompt_id string, generated_program string, score double"
_FILE = r"^(.*)_split_(\d+)_(\d+)\.jsonl$"


def read_plain_logs(spark: SparkSession, path: str) -> DataFrame:
    """Logs of one file per run and split, named ``<run>_split_<i>_<time>.jsonl``, in the log's schema.

    The program index is the line number in the file, blank lines counted. Lines are numbered by their place in the
    file's blocks and written once, so the numbers hold for all later reads. Files of one name in different folders are
    numbered apart. A malformed line stops the job.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("place"),
    )
    counted = {"__line": ("sum", F.lit(1).cast("long"))}
    numbered = running(cut_lineage(lines, "lines"), ["path"], ["start", "place"], counted)
    parsed = numbered.filter(F.rlike("value", F.lit(r"\S"))).select(
        F.regexp_extract("file", _FILE, 1).alias("run_id"),
        F.regexp_extract("file", _FILE, 2).try_cast("int").alias("split"),
        (F.col("__line") - 1).alias("sample_order"),
        F.from_json("value", _LINE, {"mode": "FAILFAST"}).alias("r"),
    )
    return parsed.select("run_id", "split", "sample_order", "r.*")
