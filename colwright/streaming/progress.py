"""Best score, successes and failures per run, kept up to date while the log grows.

The totals are a table with versions, one per batch of the stream. A version counts once it is complete and is never written
again, so a replayed batch changes nothing, and a reader always finds a whole table. Lines that the batch reader
of the log refuses are kept apart, in one folder per batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from colwright.sources.runlog import LOG_SCHEMA, logged_lines, refused_line
from colwright.storage import complete_versions, drop_versions, path_exists

_TOTALS = "run_id string, best_score double, best_step long, successes long, failures long"
_MALFORMED = "run_id string, split int, line string"
#: A line that comes again within this time of its first arrival is the same record.
REPEATS_WITHIN = "7 days"
#: Versions of the totals that stay for readers that have begun with an older one.
KEEP_VERSIONS = 10
#: The keys of ``REPEATS_WITHIN`` are as many as the records, so they are kept on disk, not on the heap, and are not counted on each write.
_ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


def log_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The columns of the log and ``line``: the text of a malformed line, NULL for all others."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = logged_lines(reader, path)
    return rows.select(*spark.createDataFrame([], LOG_SCHEMA).columns, refused_line(rows).alias("line"))


def without_repeats(log: DataFrame, within: str = REPEATS_WITHIN) -> DataFrame:
    """One row per record (run, split, program index), and per different malformed line of a run and split.

    The state holds the keys that arrived in the last ``within``. Arrival is the time of the batch, so no line is ever late.
    """
    seen = log.withColumn("__arrived", F.current_timestamp()).withWatermark("__arrived", within)
    return seen.dropDuplicatesWithinWatermark(["run_id", "split", "sample_order", "line"]).drop("__arrived")


def merged(totals: DataFrame) -> DataFrame:
    """One row per run from any number of partial totals; of equal best scores the first step counts."""
    scored = F.col("best_score").isNotNull()
    best = F.max(F.when(scored, F.struct(F.col("best_score").alias("score"), (-F.col("best_step")).alias("back"))))
    sums = totals.groupBy("run_id").agg(best.alias("b"), F.sum("successes").alias("successes"), F.sum("failures").alias("failures"))
    return sums.select(
        "run_id", F.col("b.score").alias("best_score"), (-F.col("b.back")).alias("best_step"), "successes", "failures"
    )


def progress(log: DataFrame) -> DataFrame:
    """One row per run of the records of a log; a record without a score, or with NaN, is a failure."""
    score = F.when(~F.isnan("score"), F.col("score"))
    single = log.select(
        "run_id",
        score.alias("best_score"),
        F.when(score.isNotNull(), F.col("sample_order")).alias("best_step"),
        score.isNotNull().cast("long").alias("successes"),
        score.isNull().cast("long").alias("failures"),
    )
    return merged(single)


def write_progress(
    log: DataFrame,
    path: str,
    checkpoint: str | None = None,
    once: bool = True,
    repeats_within: str = REPEATS_WITHIN,
    keep: int = KEEP_VERSIONS,
) -> StreamingQuery:
    """Bring the totals at ``path`` up to date after every batch of ``log_stream``.

    A batch costs its own lines and one row per run. ``read_progress`` reads the totals, ``read_malformed`` the refused lines.
    The stream's own state is below ``path`` unless ``checkpoint`` names a folder; batches are numbered by it, so totals of
    another checkpoint are refused.
    """
    spark = log.sparkSession
    state = checkpoint or f"{path}/_checkpoint"
    if complete_versions(spark, f"{path}/totals") and not path_exists(spark, f"{state}/metadata"):
        raise ValueError(f"{path} holds totals that do not belong to the checkpoint {state}")

    def advance(batch: DataFrame, number: int) -> None:
        done = complete_versions(spark, f"{path}/totals")
        if number in done:  # a replayed batch: only the stream's own state is written again
            batch.write.format("noop").mode("overwrite").save()
            return
        batch = batch.persist()
        bad = F.col("line").isNotNull()
        refused = batch.filter(bad).select("run_id", "split", "line")
        refused.write.mode("overwrite").parquet(f"{path}/malformed/batch={number}")
        totals = progress(batch.filter(~bad))
        if done:
            totals = merged(_read_version(spark, path, done[-1]).unionByName(totals))
        # the finished version makes the batch count, and is the last thing written
        totals.write.mode("overwrite").parquet(f"{path}/totals/version={number}")
        batch.unpersist()
        drop_versions(spark, f"{path}/totals", keep)

    fresh = without_repeats(log, repeats_within)
    writer = fresh.writeStream.outputMode("append").option("checkpointLocation", state).foreachBatch(advance)
    # a query takes the settings of its session as it starts; one that goes on keeps those it began with
    before = {name: spark.conf.get(name, None) for name in _ON_DISK}
    for name, value in _ON_DISK.items():
        spark.conf.set(name, value)
    try:
        return (writer.trigger(availableNow=True) if once else writer).start()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _read_version(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(_TOTALS).parquet(f"{path}/totals/version={version}")


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete totals; no rows before the first batch."""
    done = complete_versions(spark, f"{path}/totals")
    return _read_version(spark, path, done[-1]) if done else spark.createDataFrame([], _TOTALS)


def read_malformed(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, split, line, batch) of the lines that were refused so far; a line that repeats in a run and split is listed once."""
    if not complete_versions(spark, f"{path}/totals"):
        return spark.createDataFrame([], f"{_MALFORMED}, batch long")
    return spark.read.schema(f"{_MALFORMED}, batch long").parquet(f"{path}/malformed")
