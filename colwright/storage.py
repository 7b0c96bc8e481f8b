"""Where intermediate tables go: the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_DIR_KEY = "spark.checkpoint.dir"
#: Label and path of the tables written in the innermost ``scratch`` block.
_written: ContextVar[list[tuple[SparkSession, str, str]] | None] = ContextVar("written", default=None)


def shared_dir(spark: SparkSession) -> str | None:
    """The folder for written intermediates that the session names, or None."""
    configured = spark.conf.get(_DIR_KEY, None)
    return configured.rstrip("/") if configured else None


def new_path(spark: SparkSession, label: str) -> str:
    """A path for a table that a query writes: in the shared folder, else in the session's warehouse."""
    folder = shared_dir(spark) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/colwright"
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, label: str = "step", row_group_bytes: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of it.

    The written table survives lost executors, its columns can be pruned by later readers, and its size is known to
    the planner: a join with it is broadcast only when the files are below ``spark.sql.autoBroadcastJoinThreshold``.
    Smaller row groups let readers split files further, for tables whose rows are costly to process.

    A session without a shared folder keeps the lineage: the result is persisted on the executors' disks and computed
    again if they are lost.
    """
    spark = df.sparkSession
    if shared_dir(spark) is None:
        return df.persist(StorageLevel.DISK_ONLY)
    path = new_path(spark, label)
    writer = df.write
    if row_group_bytes:
        writer = writer.option("parquet.block.size", row_group_bytes)
    writer.parquet(path)
    if (block := _written.get()) is not None:
        block.append((spark, label, path))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(*kept: str) -> Iterator[None]:
    """Deletes at the end of the block the tables that ``cut_lineage`` wrote in it, but for those with the labels ``kept``.

    What leaves the block may read kept tables only; they belong to the block around it, if there is one. Persisted tables
    are left to Spark.
    """
    block: list[tuple[SparkSession, str, str]] = []
    token = _written.set(block)
    try:
        yield
    except BaseException:
        kept = ()
        raise
    finally:
        _written.reset(token)
        outer = _written.get()
        for spark, label, path in block:
            if label not in kept:
                files, place = _file_system(spark, path)
                files.delete(place, True)
            elif outer is not None:
                outer.append((spark, label, path))


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def path_exists(spark: SparkSession, path: str) -> bool:
    files, place = _file_system(spark, path)
    return files.exists(place)


def complete_versions(spark: SparkSession, folder: str) -> list[int]:
    """The versions ``version=<n>`` of a table that are written to their end, oldest first."""
    files, place = _file_system(spark, f"{folder}/version=*/_SUCCESS")
    found = files.globStatus(place) or []
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)


def drop_versions(spark: SparkSession, folder: str, keep: int) -> None:
    """Delete all complete versions but the newest ``keep``; the newest always stays."""
    for version in complete_versions(spark, folder)[: -max(keep, 1)]:
        files, place = _file_system(spark, f"{folder}/version={version}")
        files.delete(place, True)
