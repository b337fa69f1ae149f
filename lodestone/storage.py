"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one, but only if driver and executors are one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not kept.isDefined() and not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = kept.get() if kept.isDefined() else tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def at_path(spark: SparkSession, path: str):
    """A path and its file system, in the JVM."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


_recording: list[list[DataFrame]] = []


@contextmanager
def recorded(into: list[DataFrame]) -> Iterator[None]:
    """Notes the tables that cut() writes meanwhile, so that a caller can release them all at once."""
    _recording.append(into)
    try:
        yield
    finally:
        _recording.remove(into)


def cut(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder and read back: lineage ends here, and lost executors cost nothing.

    An RDD checkpoint would compute df twice and write it uncompressed. The table goes by release(), or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lodestone-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where, system = at_path(spark, path)
    system.deleteOnExit(where)
    table = spark.read.schema(df.schema).parquet(path)
    table._cut_at = path
    for tables in _recording:
        tables.append(table)
    return table


def release(*tables: DataFrame) -> None:
    """Deletes tables that cut() returned, once nothing will read them again; those that are gone already do not matter."""
    for table in tables:
        where, system = at_path(table.sparkSession, table._cut_at)
        system.delete(where, True)


def collect_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing holds any more: it does when the driver's JVM collects garbage, which an idle driver puts off."""
    gc.collect()
    spark._jvm.System.gc()
