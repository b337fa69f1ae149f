"""Session settings shared by the library, the tests and the bench."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = 8, memory: str = "12g", partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; on a cluster use the submitted one."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lodestone")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test star schema; read by Spark alone, so any store will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
