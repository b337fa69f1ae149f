"""Change tracking: change-only writes, tombstones, stubs, content addressed re-use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """id, change (added, removed, changed, same) by id and hash."""
    o, n = old.select("id", F.col("hash").alias("was"), F.lit(True).alias("o")), new.select("id", F.col("hash").alias("now"), F.lit(True).alias("n"))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "changed").otherwise("same")
    return o.join(n, "id", "full").select("id", change.alias("change"))


def archive(rows: DataFrame, gone: DataFrame, reason: str) -> tuple[DataFrame, DataFrame]:
    """Live rows, and those listed in gone (column id) with the reason for it."""
    ids = gone.select("id").distinct()
    return rows.join(ids, "id", "left_anti"), rows.join(ids, "id", "left_semi").withColumn("archive_reason", F.lit(reason))


def stubs(nodes: DataFrame, have: DataFrame) -> DataFrame:
    """id, body: a first text for nodes that `have` (column id) does not list."""
    body = F.concat(F.lit("# "), "name", F.lit("\nkind: "), "kind")
    return nodes.join(have.select("id").distinct(), "id", "left_anti").select("id", body.alias("body"))
