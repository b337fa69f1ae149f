"""Dense row numbers without a window over the whole table, and the refresh of some nodes' rows in a numbered index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.storage import cut


def numbered(df: DataFrame, *order: str, name: str = "row") -> DataFrame:
    """df with dense numbers from 0 in the order of some columns, which must tell rows apart.

    Rows are dealt by ranges of the order and written with their range's number; a window numbers the rows of each range, and the sums of the
    ranges before it, one row a range, are added. So no task sees more than a range.
    """
    dealt = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(W.partitionBy("_range").orderBy(*order)) - 1
    # One row a range: as many as the session has shuffle partitions.
    return dealt.withColumn("_own", own).join(F.broadcast(before), "_range").select(*df.columns, (F.col("_before") + F.col("_own")).alias(name))


def refreshed(index: DataFrame, fresh: DataFrame, gone: DataFrame, key: str, *order: str, name: str = "row") -> DataFrame:
    """index without the rows of the keys of fresh and gone, with those of fresh, numbered anew."""
    keys = fresh.select(key).unionByName(gone.select(key)).distinct()
    stay = index.drop(name).join(keys, key, "left_anti").select(*fresh.columns)
    return numbered(stay.unionByName(fresh), *order, name=name)
