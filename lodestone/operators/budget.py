"""What fits into a bounded answer: the first rows of each group, and blocks within a budget of bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Dependents listed of each depth and certainty; recent issues and their age in hours.
CAP, ISSUES, HOURS = 30, 10, 24


def capped(rows: DataFrame, by: list[str], order: list[str], cap: int = CAP) -> DataFrame:
    """The first rows of each group, with their place and how many more the group has (more)."""
    total = rows.groupBy(*by).agg(F.count("*").alias("total"))
    # Ranked and limited before the totals are joined, so Spark cuts groups ahead of the shuffle.
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= cap)
    return first.join(total, by).withColumn("more", F.greatest(F.col("total") - cap, F.lit(0))).drop("total")


def within_budget(rows: DataFrame, by: list[str], order: str, size: str, budget: int) -> DataFrame:
    """Per group: admitted (orders of the blocks that fit, in order), used (their sizes) and skipped (how many did not).

    Blocks are tried in order; the first always goes in, one that does not fit is skipped and a later, smaller one may
    still go in. Only orders and sizes of a group come together, as numbers.
    """
    blocks = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("long").alias("s")))).alias("blocks"))
    start = F.struct(F.array().cast(rows.select(F.array(order)).schema[0].dataType).alias("admitted"), F.lit(0).cast("long").alias("used"))

    def step(acc: Column, x: Column) -> Column:
        fits = (F.size(acc["admitted"]) == 0) | (acc["used"] + x["s"] <= budget)
        return F.when(fits, F.struct(F.concat(acc["admitted"], F.array(x["o"])).alias("admitted"), (acc["used"] + x["s"]).alias("used"))).otherwise(acc)

    got = blocks.withColumn("got", F.aggregate("blocks", start, step))
    return got.select(*by, "got.admitted", "got.used", (F.size("blocks") - F.size("got.admitted")).alias("skipped"))


def recent_issues(issues: DataFrame, ts: str, key: str, now: Column, hours: int = HOURS, n: int = ISSUES) -> DataFrame:
    """The n latest rows not older than some hours, oldest first."""
    young = issues.where(F.col(ts) >= now - F.make_dt_interval(F.lit(0), F.lit(hours)))
    return young.orderBy(F.desc(ts), F.desc(key)).limit(n).orderBy(ts, key)
