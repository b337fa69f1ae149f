"""Joins in time without a task that holds a whole key: pairs within a span, and the last event before another.

A key may hold a third of all rows (one busy user), so time is cut into buckets that are part of the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _bucket(ts: str, seconds: int) -> Column:
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (seconds * 1_000_000))


def within(left: DataFrame, right: DataFrame, key: str, at: str, other_at: str, seconds: int, strict: bool = False) -> DataFrame:
    """Pairs of one key (of that name in both) with at <= other_at <= at + seconds; strict: at < other_at.

    Each left row looks into its own bucket of that many seconds and the next; a right row lies in one. So a pair meets
    once, and only rows of neighbouring times meet. Columns but the key must differ in name; rows with a null key or time have no pair.
    """
    l = left.withColumn("_bucket", F.explode(F.array(_bucket(at, seconds), _bucket(at, seconds) + 1)))
    r = right.withColumn("_bucket", _bucket(other_at, seconds))
    gap = F.unix_micros(F.col(other_at).cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))
    near = (gap > 0 if strict else gap >= 0) & (gap <= seconds * 1_000_000)
    return l.join(r, [key, "_bucket"]).where(near).drop("_bucket")


def last_before(events: DataFrame, key: str, at: str, is_mark: Column, name: str, bucket: int = 86_400) -> DataFrame:
    """events, with the time of the key's latest marked event up to each (its own time included), or null.

    A window over (key, bucket) finds it among the bucket's own events; what earlier buckets carry over is one row a bucket, and only
    those are ever ordered by key alone.
    """
    marked = events.withColumn("_mark", is_mark).withColumn("_bucket", _bucket(at, bucket))
    own = W.partitionBy(key, "_bucket").orderBy(at).rangeBetween(W.unboundedPreceding, W.currentRow)
    inside = marked.withColumn("_own", F.max(F.when(F.col("_mark"), F.col(at))).over(own))
    per = marked.groupBy(key, "_bucket").agg(F.max(F.when(F.col("_mark"), F.col(at))).alias("_last"))
    carried = per.withColumn("_carried", F.max("_last").over(W.partitionBy(key).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)))
    same = F.col(f"e.{key}").eqNullSafe(F.col(f"c.{key}")) & F.col("e._bucket").eqNullSafe(F.col("c._bucket"))
    got = inside.alias("e").join(carried.alias("c"), same, "left")
    return got.select(*[F.col(f"e.`{c}`") for c in events.columns], F.coalesce("e._own", "c._carried").alias(name))
