"""Joins in time against loops over all pairs, with one key that holds most rows."""

import datetime as dt
import random

from pyspark.sql import functions as F

from lodestone.operators import timejoin

START = dt.datetime(2024, 1, 1)


def rows(n, seed):
    r = random.Random(seed)
    return [(r.choice([7, 7, 7, 1, None]), i, START + dt.timedelta(seconds=r.randint(0, 300_000)) if r.random() < 0.97 else None, r.random() < 0.4) for i in range(n)] + [(7, 9000, START, True), (7, 9001, START + dt.timedelta(seconds=600), False)]


def test_pairs_within_a_span(spark):
    got = rows(250, 1)
    df = spark.createDataFrame(got, "k int, i int, t timestamp, mark boolean").repartition(4)
    other = df.select("k", F.col("i").alias("j"), F.col("t").alias("u"))
    for strict in (False, True):
        want = sorted((a[1], b[1]) for a in got for b in got if None not in (a[0], a[2], b[2]) and a[0] == b[0] and (0 < (b[2] - a[2]).total_seconds() if strict else 0 <= (b[2] - a[2]).total_seconds()) and (b[2] - a[2]).total_seconds() <= 600)
        assert sorted((x.i, x.j) for x in timejoin.within(df, other, "k", "t", "u", 600, strict).collect()) == want


def test_last_mark_before_each_event(spark):
    got = [x for x in rows(300, 2) if x[2] is not None]
    df = spark.createDataFrame(got, "k int, i int, t timestamp, mark boolean").repartition(4)
    want = {a[1]: max((b[2] for b in got if b[0] == a[0] and b[3] and b[2] <= a[2]), default=None) for a in got}
    for bucket in (60, 86_400, 10_000_000):
        assert {x.i: x.m for x in timejoin.last_before(df, "k", "t", F.col("mark"), "m", bucket).collect()} == want
