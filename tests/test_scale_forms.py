"""Queries in forms whose memory, disk and tasks do not follow from one table or key: what they give, and how they are run."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem pages".split()
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def equals_sql(spark, name):
    import duckdb

    import __spark_entry__ as e

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = e.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({e.oracle_sql()[name]}) x").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, want))
    return got


@needs_tables
def test_caveat_histogram_sends_no_list_of_targets(spark):
    plan = plan_of(equals_sql(spark, "caveat_histogram"))
    assert "NestedLoop" not in plan and "LeftAnti" not in plan


def test_unclaimed_is_not_in(spark):
    from lodestone.operators import claims

    def n(targets, nodes):
        marks = [(t, 1, 0) for t in targets] + [(i, 0, 1) for i in nodes]
        return [x.n for x in claims.unclaimed(spark.createDataFrame(marks, "id string, claim int, node int")).collect()]

    assert n(["a", "a", "x"], ["a", "b", "b", "c", None]) == [3]
    assert n(["a", None], ["a", "b", None]) == []
    assert n([], ["a", None]) == [2]
    assert n([], []) == [] and n(["a"], ["a"]) == []


def test_one_key_is_spread_over_tasks(spark):
    from lodestone.plans.lookup_queries import spread_join

    left = spark.range(200).select(F.col("id").alias("ask"), F.lit("k").alias("target"))
    right = spark.range(50).select(F.lit("k").alias("target"), F.col("id"))
    got = spread_join(left, right, "target", "ask")
    assert {(x.ask, x.id) for x in got.collect()} == {(a, b) for a in range(200) for b in range(50)} and got.count() == 10_000
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 1


@needs_tables
def test_pairs_of_routes_travel_no_further(spark):
    assert "LeftAnti" not in plan_of(equals_sql(spark, "route_call_join"))


def test_rounds_of_reexports_carry_each_question_once(spark, monkeypatch):
    from lodestone.operators import resolve

    sizes = []
    plain = resolve.cut
    monkeypatch.setattr(resolve, "cut", lambda df: sizes.append((out := plain(df)).count()) or out)
    imports = [("p", 1, "import_from", "K", "K", "q"), ("q", 1, "import_from", "K", "K", "m::K")] + [(f"m{i}", i, "import_from", "K", "L", "p") for i in range(300)] + [("m0", 400, "import", None, "lib", "external::lib")]
    rows = spark.createDataFrame(imports, "module string, ord int, via string, name string, binding string, target string")
    got = resolve.reexports(rows, spark.createDataFrame([], "module string, name string, id string"), spark.createDataFrame([("p",), ("q",)], "id string"))
    ends = {(x.module, x.target, x.moved) for x in got.collect()}
    assert ends == {("p", "m::K", True), ("q", "m::K", False), ("m0", "external::lib", False)} | {(f"m{i}", "m::K", True) for i in range(300)}
    assert max(sizes) <= 4


def test_pairs_of_one_route_are_made_in_several_tasks(spark, tmp_path):
    from lodestone.plans.text_queries import NEAR_IDS, route_call_join

    ids = [*range(300), *range(NEAR_IDS, NEAR_IDS + 100), 5 * NEAR_IDS + 1]
    rows = [(i, f"http://h/en/{i}") for i in ids] + [(90_000, "http://h"), (90_001, "http://h"), (90_002, None), (90_003, None)]
    spark.createDataFrame(rows, "page_id long, url string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = route_call_join(spark, str(tmp_path))
    want = {(a, b) for a in ids for b in ids if a % 2 == 0 and b % 2 == 1 and b != a + 1 and (a % 3 == 2) == (b % 3 == 2)}
    assert got.count() == len(want) and {(x.call_id, x.endpoint_id) for x in got.collect()} == want
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 1


@needs_tables
def test_call_edges_are_written_step_by_step(spark):
    """What a step shuffles does not stay until the last: no join is left to the result, which reads its inputs no more."""
    plan = plan_of(equals_sql(spark, "call_edges"))
    assert "Join" not in plan and "Exchange" not in plan


@needs_tables
def test_receiver_types_equal_sql(spark):
    equals_sql(spark, "receiver_types")
