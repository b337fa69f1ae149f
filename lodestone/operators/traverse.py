"""Reachability over an edge table (src, dst): bounded breadth-first search, closures, multi-source reach.

Loops run on the driver, one join a hop; frontiers and visited sets stay distributed. Every hop cuts its
lineage by a table in the session's shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lodestone.storage import cut, release


def walk(seeds: DataFrame, edges: DataFrame, depth: int, reverse: bool = True) -> DataFrame:
    """node, depth, path of everything within `depth` hops of the seeds (column id); the first visit wins.

    Among equally short paths the least one (as text) is kept, so results do not depend on the order of rows.
    """
    at, to = ("dst", "src") if reverse else ("src", "dst")
    step = cut(edges.select(F.col(at).alias("at"), F.col(to).alias("to")).distinct())  # read once, not at every hop
    seen = seeds.select(F.col("id").alias("node"), F.lit(0).alias("depth"), F.col("id").alias("path")).distinct()
    front = seen
    for k in range(1, depth + 1):
        reach = front.join(step, front.node == step.at).select(F.col("to").alias("node"), F.concat_ws(">", "path", "to").alias("path"))
        new = reach.groupBy("node").agg(F.min("path").alias("path")).join(seen.select("node"), "node", "left_anti")
        front = cut(new.select("node", F.lit(k).alias("depth"), "path"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


#: Fronts that are merged into one table; hops after which nodes with one way on get shortcuts; rounds of these (chains up to 2**ROUNDS).
MERGE, PATIENCE, ROUNDS = 4, 8, 24


def _counted(df: DataFrame) -> tuple[DataFrame, int]:
    """df, written once, and its number of rows, observed by that write."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, seen.get["n"]


def shortcuts(step: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """src, dst: from every node with a single way on to what lies 2, 4, 8, ... steps down its chain.

    At most one row a node and round, so a graph gains rounds times its nodes, and a chain is crossed in a logarithm of its length.
    """
    single = step.groupBy("src").agg(F.min("dst").alias("dst"), F.count("*").alias("n")).where("n = 1").select("src", "dst")
    jump, n = _counted(single)
    levels = [jump]
    for _ in range(rounds):
        if not n:
            break
        further, n = _counted(levels[-1].alias("a").join(single.alias("b") if len(levels) == 1 else levels[-1].alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst").where("src <> dst"))
        levels.append(further)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    merged = cut(out.distinct())
    release(*levels)
    return merged


def closure(seeds: DataFrame, edges: DataFrame, barrier: DataFrame | None = None) -> DataFrame:
    """node: everything reachable from the seeds (column id), themselves included; barrier nodes are not entered.

    Hop by hop, each front written once. What has been seen is one table and the last few fronts, so a hop compares with MERGE
    tables at most; after PATIENCE hops chains get shortcuts, so deep graphs take few hops too.
    """
    step = edges.select("src", "dst").distinct()
    if barrier is not None:
        step = step.join(barrier.select(F.col("id").alias("dst")), "dst", "left_anti")
    step = cut(step.select("src", "dst"))
    front = cut(seeds.select(F.col("id").alias("node")).distinct())
    seen, held, ways, hops_ = front, [front], step, 0
    while True:
        new = front.join(ways, front.node == ways.src).select(F.col("dst").alias("node")).distinct()
        front, n = _counted(new.join(seen, "node", "left_anti"))
        if not n:
            release(front, step)
            if ways is not step:
                release(extra)
            return seen
        seen = seen.unionByName(front)
        held.append(front)
        hops_ += 1
        if len(held) > MERGE:
            # The last front is read on its own, too.
            seen = cut(seen)
            release(*held[:-1])
            held = [seen]
        if hops_ == PATIENCE:
            extra = shortcuts(step)
            ways = step.unionByName(extra)


def reach(seeds: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """start, node, depth: for every seed its forward reach, with the first depth."""
    step = cut(edges.select("src", "dst").distinct())
    seen = seeds.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0).alias("depth")).distinct()
    front = seen
    for k in range(1, depth + 1):
        new = front.join(step, front.node == step.src).select("start", F.col("dst").alias("node")).distinct()
        front = cut(new.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(k)))
        seen = seen.unionByName(front)
    return seen


def hops(covered: DataFrame, edges: DataFrame, n: int = 2) -> DataFrame:
    """node, hop: covered nodes (column id) and what they reach in n hops, with the first hop."""
    return walk(covered, edges, n, reverse=False).select("node", F.col("depth").alias("hop"))
