"""Ranking of candidate processes by seven signals, each a table (signal, anchor, confidence, fan_out).

Nodes: id, kind (or null), path. Edges: src, dst (src depends on dst), repeats count. covered: ids (column id) that
some process owns already. Reach is kept as (start, node, depth) and never leaves the cluster.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.scalars import included
from lodestone.storage import cut

from .traverse import reach


@dataclass(frozen=True)
class Shape:
    """What a project's entry points and sinks are. The defaults of a web service."""

    entries: tuple[str, ...] = ("endpoint",)
    sinks: tuple[str, ...] = ("model",)
    methods: tuple[str, ...] = ("POST", "PUT", "DELETE", "PATCH")
    not_headless: tuple[str, ...] = ("endpoint", "component", "test", "hook", "schema", "model")
    weights: tuple[tuple[str, float], ...] = (("model", 1.0), ("hook", 0.85), ("service", 0.65), ("schema", 0.45))
    tests: tuple[str, ...] = ("**/tests/**", "**/*.test.ts", "**/*.test.tsx", "**/*.spec.ts", "**/*.spec.tsx", "**/test_*.py", "**/*_test.py")
    pages: tuple[str, ...] = ("**/page.tsx", "**/page.jsx")
    clients: tuple[str, ...] = ("**/lib/api.ts", "**/lib/api-client.ts", "**/lib/client.ts", "**/api_client.py", "**/client.py")


#: Kinds that alone make no flow; bounds on how many entry points converge.
TRIVIAL, CONVERGE = ("test", "component", "schema", "route_call"), (3, 15)


def _candidate(signal: str | Column, anchor: str, confidence: Column, fan_out: str) -> list[Column]:
    name = F.lit(signal) if isinstance(signal, str) else signal
    return [name.alias("signal"), F.col(anchor).alias("anchor"), F.bround(F.least(F.lit(1.0), confidence), 6).alias("confidence"), F.col(fan_out).cast("long").alias("fan_out")]


def _free(df: DataFrame, column: str, covered: DataFrame) -> DataFrame:
    return df.join(covered.select(F.col("id").alias(column)), column, "left_anti")


def covered_ids(claimed: DataFrame, flows: DataFrame, nodes: DataFrame, edges: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """id: what steps claim (column id) or flows name (id, role), and two hops on from their entry points in the corpus."""
    claimed_entries = claimed.join(nodes.where(F.col("kind").isin(*shape.entries)), "id", "left_semi").select("id")
    entries = claimed_entries.unionByName(flows.where("role = 'endpoint'").select("id")).distinct()
    onward = reach(entries.join(nodes, "id", "left_semi"), edges, 2).where("depth > 0").select(F.col("node").alias("id"))
    return claimed.select("id").unionByName(flows.select("id")).unionByName(onward).distinct()


def rule_shape(claims: DataFrame, nodes: DataFrame, covered: DataFrame) -> DataFrame:
    """Rules (rule, id) whose claims span three kinds or more and are not all covered."""
    c = claims.join(nodes.select("id", "kind"), "id", "left").join(covered.select("id", F.lit(True).alias("owned")), "id", "left")
    c = c.groupBy("rule").agg(F.countDistinct("kind").alias("k"), F.count("*").alias("n"), F.every(F.coalesce("owned", F.lit(False))).alias("all_owned"))
    return c.where("k >= 3 AND NOT all_owned").select(_candidate("rule_shape_mismatch", "rule", 0.6 + 0.1 * (F.col("k") - 3), "n"))


def fan_in(nodes: DataFrame, edges: DataFrame, covered: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """Entry points that three kinds or more depend on."""
    entries = _free(nodes.where(F.col("kind").isin(*shape.entries)).select(F.col("id").alias("dst")), "dst", covered)
    into = edges.join(entries, "dst").join(nodes.select(F.col("id").alias("src"), "kind"), "src", "left")
    into = into.groupBy("dst").agg(F.countDistinct("kind").alias("k"), F.count("*").alias("n")).where("k >= 3")
    return into.select(_candidate("entrypoint_fan_in", "dst", 0.55 + 0.1 * (F.col("k") - 3) + F.least(F.lit(0.2), F.col("n") / 100), "n"))


def mutating_reach(nodes: DataFrame, edges: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """start, node, depth within two hops of the entry points that change state (their ids lead with the method, if any)."""
    entries = nodes.where(F.col("kind").isin(*shape.entries))
    if shape.methods:
        entries = entries.where(~F.col("id").contains("::") | F.split_part("id", F.lit("::"), F.lit(1)).isin(*shape.methods))
    return reach(entries.select("id"), edges, 2).where("depth > 0")


def forward_reach(reached: DataFrame, nodes: DataFrame, covered: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """Entry points that reach three kinds or two sinks, two kinds of them not trivial."""
    r = reached.join(nodes.select(F.col("id").alias("node"), "kind"), "node", "left")
    solid = F.when(~F.col("kind").isin(*TRIVIAL), F.col("kind"))
    r = r.groupBy("start").agg(F.countDistinct("kind").alias("k"), F.countDistinct(solid).alias("solid"), F.count_if(F.col("kind").isin(*shape.sinks)).alias("sinks"), F.count("*").alias("n"))
    r = _free(r.where("(k >= 3 OR sinks >= 2) AND solid >= 2"), "start", covered)
    return r.select(_candidate("endpoint_forward_reach", "start", 0.55 + 0.1 * (F.col("k") - 3) + 0.15 * F.greatest(F.lit(0), F.col("sinks") - 1), "n"))


def convergence(reached: DataFrame, nodes: DataFrame, covered: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """Nodes of a weighted kind that a handful of entry points reach."""
    n = reached.groupBy(F.col("node").alias("id")).agg(F.count("*").alias("n")).where(F.col("n").between(*CONVERGE))
    weight = F.coalesce(*[F.when(F.col("kind") == kind, F.lit(w)) for kind, w in shape.weights])
    n = _free(n.join(nodes.select("id", "kind", weight.alias("w")).where("w IS NOT NULL"), "id"), "id", covered)
    near = F.greatest(F.lit(0.3), 1 - F.abs(F.col("n") - 5) / 12)
    return n.select(_candidate(F.concat(F.lit("convergence_on_"), F.col("kind")), "id", F.col("w") * near, "n"))


def _touched(starts: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int, shape: Shape) -> DataFrame:
    """start, entries and sinks (numbers reached), nearest (depth of the nearest entry point), n (all reached)."""
    r = reach(starts.select("id"), edges, depth).where("depth > 0").join(nodes.select(F.col("id").alias("node"), "kind"), "node", "left")
    entry = F.coalesce(F.col("kind").isin(*shape.entries), F.lit(False))
    return r.groupBy("start").agg(F.count_if(entry).alias("entries"), F.count_if(F.col("kind").isin(*shape.sinks)).alias("sinks"), F.min(F.when(entry, F.col("depth"))).alias("nearest"), F.count("*").alias("n"))


def initiated(nodes: DataFrame, edges: DataFrame, covered: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """Pages and hooks that reach both an entry point and a sink within four hops."""
    page = (F.col("kind") == "component") & included(F.coalesce("path", F.lit("")), list(shape.pages), [])
    starts = _free(nodes.where(page | (F.col("kind") == "hook")), "id", covered)
    got = _touched(starts, nodes, edges, 4, shape).where("entries > 0 AND sinks > 0").join(starts.select(F.col("id").alias("start"), (F.col("kind") == "hook").alias("hook")), "start")
    signal = F.when(F.col("hook"), "hook_initiated_flow").otherwise("page_initiated_flow")
    base = F.when(F.col("hook"), 0.55).otherwise(0.75)
    got = got.withColumn("fan", F.col("entries") + F.col("sinks"))
    return got.select(_candidate(signal, "start", base + 0.1 * F.greatest(F.lit(0), 3 - F.col("nearest")), "fan"))


def headless(nodes: DataFrame, edges: DataFrame, covered: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """Nodes that nothing depends on and that reach a sink within three hops: jobs, workers, handlers."""
    starts = nodes.where(~F.coalesce("kind", F.lit("")).isin(*shape.not_headless)).where(included(F.coalesce("path", F.lit("")), [], [*shape.tests, *shape.clients]))
    starts = _free(starts, "id", covered).join(edges.select(F.col("dst").alias("id")), "id", "left_anti")
    got = _touched(starts, nodes, edges, 3, shape).where("sinks > 0")
    return got.select(_candidate("headless_initiated_flow", "start", 0.6 + 0.05 * F.col("sinks") + F.when(F.col("entries") > 0, 0.1).otherwise(0.0), "n"))


def candidates(claims: DataFrame, nodes: DataFrame, edges: DataFrame, covered: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """All signals; take the best by (confidence, fan_out), both descending."""
    # Each is read by several signals.
    nodes, edges, covered = cut(nodes), cut(edges), cut(covered)
    reached = cut(mutating_reach(nodes, edges, shape))
    out = rule_shape(claims, nodes, covered)
    for one in (fan_in(nodes, edges, covered, shape), forward_reach(reached, nodes, covered, shape), convergence(reached, nodes, covered, shape), initiated(nodes, edges, covered, shape), headless(nodes, edges, covered, shape)):
        out = out.unionByName(one)
    return out
