"""Classification of code primitives by seven rules in order, and the caveats of what extraction cannot see.

Primitives: id, primitive, name, path, decorators (array), returns_jsx, method, route, kind (set by an extractor, or null).
Edges: src, dst, kind, via. Every rule is a filter or a semi join; only service and util follow calls (a closure).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.storage import cut

from .traverse import closure

#: The rules in their order, edges that are side effects, and bases of validated models.
KINDS = ("test", "hook", "component", "endpoint", "model", "service", "util")
SIDE_EFFECTS = ("db_access", "queue_produce", "webhook_publish", "notification_send", "file_storage_access")
VALIDATED_BASES = ("BaseModel", "RootModel")


@dataclass(frozen=True)
class Cues:
    """What frameworks call things."""

    routes: tuple[str, ...] = ()
    bases: tuple[str, ...] = ()
    hooks: tuple[str, ...] = ()
    links: tuple[str, ...] = ("__tablename__",)


def _last(column: str, mark: str) -> Column:
    return F.substring_index(column, mark, -1)


def _with_edges(prims: DataFrame, edges: DataFrame) -> DataFrame:
    return prims.join(edges.select(F.col("src").alias("id")).distinct(), "id", "left_semi")


def test_functions(prims: DataFrame, edges: DataFrame) -> DataFrame:
    """Functions with a tests edge, a pytest decorator, or a test's name in a test's file."""
    file = _last("path", "/")
    in_file = file.startswith("test_") | file.endswith("_test.py") | file.contains(".test.")
    by_itself = prims.where(F.exists("decorators", lambda x: x.startswith("pytest.")) | (in_file & F.col("name").startswith("test")))
    return by_itself.select("id").unionByName(_with_edges(prims, edges.where("kind = 'tests'")).select("id")).distinct()


def hooks(prims: DataFrame, edges: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """use<Capital> functions that call a known hook."""
    known = edges.where("kind = 'calls'").where(F.col("dst").isin([f"external::npm::react::{n}" for n in names]))
    return _with_edges(prims.where(_last("name", ".").rlike("^use[A-Z]")), known).select("id")


def components(prims: DataFrame) -> DataFrame:
    """Functions with a capital first letter that return markup."""
    return prims.where(_last("name", ".").rlike(r"^\p{Lu}") & F.col("returns_jsx")).select("id")


def endpoints(prims: DataFrame, routes: tuple[str, ...]) -> DataFrame:
    """Functions under a route decorator."""
    return prims.where(F.arrays_overlap("decorators", F.array(*map(F.lit, routes)).cast("array<string>"))).select("id")


def models(classes: DataFrame, edges: DataFrame, schemas: DataFrame, cues: Cues) -> DataFrame:
    """Classes that extend a mapper's base and are linked to a schema; those that an extractor called schema are not looked at."""
    extends = edges.where("kind = 'extends'").where(_last("dst", "::").isin(*cues.bases))
    linked = edges.where("kind = 'references'").where(F.col("via").isin(*cues.links)).join(schemas.select(F.col("id").alias("dst")), "dst", "left_semi")
    return _with_edges(_with_edges(classes, extends), linked).select("id")


def _decided(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("id").agg(F.min_by("kind", "ord").alias("kind"))


def classify_corpus(prims: DataFrame, edges: DataFrame, cues: Cues) -> DataFrame:
    """id, kind (null if no rule matches), rule_order (0: the extractor's), conflicts (later kinds that differ, in order).

    A rule that confirms the kind already given takes its place, and conflicts up to there are forgotten.
    """
    # Each is read by every rule; verdicts are written as they grow, so that no rule works out another again.
    prims, edges = cut(prims), cut(edges)
    functions = prims.where("primitive = 'function'")
    schemas = prims.where("kind = 'schema'")
    classes = prims.where("primitive = 'class' AND kind IS DISTINCT FROM 'schema'")
    calls = edges.where("kind = 'calls'").select("src", "dst")
    verdicts = prims.where("kind <> ''").select("id", "kind", F.lit(0).alias("ord"))
    found = (test_functions(functions, edges), hooks(functions, edges, cues.hooks), components(functions), endpoints(functions, cues.routes), models(classes, edges, schemas, cues))
    for k, (kind, ids) in enumerate(zip(KINDS, found, strict=False), 1):
        verdicts = verdicts.unionByName(ids.select("id", F.lit(kind).alias("kind"), F.lit(k).alias("ord")))
    verdicts = cut(verdicts)
    entries = _decided(verdicts).where("kind = 'endpoint'").select("id")
    reached = closure(entries, calls).select(F.col("node").alias("id"))
    acting = _with_edges(functions, edges.where(F.col("kind").isin(*SIDE_EFFECTS))).select("id")
    services = acting.join(reached, "id", "left_semi").join(entries, "id", "left_anti")
    verdicts = verdicts.unionByName(services.select("id", F.lit("service").alias("kind"), F.lit(6).alias("ord")))
    verdicts = cut(verdicts)
    known = _decided(verdicts).select("id")
    below = closure(known, calls, barrier=known).select(F.col("node").alias("id")).join(known, "id", "left_anti")
    utils = functions.select("id").join(below, "id", "left_semi")
    verdicts = verdicts.unionByName(utils.select("id", F.lit("util").alias("kind"), F.lit(7).alias("ord")))
    # At most eight rows an id.
    got = verdicts.groupBy("id").agg(F.min_by("kind", "ord").alias("kind"), F.array_sort(F.collect_list(F.struct("ord", "kind"))).alias("all"))
    got = got.withColumn("rule_order", F.array_max(F.transform(F.filter("all", lambda x: x["kind"] == F.col("kind")), lambda x: x["ord"])))
    later = F.filter("all", lambda x: (x["kind"] != F.col("kind")) & (x["ord"] > F.col("rule_order")))
    got = got.select("id", "kind", "rule_order", F.array_join(F.transform(later, lambda x: x["kind"]), ",").alias("conflicts"))
    return prims.select("id").join(got, "id", "left").withColumn("conflicts", F.coalesce("conflicts", F.lit("")))


def effective_kind(decided: Column, extracted: Column) -> Column:
    """The decision's kind, else the extractor's, else none."""
    return F.coalesce(decided, extracted)


def caveats(prims: DataFrame, edges: DataFrame) -> DataFrame:
    """id, caveats (sorted, different): what the graph does not show of a primitive; those without any are absent."""
    extends = edges.where("kind = 'extends'").select("src", "dst")
    bases = extends.where(_last("dst", "::").isin(*VALIDATED_BASES)).select(F.col("dst").alias("id"))
    heirs = closure(bases, extends.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    below = extends.join(heirs.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
    unseen = edges.where("via = 'method_call'").where(F.col("dst").startswith("external::unresolved::"))
    parts = (
        (prims.where("primitive = 'class'").join(below, "id", "left_semi"), "pydantic_refs_not_extracted"),
        (prims.where("primitive = 'function' AND method <> '' AND route <> ''"), "fastapi_depends_chain_not_traced"),
        (_with_edges(prims, unseen), "typed_receiver_unresolved"),
    )
    rows = None
    for ids, name in parts:
        one = ids.select("id", F.lit(name).alias("caveat"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("id").agg(F.array_sort(F.collect_set("caveat")).alias("caveats"))
