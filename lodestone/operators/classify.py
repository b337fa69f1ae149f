"""Rule-based classification with an order of precedence and recorded conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def classify(verdicts: DataFrame) -> DataFrame:
    """id, kind (of the first rule that matched), rule_order, conflicts (later kinds that differ, in order), from rows (id, kind, ord)."""
    first = F.min_by("kind", "ord")
    return (
        verdicts.groupBy("id")
        .agg(first.alias("kind"), F.min("ord").alias("rule_order"), F.array_sort(F.collect_set(F.struct("ord", "kind"))).alias("all"))
        .select("id", "kind", "rule_order", F.array_join(F.array_distinct(F.transform(F.filter("all", lambda x: x["kind"] != F.col("kind")), lambda x: x["kind"])), ",").alias("conflicts"))
    )


def verdicts(nodes: DataFrame, rules: list[tuple[str, DataFrame | Column]]) -> DataFrame:
    """(id, kind, ord): every rule's matches; a rule is a predicate on nodes or a table of ids."""
    out = None
    for k, (kind, rule) in enumerate(rules):
        ids = rule.select("id") if isinstance(rule, DataFrame) else nodes.where(rule).select("id")
        one = ids.distinct().select("id", F.lit(kind).alias("kind"), F.lit(k).alias("ord"))
        out = one if out is None else out.unionByName(one)
    return out


#: Days since the last push up to which a repository is active, and from which it may be dead.
ACTIVE_DAYS, DEAD_DAYS = 7, 180


def dossier_state(exists: Column, status: Column, pinned: Column, current: Column) -> Column:
    """missing, stale, unreviewed, llm_drafted or current; a dossier without a pin is never stale."""
    stale = F.coalesce((pinned != "") & ~pinned.eqNullSafe(current), F.lit(False))
    return (
        F.when(~exists, "missing").when(stale, "stale").when(status == "unreviewed", "unreviewed").when(status.isin("llm_drafted", "stub"), "llm_drafted").otherwise("current")
    )


def activity(age_days: Column, nodes: Column, inbound_edges: Column) -> Column:
    """Class of a repository by the age of its last push, its size and whether anything depends on it."""
    dead = (age_days >= DEAD_DAYS) & (inbound_edges == 0)
    return F.when(nodes == 0, "empty").when(age_days.isNull(), "unknown").when(age_days <= ACTIVE_DAYS, "active").when(dead, "dead-candidate").otherwise("dormant")
