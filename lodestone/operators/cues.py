"""Merging of what plugins know: which of them are active, sets by union, weights by precedence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def active(plugins: DataFrame, enable: DataFrame | None = None, disable: DataFrame | None = None) -> DataFrame:
    """Plugins (scope, plugin, detected) that were detected or enabled (scope, plugin) and not disabled; disabling wins."""
    on = plugins.withColumn("_on", F.col("detected"))
    if enable is not None:
        on = on.join(enable.select("scope", "plugin", F.lit(True).alias("_asked")), ["scope", "plugin"], "left").withColumn("_on", F.coalesce("_asked", "_on")).drop("_asked")
    on = on.where("_on").drop("_on")
    return on if disable is None else on.join(disable.select("scope", "plugin"), ["scope", "plugin"], "left_anti")


def merged(plugins: DataFrame, sets: tuple[str, ...], weights: str = "weights") -> DataFrame:
    """scope, each of sets (sorted union) and weights (of each name the one of the greatest (precedence, plugin)).

    Plugins: scope, plugin, precedence, arrays named by sets, and a map. Entries are exploded and reduced by partial aggregates
    before they meet, so a scope's lists are as long as its different entries.
    """
    base = plugins.select("scope").distinct()
    for name in sets:
        union = plugins.select("scope", F.explode(name).alias("x")).distinct().groupBy("scope").agg(F.array_sort(F.collect_list("x")).alias(name))
        base = base.join(union, "scope", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    each = plugins.select("scope", "plugin", "precedence", F.explode(weights).alias("name", "weight"))
    best = each.groupBy("scope", "name").agg(F.max_by("weight", F.struct("precedence", "plugin")).alias("weight"))
    maps = best.groupBy("scope").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "weight")))).alias(weights))
    return base.join(maps, "scope", "left")
