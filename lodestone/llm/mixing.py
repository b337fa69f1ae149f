"""Mixing sources to target weights (operator 7): a multivariate-hypergeometric splitting tree.

Every source is dealt into about sqrt(documents) blocks by a hash. The driver holds one row a source (the
mixture's specification, not its documents): sizes, targets and quotas. A unit is a block in one pass over its source;
a source's quota counts the units that meet its target: all blocks of its whole passes, then the blocks of the rest.
A balanced tree over the output shards splits the quotas: at each node the left half's count of units of every source
is one multivariate hypergeometric draw from what the node holds, so every leaf gets an exact count and all counts sum to
the quota. A source's units in permuted order are then cut at the cumulated leaf counts (disjoint draws): what a leaf
draws is taken, as often as leaves draw it (in a source's last block document by document, and one document more of the source where that comes nearer to the target), and goes to that leaf's shard, where rows are ordered by hash.

Defined cases: a null text has size 0 and is never taken; a null source is a source of its own, last in
order; empty tables give empty results; rows alike in their plain columns are drawn together; a text of any length is
taken whole or not at all; ties of blocks go by their number. The input's columns travel under other names, so they cannot clash with helpers; those
called like a column that mix() adds are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, word_count

#: Weights of the sources in order of their names, repeated.
WEIGHTS = (3, 1, 2)
SHARE, CAP, SEED, SHARDS, PART_WORDS, SOURCES = 1.5, 2.0, 7, 64, 20_000_000, 5_000
ADDED = ("mix_size", "mix_source_size", "mix_target", "mix_taken", "mix_shards")


def targets(sizes: list[int], weights: list[float], total: float, cap: float = CAP) -> list[float]:
    """Shares of total by weight; none above cap times its size, the excess reshared by weight."""
    out, open_, left = [0.0] * len(sizes), list(range(len(sizes))), float(total)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > cap * sizes[i]]
        if not full:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = cap * sizes[i]
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def split_tree(quotas: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Blocks of each source (columns) that each shard (rows) gets; columns sum to quotas exactly."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)
    stack = [(0, shards, np.asarray(quotas, dtype=np.int64))]
    while stack:
        lo, hi, held = stack.pop()
        if hi - lo == 1 or not held.sum():
            out[lo] = held
            continue
        mid = (lo + hi) // 2
        n = int(held.sum()) * (mid - lo) // (hi - lo)
        draw = np.random.Generator(np.random.PCG64([seed, lo, hi]))
        left = draw.multivariate_hypergeometric(held, n, method="marginals")
        stack += [(lo, mid, left), (mid, hi, held - left)]
    return out


def _keyed(docs: DataFrame, source: str, text: str, seed: int) -> DataFrame:
    """All columns under names of their own (c0, c1, ...), mix_key (source), mix_row (hash of the plain columns) and mix_size."""
    plain = [F.col(f"`{f.name}`") for f in docs.schema if f.dataType.simpleString() in ("string", "bigint", "int", "double", "boolean")]
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`")), F.lit("null"))
    own = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    return docs.select(*own, key.alias("mix_key"), F.xxhash64(F.lit(seed), *plain).alias("mix_row"), word_count(f"`{text}`").alias("mix_size"))


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one block (about the root of a source's documents, ids and sizes alone) what still fits, in drawn order."""
    twins = pdf.groupby("mix_row", as_index=False).agg(size=("mix_size", "sum"), room=("room", "first")).sort_values("mix_row")
    room, keep = float(pdf["room"].iloc[0]), []
    for row, size in zip(twins["mix_row"], twins["size"]):
        if 0 < size <= room:
            room -= size
            keep.append(row)
    held = set(keep)
    over = [(abs(room - size), row) for row, size in zip(twins["mix_row"], twins["size"]) if room < size < 2 * room and row not in held]
    if over:  # one more brings the total nearer
        keep.append(min(over)[1])
    return pd.DataFrame({"mix_key": pdf["mix_key"].iloc[0], "mix_row": np.array(keep, dtype=np.int64), "fits": True})


def _drawn(docs: DataFrame, source: str = "source", text: str = "text", share: float = SHARE, cap: float = CAP, weights: tuple = WEIGHTS, seed: int = SEED, shards: int = SHARDS) -> DataFrame:
    """The input's columns as c0, c1, ..., mix_row, and the columns that mix() adds.

    share is the mix's size as a part of all words; weights repeat over the sources by code point, null last.
    A document is taken whole: 0, 1 or cap times at most. In the one block that would overrun a target, documents
    are taken one by one while they still fit; then the one document of the source that closes best what is still missing.
    """
    spark = docs.sparkSession
    slim = cut(_keyed(docs, source, text, seed).select("mix_key", "mix_row", "mix_size"))
    per = slim.groupBy("mix_key").agg(F.sum("mix_size").alias("words"), F.count("*").alias("n")).collect()
    # Python orders str by code point; null is last.
    per = sorted(per, key=lambda r: (r.mix_key == "null", r.mix_key))
    sizes = [r["words"] for r in per]
    goal = targets(sizes, [float(weights[i % len(weights)]) for i in range(len(per))], share * sum(sizes), cap)
    passes = [int(min(cap, g // s)) if s else 0 for g, s in zip(goal, sizes)]
    rest = [max(0.0, g - p * s) for g, p, s in zip(goal, passes, sizes)]
    # One row a source; broadcast only where the sources are few, so that a hot source is not one task's.
    small = F.broadcast if len(per) <= SOURCES else lambda df: df
    rows = [(r.mix_key, s, float(g), p, float(x), max(1, int(r["n"] ** 0.5))) for r, s, g, p, x in zip(per, sizes, goal, passes, rest)]
    spec = spark.createDataFrame(rows, "mix_key string, mix_source_size long, mix_target double, passes long, rest double, nb int")
    block = F.pmod(F.xxhash64(F.lit(seed + 1), "mix_row"), "nb").cast("int").alias("block")
    slim = slim.join(small(spec.select("mix_key", "passes", "rest", "nb")), "mix_key").select("mix_key", "mix_row", "mix_size", "passes", "rest", block)
    sums = slim.groupBy("mix_key", "block", "passes", "rest").agg(F.sum("mix_size").alias("block_words"))
    # Blocks are hash buckets, so the order of their numbers is a random permutation of the source.
    order = W.partitionBy("mix_key").orderBy("block")
    before = F.coalesce(F.sum("block_words").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumns({"room": F.col("rest") - before, "nth": F.row_number().over(order), "blocks": F.count("*").over(W.partitionBy("mix_key"))})
    sums = sums.withColumn("partial", (F.col("block_words") > F.col("room")) & (F.col("room") > 0))
    sums = cut(sums.withColumn("units", F.col("passes") + F.when(F.col("room") > 0, 1).otherwise(0)).select("mix_key", "block", "nth", "blocks", "units", "room", "partial"))
    quota = {r.mix_key: r.q for r in sums.groupBy("mix_key").agg(F.sum("units").alias("q")).collect()}
    ends = split_tree([quota[r.mix_key] for r in per], shards, seed).cumsum(axis=0)
    cuts = spark.createDataFrame([(r.mix_key, [int(x) for x in ends[:, i]]) for i, r in enumerate(per)], "mix_key string, ends array<long>")
    # Unit u (from 0) of a block is unit u * blocks + nth of its source; the leaf whose cut holds it has drawn it.
    leaf = lambda u: F.size(F.filter("ends", lambda x: x < u * F.col("blocks") + F.col("nth")))
    drawn = F.filter(F.transform(F.sequence(F.lit(0), F.col("passes") + 1), leaf), lambda s: s < shards)
    blocks = sums.join(small(cuts), "mix_key").join(small(spec.select("mix_key", "passes")), "mix_key").select("mix_key", "block", "partial", "units", F.slice(drawn, F.lit(1), F.col("units").cast("int")).alias("drawn"))
    edge = slim.join(sums.where("partial").select("mix_key", "block", "room"), ["mix_key", "block"])
    # One line a row, twins summed, so that a row repeated a million times is no hot group.
    edge = edge.groupBy("mix_key", "mix_row", "room").agg(F.sum("mix_size").alias("mix_size"))
    some = edge.select("mix_key", "mix_row", "mix_size", "room").groupBy("mix_key").applyInPandas(_fit, "mix_key string, mix_row long, fits boolean")

    # The unit that would overrun is the block's last; those of its documents that do not fit lose it.
    whole = F.when(F.col("partial") & F.col("fits").isNull(), F.slice("drawn", F.lit(1), F.greatest(F.col("units").cast("int") - 1, F.lit(0)))).otherwise(F.col("drawn"))
    shards_of = F.when(F.col("mix_size") > 0, whole).otherwise(F.array().cast("array<int>"))
    drawn_rows = slim.select("mix_key", "mix_row", "mix_size", "block").join(blocks, ["mix_key", "block"]).join(some, ["mix_key", "mix_row"], "left").select("mix_key", "mix_row", "mix_size", shards_of.alias("drawn"))
    # One line a row, twins summed, so that a row repeated often is no hot group.
    lines = cut(drawn_rows.groupBy("mix_key", "mix_row").agg(F.sum("mix_size").alias("size"), F.max(F.size("drawn")).alias("times")))
    short = lines.groupBy("mix_key").agg(F.sum(F.col("size") * F.col("times")).alias("words")).join(small(spec.select("mix_key", "mix_target", "passes")), "mix_key").select("mix_key", "passes", (F.col("mix_target") - F.col("words")).alias("short"))
    # What is still short: of all documents that only whole passes have taken, the one that brings the source nearest to its target.
    near = F.struct(F.abs(F.col("short") - F.col("size")).alias("off"), "mix_row")
    more = lines.where((F.col("size") > 0) & (F.col("times") < int(cap))).join(small(short), "mix_key").where("times <= passes").where(F.abs(F.col("short") - F.col("size")) < F.col("short"))
    more = more.groupBy("mix_key").agg(F.min(near).alias("best")).select("mix_key", F.col("best.mix_row").alias("more"))

    out = _keyed(docs, source, text, seed).join(small(spec.drop("passes", "rest")), "mix_key").withColumn("block", block)
    out = out.join(blocks, ["mix_key", "block"]).join(some, ["mix_key", "mix_row"], "left").join(small(more), "mix_key", "left")
    last = F.pmod(F.xxhash64(F.lit(seed + 2), "mix_row"), F.lit(shards)).cast("int")
    out = out.withColumn("mix_shards", F.when(F.col("mix_row") == F.col("more"), F.concat(shards_of, F.array(last))).otherwise(shards_of))
    out = out.withColumn("mix_taken", (F.size("mix_shards") * F.col("mix_size")).cast("long"))
    return out.select(*[f"c{i}" for i in range(len(docs.columns))], "mix_row", *ADDED)


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target, mix_taken (words, repeats counted) and mix_shards (one entry each time it is taken)."""
    return _drawn(docs, **options).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c not in ADDED], *ADDED)


def emit(docs: DataFrame, part_words: int = PART_WORDS, **options) -> DataFrame:
    """The mix itself: every taken document as often as it is taken, each shard in partitions of about part_words words, shuffled inside."""
    shards = options.get("shards", SHARDS)
    total = SHARE * (docs.agg(F.sum(word_count(f"`{options.get('text', 'text')}`"))).first()[0] or 0)
    parts = max(1, int(-(-total // (shards * part_words))))
    one = _drawn(docs, **options).select("*", F.posexplode("mix_shards").alias("copy", "shard"))
    one = one.withColumn("at", F.xxhash64(F.lit(SEED), "mix_row", "copy"))
    one = one.repartition("shard", F.pmod("at", F.lit(parts))).sortWithinPartitions("shard", "at")
    return one.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
