"""What several corpus operators share: checkpoints, words, bounded grouping and components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.storage import collect_shuffles, cut, release

#: Word characters are everything but these six; str.split() on bytes uses the same six.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def words(text: str | None, lower: bool = False) -> list[bytes]:
    """Words of a text in UTF-8; lower-casing touches A-Z alone."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return (data.lower() if lower else data).split()


def word_count(column: str) -> F.Column:
    """Number of words, in the JVM; null counts 0."""
    return F.size(F.array_remove(F.split(F.coalesce(F.col(column), F.lit("")), GAP), "")).cast("long")


def remainder(column: str, n: int) -> F.Column:
    """crc32 of the column as text, modulo n; null gives 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % n, F.lit(0))


def bytes_of(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes in a text column, in one pass with partial sums."""
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def components(edges: DataFrame) -> DataFrame:
    """Connected components by repeated contraction, in DataFrame operations alone.

    edges has columns a and b (any order, repeats and loops allowed) of one orderable type. Returns one row
    for each node of an edge between different nodes: node, root (the least node of its component).

    Every round maps each node to its least neighbour if that is smaller, follows the map until it rests (its
    reach doubles each time), and replaces edges by edges between images. A round at least halves the nodes
    that still have an edge, and stars end at once. Minima use partial aggregation, and a hub's edges spread over tasks by adaptive skew joins.
    """
    e = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    maps: list[DataFrame] = []
    while not e.isEmpty():
        far = cut(e.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to")))
        while True:
            jump = far.alias("s").join(far.alias("t"), F.col("s.to") == F.col("t.node"), "left")
            next_ = cut(jump.select("s.node", F.coalesce("t.to", "s.to").alias("to"), F.col("t.to").isNotNull().alias("moved")))
            release(far)
            far = next_
            if far.where("moved").isEmpty():
                break
        maps.append(far)
        left = e.join(far.select(F.col("node").alias("a"), F.col("to").alias("ra")), "a", "left")
        both = left.join(far.select(F.col("node").alias("b"), F.col("to").alias("rb")), "b", "left")
        a, b = F.coalesce("ra", "a"), F.coalesce("rb", "b")
        next_ = cut(both.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct())
        release(e)
        e = next_
    release(e)
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    done = None
    for m in maps:
        part = m.select("node", F.col("to").alias("root"))
        if done is None:
            done = cut(part)
        else:
            moved = done.join(part.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
            next_ = cut(moved.unionByName(part))
            release(done)
            done = next_
        release(m)
    roots = done.select(F.col("root").alias("node"), "root").distinct()
    return done.unionByName(roots)
