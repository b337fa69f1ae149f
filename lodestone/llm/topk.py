"""Exact top-k search (operator 2): multi-resolution segment statistics.

Each vector is quantised to integers and summarised by the mean and deviation of its segments, at 2, 4, 8, ...
segments. For two vectors and a resolution, the sum over segments of length * (mean * mean + deviation *
deviation) bounds the inner product from above (Cauchy-Schwarz inside each segment) and so the distance
|q|^2 + |x|^2 - 2 q.x from below. A query keeps its k-th best exact score so far; candidates whose bound falls below it go,
coarse resolution first, and only survivors get an exact product.

Queries and candidates meet block by block: each is dealt into blocks of about BLOCK rows by a hash, a pair of
blocks is one task, and each pair returns k rows a query at most, which a ranked window then merges (Spark
limits every group before the shuffle). Memory is bounded by two blocks; nothing is broadcast.

Defined cases: vectors that are null or hold null or non-finite components take no part; shorter vectors count
as padded with zeros; ties go to the smaller vec_id; a row never meets itself (by vec_id); components too large for exact
sums in double precision are multiplied as whole numbers, and scores beyond a long saturate; a repeated vec_id
is searched and found once for each row; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K, SCALE, BLOCK, SEED_ROWS = 20, 64.0, 8192, 64


def segments(x: np.ndarray, n: int) -> np.ndarray:
    """For each row the statistics of n segments, scaled so that a plain product of two rows is the bound."""
    cuts = np.linspace(0, x.shape[1], n + 1).astype(int)
    size = np.maximum(np.diff(cuts), 1)
    s = np.add.reduceat(x, cuts[:-1], axis=1)
    s2 = np.add.reduceat(x * x, cuts[:-1], axis=1)
    mean = s / size
    var = np.maximum(s2 / size - mean * mean, 0.0)
    return np.hstack([mean * np.sqrt(size), np.sqrt(var * size)])


def matrix(rows: pd.Series, scale: float, width: int) -> np.ndarray:
    """Quantised vectors, padded to width; integers in double precision."""
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        v = np.floor(np.asarray(r, dtype=np.float64) * scale)
        out[i, : len(v)] = v
    return out


def best(q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query row, candidate row, score): each query's k best candidates of other ids, ties to smaller ids."""
    order = np.argsort(xid, kind="stable")
    x, xid = x[order], xid[order]
    dim = x.shape[1]
    levels = [n for n in (2, 4, 8, 16) if n * 2 <= dim]
    stats = [(segments(q, n), segments(x, n)) for n in levels]
    out = []
    for lo in range(0, len(q), 256):
        block = slice(lo, min(lo + 256, len(q)))
        bound = stats[0][0][block] @ stats[0][1].T if stats else None
        for r in range(block.stop - lo):
            mine, own = q[lo + r], xid != qid[lo + r]
            if bound is None:
                left = np.flatnonzero(own)
                exact = x[left] @ mine
            else:
                # The most promising rows give a first k-th best score.
                ub = np.where(own, bound[r], -np.inf)
                first = np.argpartition(-ub, min(SEED_ROWS, len(ub) - 1))[:SEED_ROWS]
                first = first[own[first]]
                scores = x[first] @ mine
                floor = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else -np.inf
                slack = 1e-6 * (1 + abs(floor)) if np.isfinite(floor) else 0.0
                left = np.flatnonzero(own & (ub >= floor - slack))
                for (sq, sx) in stats[1:]:
                    if len(left) <= 4 * k:
                        break
                    left = left[sx[left] @ sq[lo + r] >= floor - slack]
                exact = x[left] @ mine
            if len(left) > k:
                cut_at = np.partition(exact, len(exact) - k)[len(exact) - k]
                keep = np.flatnonzero(exact >= cut_at)
                left, exact = left[keep], exact[keep]
            top = np.lexsort((left, -exact))[:k]  # rows are in order of id
            out += [(lo + r, int(order[left[t]]), float(exact[t])) for t in top]
    return out


def best_whole(q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """The same for components of any size, in whole numbers; scores beyond a long saturate."""
    rows = [[int(c) for c in v] for v in x]
    out = []
    for r, v in enumerate(q):
        mine = [int(c) for c in v]
        scored = sorted((-sum(a * b for a, b in zip(mine, w)), int(i), j) for j, (w, i) in enumerate(zip(rows, xid)) if i != qid[r])
        out += [(r, j, max(-(2**63), min(2**63 - 1, -s))) for s, _, j in scored[:k]]
    return out


def search(vectors: DataFrame, queries: DataFrame, k: int = K, scale: float = SCALE, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score for each row of queries against all rows of vectors (vec_id, embedding)."""
    fine = lambda _: F.col("embedding").isNotNull() & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & fine("x"))
    asks = queries.select(F.col("vec_id").alias("query_id"), "embedding").where(F.col("vec_id").isNotNull() & fine("x"))
    sizes = rows.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d"), F.max(F.array_max(F.transform("embedding", F.abs))).alias("m")).first()
    n_q = asks.count()
    # Beyond this, sums are no longer exact in double precision; whole numbers of any size take over.
    huge = sizes.m is not None and (float(sizes.m) * scale + 1) ** 2 * max(1, sizes.d) >= 2.0**53
    width, parts, ask_parts = int(sizes.d or 1), max(1, -(-sizes.n // block)), max(1, -(-n_q // block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = rows.withColumn("rb", F.pmod(F.xxhash64(F.lit(2), "vec_id"), F.lit(parts)).cast("int")).withColumn("qb", every(ask_parts))
    asks = asks.withColumn("qb", F.pmod(F.xxhash64(F.lit(3), "query_id"), F.lit(ask_parts)).cast("int")).withColumn("rb", every(parts))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        q, x = matrix(left["embedding"], scale, width), matrix(right["embedding"], scale, width)
        qid, xid = left["query_id"].to_numpy(), right["vec_id"].to_numpy()
        got = (best_whole if huge else best)(q, qid, x, xid, k)
        return pd.DataFrame({"query_id": [qid[a] for a, _, _ in got], "vec_id": [xid[b] for _, b, _ in got], "score": [int(s) for _, _, s in got]})

    near = asks.groupBy("qb", "rb").cogroup(rows.groupBy("qb", "rb")).applyInPandas(meet, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
