"""SimHash near-dedup (operator 3): bit-sliced comparison of 64-bit fingerprints.

Fingerprints: a bit is set if it is set in over half of the hashes (XXH64, seed 42) of the text's word shingles.
Candidates: with radius r, the 64 bits are cut into m > r blocks; two fingerprints within the radius agree on
at least m - r of them, so a table for each choice of m - r blocks misses no pair. m grows with the number of
different fingerprints, to keep chance meetings rare. Rows of a key are compared bit-sliced: bit planes lie
vertically, 64 candidates to a word; a carry-save counter adds a plane to all their distances at once, and a
block of candidates is abandoned once every distance in it exceeds the radius. A key with more than CHUNK rows
is dealt into chunks, and every pair of chunks meets in a task of its own, so no task gets an unbounded group.
A group returns a star for each of its local components instead of its pairs; stars are joined by
common.components().

Defined cases: no words gives fingerprint 0, linked like any other; fewer words than a shingle make one; equal
fingerprints meet before any comparison, so copies cost nothing; a null doc_id links but is nobody's component
id; repeated rows each get a row (keep_one: one of them stays); texts of any length are whole; other columns pass, whatever their
names; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut, words

SHINGLE, SEED, RADIUS, CHUNK, PER_KEY = 4, 42, 4, 1024, 64


def fingerprint(text: str | None, k: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a text, as an unsigned 64-bit number."""
    w = words(text, lower=True)
    if not w:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(w) <= k:
        hashes = [digest(join(w), seed)]
    else:
        hashes = [digest(join(w[i : i + k]), seed) for i in range(len(w) - k + 1)]
    h = np.array(hashes, dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 65_536):
        part = h[i : i + 65_536]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and key (128 bits of doc_id and text) of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = np.array([fingerprint(t, k, seed) for t in pdf["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": fp, "ka": pdf["ka"], "kb": pdf["kb"]})

    keyed = docs.select("doc_id", "text", *[x.alias(n) for x, n in zip(_key(), ("ka", "kb"))])
    return keyed.mapInPandas(run, "doc_id long, fp long, ka long, kb long")


def _key() -> list[Column]:
    return [F.xxhash64(F.lit(seed), "doc_id", "text") for seed in (3, 4)]


def blocks_for(n: int, radius: int) -> int:
    """The least number of blocks whose keys hold few fingerprints by chance."""
    m = radius + 1
    while m < radius + 4 and n > PER_KEY * 2 ** (64 * (m - radius) // m):
        m += 1
    return m


def masks_for(m: int, radius: int) -> list[int]:
    """Bit masks of every choice of m - radius of m blocks."""
    cuts = [64 * i // m for i in range(m + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [sum(chosen) for chosen in combinations(block, m - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def linked(fp: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j), j < i, of rows of the same group within the radius; group must be sorted.

    Lanes: every group owns whole words of 64 candidates. A unit is a (row, word of its group); all units
    advance together through the bit planes, and those without a lane within the radius are dropped.
    """
    n = len(fp)
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[start, n])
    own = np.repeat(np.arange(len(start)), size)  # each row's group
    place = np.arange(n) - start[own]
    per = (size + 63) // 64
    first = np.r_[0, per.cumsum()[:-1]]
    word = first[own] + place // 64
    lane = (place % 64).astype(np.uint64)
    bits = np.unpackbits(fp.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little").astype(np.uint64)
    planes = np.zeros((64, int(per.sum())), dtype=np.uint64)
    head = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    for p in range(64):
        planes[p] = np.bitwise_or.reduceat(bits[:, p] << lane, head)
    # A row meets only the words up to its own: each pair once.
    units = place // 64 + 1
    row = np.repeat(np.arange(n), units)
    at = np.arange(len(row)) - np.repeat(np.r_[0, units.cumsum()[:-1]], units) + first[own[row]]
    full = ~np.uint64(0)
    live = np.where(at == word[row], (np.uint64(1) << lane[row]) - np.uint64(1), full)  # lanes before the row
    flip = np.where(bits == 1, full, np.uint64(0))
    ones, twos, fours, over = (np.zeros(len(row), dtype=np.uint64) for _ in range(4))
    for p in range(64):
        x = planes[p][at] ^ flip[row, p]
        carry = ones & x
        ones ^= x
        more = twos & carry
        twos ^= carry
        over |= fours & more
        fours ^= more
        if p % 8 == 7:
            far = over | _above(ones, twos, fours, radius)
            live &= ~far
            keep = live != 0
            if not keep.all():
                row, at, live, ones, twos, fours, over = (a[keep] for a in (row, at, live, ones, twos, fours, over))
            if not len(row):
                return np.zeros(0, int), np.zeros(0, int)
    lanes = np.unpackbits(live.astype("<u8").view(np.uint8).reshape(len(live), 8), axis=1, bitorder="little")
    u, k = np.nonzero(lanes)
    i = row[u]
    return i, start[own[i]] + (at[u] - first[own[i]]) * 64 + k


def _above(ones: np.ndarray, twos: np.ndarray, fours: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose three-bit counter exceeds the radius (0 to 7)."""
    out = np.zeros_like(ones)
    for v in range(radius + 1, 8):
        out |= (ones if v & 1 else ~ones) & (twos if v & 2 else ~twos) & (fours if v & 4 else ~fours)
    return out


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For rows 0 to n-1 the least row of their component under the links i-j."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        open_ = label[i] != label[j]
        i, j = i[open_], j[open_]
    return label


def links(fps: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """Edges a, b between different fingerprints (column fp) that connect all pairs within the radius."""
    if not 0 <= radius < 8:
        raise ValueError("the counters hold radii of 0 to 7")
    n = fps.count()
    masks = masks_for(blocks_for(n, radius), radius)
    keyed = fps.select("fp", F.posexplode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("t", "mask")).select("fp", F.xxhash64("t", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"))
    # Only keys over CHUNK rows are listed; by their counts their rows are dealt into chunks.
    hot = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > chunk).select("key", F.ceil(F.col("n") / chunk).cast("int").alias("parts"))
    some = keyed.join(hot, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64(F.lit(9), "fp"), F.col("parts")).cast("int")
    met = some.select("fp", "key", own.alias("c"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("o"))
    dealt = met.select("fp", F.xxhash64("key", F.least("c", "o"), F.greatest("c", "o")).alias("g"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def flush(pdf: pd.DataFrame) -> pd.DataFrame:
            fp, group = pdf["fp"].to_numpy(), pdf["g"].to_numpy()
            i, j = linked(fp.view(np.uint64), group, radius)
            label = roots(len(fp), i, j)
            k = np.flatnonzero(label != np.arange(len(fp)))
            return pd.DataFrame({"a": fp[k], "b": fp[label[k]]})

        for pdf in batches:
            held.append(pdf)
            if sum(map(len, held)) < 16_384:
                continue
            every = pd.concat(held, ignore_index=True)
            last = int(every["g"].searchsorted(every["g"].iloc[-1]))  # the last group may go on
            held = [every.iloc[last:]]
            if last:
                yield flush(every.iloc[:last])
        if held and sum(map(len, held)):
            yield flush(pd.concat(held, ignore_index=True))

    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "g").sortWithinPartitions("g").mapInPandas(run, "a long, b long")


def _grouped(docs: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """All rows' fingerprints, and the root of every fingerprint's component (fp, first, root)."""
    each = cut(fingerprints(docs))
    fps = cut(each.groupBy("fp").agg(F.min("doc_id").alias("first")))
    comp = components(links(fps.select("fp"), radius))
    return each, fps.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of docs (doc_id, text)."""
    each, placed = _grouped(docs, radius)
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    known = placed.select("fp", "root").join(least, "root").select("fp", "component_id")
    return each.join(known, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Of every component of docs one row: the least doc_id (null last), of its rows the least by a hash of doc_id and text, of alike ones any."""
    each, placed = _grouped(docs, radius)
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "ka", "kb")
    stay = each.join(placed.select("fp", "root"), "fp").groupBy("root").agg(F.min(order).alias("k")).select("k.ka", "k.kb")
    rows = docs.select(*[x.alias(n) for x, n in zip(_key(), ("ka", "kb"))], F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    # Rows alike in doc_id and text have one key; the one whose columns hash least stays.
    one = rows.join(stay, ["ka", "kb"], "left_semi").groupBy("ka", "kb").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return one.select(*[F.col(f"row.`{c}`") for c in docs.columns])
