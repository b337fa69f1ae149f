"""Suffix-array dedup (operator 8): repeated strings by linear grouping construction.

Every byte covered by a string of `least` bytes that also starts anywhere else goes. The suffix arrays are
built without recursion: suffixes are grouped by their Lyndon prefix, groups are processed in descending order
and split those that their previous-smaller pointers lead to; a second pass emits each group's order.

A suffix array of the whole corpus fits no task, so texts are first cut where equal strings must be cut alike.
Each window of `least` bytes is represented by its anchor, the half-length gram in it with the least hash
(leftmost in a tie). Equal windows have equal anchors at equal places, so only the surroundings of one anchor need to be
compared. Anchors that occur once are done. Where all surroundings of an anchor are alike, or one is there
twice, its windows repeat, and nothing is left to sort. The different surroundings that remain of an anchor
(the borders of repeated passages) go through one suffix array, in which the shared gram is one symbol;
neighbours with a long enough common prefix are repeated windows, compared byte by byte.

An anchor with over LIMIT different surroundings is dealt by the place of its windows: halves of the range of
places, told apart by a hash of what all windows of the half share, again until no part is over LIMIT. A
part of one place holds one string, so this ends, and the rows stay linear in the surroundings.

Defined cases: a null text is empty; texts under `least` bytes lose nothing; alike rows count as copies and get
alike results; matches never cross documents; empty tables give empty results. Alike surroundings are told by
two independent 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

LEAST, LIMIT, STRETCH = 200, 256, 1 << 20


# --- the suffix array -------------------------------------------------------------------------------------


def suffix_array(t: list[int]) -> list[int]:
    """Suffix array of t, whose last symbol is its unique least."""
    n = len(t)
    order = sorted(range(n), key=t.__getitem__)
    start, end = [0] * n, [0] * n  # of a suffix its group's first place; of a group, by its first place, its last
    at = [0] * n
    g = 0
    for k, s in enumerate(order):
        if k and t[s] != t[order[k - 1]]:
            end[g] = k - 1
            g = k
        start[s] = g
        at[s] = k
    end[g] = n - 1
    before = [-1] * n  # previous suffix of a lower group
    top = n - 1
    while top >= 0:
        g = start[order[top]]
        members = order[g : top + 1]
        if len(members) > 1:
            members.sort()
        leads: dict[int, int] = {}
        for s in members:
            p = s - 1
            while p >= 0 and start[p] >= g:
                p = before[p]
            before[s] = p
            if p >= 0:
                leads[p] = leads.get(p, 0) + 1
        if leads:
            if len(leads) == 1 or len(set(leads.values())) == 1:
                levels = [list(leads)]
            else:
                by: dict[int, list[int]] = {}
                for p, k in leads.items():
                    by.setdefault(k, []).append(p)
                levels = [by[k] for k in sorted(by, reverse=True)]
            for level in levels:
                moved: dict[int, int] = {}
                for p in level:
                    old = start[p]
                    last = end[old] - moved.get(old, 0)
                    moved[old] = moved.get(old, 0) + 1
                    here, other = at[p], order[last]
                    order[here], order[last] = other, p
                    at[other], at[p] = here, last
                for old, k in moved.items():
                    last = end[old]
                    new = last - k + 1
                    if new == old:
                        continue  # the whole group moves: nothing to split
                    end[old], end[new] = new - 1, last
                    for x in range(new, last + 1):
                        start[order[x]] = new
        top = g - 1
    out = [-1] * n
    done = [False] * n
    head = list(range(n))  # next free place of the group that starts here
    out[0] = n - 1
    done[n - 1] = True
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not done[j]:
            g = start[j]
            out[head[g]] = j
            head[g] += 1
            done[j] = True
            j = before[j]
    return out


def repeats(pieces: list[list[int]], least: int) -> list[list[int]]:
    """Of each piece the places where a string of `least` symbols starts that also starts elsewhere."""
    t: list[int] = []
    shift = len(pieces) + 1
    own, base = [], []
    for k, piece in enumerate(pieces):
        base.append(len(t))
        t += [x + shift for x in piece]
        own += [k] * (len(piece) + 1)
        t.append(k + 1)  # unique ends: no common prefix crosses a piece
    t.append(0)
    sa = suffix_array(t)
    n = len(t)
    rank = [0] * n
    for k, s in enumerate(sa):
        rank[s] = k
    out: list[set[int]] = [set() for _ in pieces]
    h = 0
    for s in range(n - 1):
        k = rank[s]
        if k:
            other = sa[k - 1]
            while t[s + h] == t[other + h]:
                h += 1
            if h >= least:
                out[own[s]].add(s - base[own[s]])
                out[own[other]].add(other - base[own[other]])
            if h:
                h -= 1
    return [sorted(x) for x in out]


# --- anchors ----------------------------------------------------------------------------------------------

_BYTES = np.random.Generator(np.random.PCG64(8)).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    h = (h ^ np.uint64(salt)) ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(32))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            x = np.full(n, b, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x)
    return _powers[0], _powers[1]


def anchors(data: bytes, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """Per anchor: hash of its gram, hash of its surroundings, first window's start, gram's start, last window's end."""
    gram, span = least // 2, least - least // 2 + 1
    parts = []
    for lo in range(0, max(0, len(data) - least + 1), STRETCH):
        b = np.frombuffer(data, np.uint8)[lo : lo + STRETCH + least - 1]
        n = len(b)
        up, down = _power(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[b] * up[:n], out=sums[1:])
        of = lambda a, z: (sums[z] - sums[a]) * down[a]
        h = _mixed((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
        low, at, w = h, np.arange(len(h)), 1
        while w < span:
            step = min(w, span - w)
            a, c = low[:-step], low[step:]
            later = c < a
            low, at, w = np.where(later, c, a), np.where(later, at[step:], at[:-step]), w + step
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        stop = np.r_[first[1:], len(at)] - 1 + least
        place = at[first]
        # The surroundings' hash also holds where the gram stands in them.
        around = _mixed(of(first, stop) + _mixed((place - first).astype(np.uint64), 1) + _mixed((stop - place).astype(np.uint64), 2), 3)
        parts.append((low[first].view(np.int64), around.view(np.int64), first + lo, place + lo, stop + lo))
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def anchor_rows(docs: DataFrame, least: int) -> DataFrame:
    """rk, gram, around, a, p, z: every anchor of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(rk, anchors(_utf8(t), least)) for rk, t in zip(pdf["rk"], pdf["text"])]
            rows = [(rk, x) for rk, x in rows if len(x[0])]
            if rows:
                got = [np.concatenate([x[k] for _, x in rows]) for k in range(5)]
                yield pd.DataFrame({"rk": np.repeat([rk for rk, _ in rows], [len(x[0]) for _, x in rows]), **dict(zip(("gram", "around", "a", "p", "z"), got))})

    return docs.select("rk", "text").mapInPandas(run, "rk long, gram long, around long, a int, p int, z int")


# --- surroundings that differ -----------------------------------------------------------------------------


def _sorted_out(pieces: pd.DataFrame, least: int) -> list[tuple[int, int, int]]:
    """(rk, from, to) that repeat, of a group of different surroundings of one gram hash."""
    gram = least // 2
    out = []
    by: dict[bytes, list[int]] = {}
    data = pieces["data"].tolist()
    off = pieces["off"].tolist()
    for k, (d, o) in enumerate(zip(data, off)):
        by.setdefault(d[o : o + gram], []).append(k)
    rks, starts, once = pieces["rk"].tolist(), pieces["a"].tolist(), (pieces["m"] == 1).tolist()
    for members in by.values():
        # A window holds over half of its other bytes on one side of the gram: without a partner there, it is alone.
        half = (least - gram) // 2
        left, right = {}, {}
        for k in members:
            d, o = data[k], off[k]
            left.setdefault(d[o - half : o] if o >= half else None, []).append(k)
            right.setdefault(d[o + gram : o + gram + half] if len(d) >= o + gram + half else None, []).append(k)
        near = {k for side in (left, right) for key, ks in side.items() if key is not None and len(ks) > 1 for k in ks}
        members = [k for k in members if k in near]
        if len(members) < 2 or not any(once[k] for k in members):
            continue
        symbols = [[*data[k][: off[k]], 256, *data[k][off[k] + gram :]] for k in members]
        for k, places in zip(members, repeats(symbols, least - gram + 1)):
            if once[k]:
                out += [(rks[k], starts[k] + x, starts[k] + x + least) for x in places]
    return out


def _joined(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Overlapping spans of a row joined."""
    out: list[list[int]] = []
    for rk, a, z in sorted(spans):
        if out and out[-1][0] == rk and a <= out[-1][2]:
            out[-1][2] = max(out[-1][2], z)
        else:
            out.append([rk, a, z])
    return [tuple(x) for x in out]


_PIECE = "g long, rk long, a int, off int, m long, lo int, hi int, data binary"


def different(pieces: DataFrame, least: int, limit: int) -> DataFrame:
    """rk, a, z of repeated windows among different surroundings (g: group; data: bytes; off: the gram's place)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def flush(pdf: pd.DataFrame) -> pd.DataFrame:
            spans: list[tuple[int, int, int]] = []
            for _, part in pdf.groupby("g", sort=False):
                if len(part) > 1:
                    spans += _sorted_out(part, least)
            return pd.DataFrame(_joined(spans), columns=["rk", "a", "z"])

        for pdf in batches:
            held.append(pdf)
            if sum(map(len, held)) < 4096:
                continue
            every = pd.concat(held, ignore_index=True)
            last = int(every["g"].searchsorted(every["g"].iloc[-1]))
            held = [every.iloc[last:]]
            if last:
                yield flush(every.iloc[:last])
        if held:
            yield flush(pd.concat(held, ignore_index=True))

    def halves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each piece cut to the windows that start lo to hi - 1 bytes before the gram, for both halves of that range."""
        for pdf in batches:
            rows = []
            for g, rk, a, off, m, lo, hi, data in pdf.itertuples(index=False):
                mid = (lo + hi) // 2
                for x, y in ((lo, mid), (mid, hi)):
                    # Windows in reach: those starting max(x, ...) to min(y - 1, off) before the gram and ending inside.
                    first, final = min(y - 1, off), max(x, off + least - len(data))
                    if first < final:
                        continue
                    piece = data[off - first : off - final + least]
                    core = data[off - x : off - y + 1 + least] if off >= x and y > x and off - y + 1 + least <= len(data) else None
                    if core is None:
                        continue
                    key = int.from_bytes(hashlib.blake2b(core + bytes((x, y)) + g.to_bytes(8, "little", signed=True), digest_size=8).digest(), "little", signed=True)
                    same = int.from_bytes(hashlib.blake2b(piece + first.to_bytes(4, "little"), digest_size=8).digest(), "little", signed=True)
                    rows.append((key, same, rk, a + off - first, first, m, x, y, piece))
            yield pd.DataFrame(rows, columns=["g", "same", "rk", "a", "off", "m", "lo", "hi", "data"])

    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spans = None
    add = lambda df: df if spans is None else spans.unionByName(df)
    while True:
        hot = cut(pieces.groupBy("g").agg(F.count("*").alias("k")).where(F.col("k") > limit).select("g"))
        any_hot = not hot.isEmpty()
        cool = pieces.join(hot, "g", "left_anti") if any_hot else pieces
        spans = add(cut(cool.repartition(parts, "g").sortWithinPartitions("g").mapInPandas(run, "rk long, a int, z int")))
        if not any_hot:
            return spans
        dealt = cut(pieces.join(hot, "g").select(*[x.split()[0] for x in _PIECE.split(", ")]).mapInPandas(halves, "g long, same long, rk long, a int, off int, m long, lo int, hi int, data binary"))
        kinds = cut(dealt.groupBy("g", "same").agg(F.sum("m").alias("all"), F.min(F.struct("rk", "a")).alias("one")))
        # Alike pieces repeat; one of them stays as a partner for the rest of its part.
        again = dealt.join(kinds.where("all > 1").select("g", "same"), ["g", "same"]).where("m = 1").select("rk", "a", (F.col("a") + F.length("data")).cast("int").alias("z"))
        spans = add(cut(again))
        several = kinds.groupBy("g").agg(F.count("*").alias("k")).where("k > 1").select("g")
        pieces = dealt.join(kinds, ["g", "same"]).where((F.col("rk") == F.col("one.rk")) & (F.col("a") == F.col("one.a"))).drop("m", "one").withColumnRenamed("all", "m")
        pieces = cut(pieces.join(several, "g").dropDuplicates(["g", "same"]).select(*[x.split()[0] for x in _PIECE.split(", ")]))


def repeated_spans(docs: DataFrame, least: int = LEAST, limit: int = LIMIT) -> DataFrame:
    """rk, a, z: byte ranges of rows that are covered by repeated windows (ranges may overlap)."""
    # Computed again for the join rather than kept: hashing costs less than a table of all anchors.
    found = anchor_rows(docs, least)
    several = found.groupBy("gram").agg(F.count("*").alias("all"), F.min("around").alias("low"), F.max("around").alias("high")).where("all > 1")
    several = cut(several.select("gram", (F.col("low") != F.col("high")).alias("differ")))
    live = cut(found.join(several, "gram"))
    alike = live.where("not differ").select("rk", "a", "z")
    mixed = live.where("differ").select("gram", "around", "rk", "a", "p", "z")
    each = cut(mixed.groupBy("gram", "around").agg(F.count("*").alias("m"), F.min(F.struct("rk", "a", "p", "z")).alias("one")))
    copies = mixed.join(each.where("m > 1").select("gram", "around"), ["gram", "around"]).select("rk", "a", "z")
    want = each.groupBy(F.col("one.rk").alias("rk")).agg(F.collect_list(F.struct(F.col("gram").alias("g"), "m", "one.a", "one.p", "one.z")).alias("want"))

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for rk, text, wanted in zip(pdf["rk"], pdf["text"], pdf["want"]):
                data = _utf8(text)
                for w in wanted:
                    rows.append((w["g"], rk, w["a"], w["p"] - w["a"], w["m"], 0, least - least // 2 + 1, data[w["a"] : w["z"]]))
            yield pd.DataFrame(rows, columns=["g", "rk", "a", "off", "m", "lo", "hi", "data"])

    texts = docs.select("rk", "text").join(want, "rk").dropDuplicates(["rk"])
    pieces = cut(texts.select("rk", "text", "want").mapInPandas(fetch, _PIECE))
    return alike.unionByName(copies).unionByName(different(pieces, least, limit))


def dedup(docs: DataFrame, least: int = LEAST, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed byte ranges of every row."""
    rows = docs.select("doc_id", "text", F.xxhash64(F.lit(8), "doc_id", "text").alias("rk"))
    spans = repeated_spans(rows, least, limit).groupBy("rk").agg(F.collect_list(F.struct("a", "z")).alias("spans"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, text, found in zip(pdf["doc_id"], pdf["text"], pdf["spans"]):
                data = _utf8(text)
                gone = _joined([(0, s["a"], s["z"]) for s in found]) if found is not None else []
                kept, at = hashlib.sha256(), 0
                for _, a, z in gone:
                    kept.update(data[at:a])
                    at = z
                kept.update(data[at:])
                out.append((doc, len(data), sum(z - a for _, a, z in gone), len(gone), kept.hexdigest(), [x for _, a, z in gone for x in (a, z)]))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<int>"
    return rows.join(spans, "rk", "left").select("doc_id", "text", "spans").mapInPandas(run, schema)
