"""Ranked lexical search (operator 11): Block-Max WAND over fixed-size compressed posting blocks.

The index has segments of bounded size, built where the documents lie: no posting is shuffled for it. A segment holds its
documents' ids and lengths, and a row a term with its postings in blocks of BLOCK documents: gaps and counts of 1, 2 or 4
bytes each. A block's head, apart from its body, has its first and last document and its maximum impact, as the pairs of count and
length that no other pair of the block beats: so the index does not depend on the corpus' totals, and any totals give the exact maximum.

A search meets a segment's lists of the asked terms, with up to ITEMS items at a time. The ends of the blocks of an item's lists cut
the segment into stretches, in each of which every list has at most one block; moving all lists' shallow pointers from
stretch to stretch and summing the blocks' weighted maxima bounds a stretch's scores, from heads alone; only lists of fewer documents
than stretches, the pivots, point at their documents. Stretches under the threshold, the
worst score of the item's best k so far, are skipped; the others are taken from the highest bound on, a part at a time, so
the threshold rises before most are looked at. Only their blocks are decompressed, and scored exactly. A first pass over one segment in
SAMPLE gives each item a floor (the k-th best of a part is no better than that of all) with which the second pass over the other segments
begins, so these return little more than the result.

Nothing that grows with documents or items comes to the driver or is broadcast by hint; a group of work holds segments of about GROUP_DOCS documents,
also for terms that all documents hold. Defined cases: a null text has no terms; a text without terms is no document; rows of one item_id
are one item with all their terms, a null id too; repeated documents are each ranked; a null doc_id comes first among equal scores; texts of any
length are used whole; empty tables give empty results; columns but ids and texts are not read, whatever their names.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

#: Everything in ASCII but digits and letters parts terms.
NOT_TERM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLOCK, SEGMENT_DOCS, SEGMENT_BYTES, GROUP_DOCS = 128, 16_384, 12 << 20, 16_384
TOP, ITEMS, SAMPLE = 50, 1_000, 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A byte's stand-in: A-Z in lower case, a blank where terms part.
_TABLE = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).translate(bytes.maketrans(_UPPER.encode(), _LOWER.encode()))
INDEX = "segment long, term string, df long, total long, head binary, impacts binary, body binary"
_HEAD = np.dtype([("first", "<u4"), ("last", "<u4"), ("count", "u1"), ("pairs", "u1"), ("gap_width", "u1"), ("tf_width", "u1")])
_PAIR = np.dtype([("tf", "<u4"), ("n", "<u8")])


def terms(text: str | None) -> list[bytes]:
    """Terms of a text in UTF-8, with repeats."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def term_column(text: Column) -> Column:
    """The same in the JVM: the different terms of a text."""
    return F.array_remove(F.array_distinct(F.split(F.translate(text, _UPPER, _LOWER), NOT_TERM)), "")


# ---- the index


def _widths(most: np.ndarray) -> np.ndarray:
    return np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4)).astype(np.uint8)


def _lay(out: np.ndarray, at: np.ndarray, values: np.ndarray, width: np.ndarray) -> None:
    """Writes little-endian numbers of 1, 2 or 4 bytes to their places."""
    for k in range(4):
        some = width > k
        out[at[some] + k] = (values[some] >> (8 * k)).astype(np.uint8)


def _binary(data: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Binaries that lie behind one another in data, each up to its end."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(kind, len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def packed(term: np.ndarray, doc: np.ndarray, tf: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Postings in order of (term, doc), as blocks: postings a term, and (bytes, ends by term) of heads, impacts and bodies."""
    place = np.arange(len(term))
    fresh = np.ones(len(term), bool)
    fresh[1:] = term[1:] != term[:-1]
    begin = np.maximum.accumulate(np.where(fresh, place, 0))
    opens = (place - begin) % BLOCK == 0
    b0 = np.flatnonzero(opens)
    block = np.cumsum(opens) - 1
    count = np.diff(np.append(b0, len(term)))
    gap = np.diff(doc, prepend=0)
    gap[b0] = 0
    wg, wt = _widths(np.maximum.reduceat(gap, b0)), _widths(np.maximum.reduceat(tf, b0))
    size = count * (wg.astype(np.int64) + wt)
    ends = np.cumsum(size)
    body = np.zeros(int(ends[-1]), np.uint8)
    nth, start = place - b0[block], (ends - size)[block]
    _lay(body, start + nth * wg[block], gap, wg[block])
    _lay(body, start + count[block] * wg[block] + nth * wt[block], tf, wt[block])
    # Of a block's pairs in order of length, those whose count beats all before them.
    order = np.lexsort((-tf, n, block))
    best = np.maximum.accumulate(tf[order] + (block[order] << 32))
    keep = np.ones(len(order), bool)
    keep[1:] = best[1:] > best[:-1]
    held = order[keep]
    pairs = np.zeros(len(held), _PAIR)
    pairs["tf"], pairs["n"] = tf[held], n[held]
    n_pairs = np.bincount(block[held], minlength=len(b0))
    head = np.zeros(len(b0), _HEAD)
    head["first"], head["last"], head["count"], head["pairs"], head["gap_width"], head["tf_width"] = doc[b0], doc[b0 + count - 1], count - 1, n_pairs - 1, wg, wt
    # Ends by term: of its last block.
    last = np.append(np.flatnonzero(fresh[b0])[1:], len(b0)) - 1
    raw = lambda x: np.frombuffer(x.tobytes(), np.uint8)
    df = np.diff(np.append(np.flatnonzero(fresh), len(term)))
    return df, [(raw(head), (last + 1) * _HEAD.itemsize), (raw(pairs), np.cumsum(n_pairs)[last] * _PAIR.itemsize), (body, ends[last])]


class Segment:
    """Documents on their way into a segment: only numbers are kept of them, beside each different term once."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        self.n, self.per = array("q"), array("q")
        self.term, self.tf = array("i"), array("i")
        self.size = 0

    def add(self, doc: int | None, text: str) -> None:
        found = Counter(terms(text))
        if not found:
            return
        number = self.number
        self.ids.append(doc)
        self.term.extend([number.setdefault(t, len(number)) for t in found])
        self.tf.extend(found.values())
        self.n.append(found.total())
        self.per.append(len(found))
        self.size += len(text)

    def rows(self, name: int) -> pa.RecordBatch:
        """A row a term; the row of the empty term holds the documents."""
        n, per = np.frombuffer(self.n, np.int64), np.frombuffer(self.per, np.int64)
        term = np.frombuffer(self.term, np.int32)
        order = np.argsort(term, kind="stable")
        doc = np.repeat(np.arange(len(per)), per)[order]
        df, parts = packed(term[order], doc, np.frombuffer(self.tf, np.int32)[order].astype(np.int64), n[doc])
        names = list(self.number)
        no_id = np.array([i is None for i in self.ids])
        known = np.array([0 if i is None else i for i in self.ids], np.int64)
        documents = [known.tobytes(), no_id.tobytes(), n.tobytes()]
        columns = [
            pa.array(np.full(len(names) + 1, name)),
            pa.concat_arrays([pa.array([""]), _binary(np.frombuffer(b"".join(names), np.uint8), np.cumsum([len(t) for t in names]), pa.string())]),
            pa.array(np.concatenate([[len(self.ids)], df])),
            pa.array(np.concatenate([[n.sum()], np.zeros(len(names), np.int64)])),
            *[pa.concat_arrays([pa.array([one], pa.binary()), _binary(data, ends, pa.binary())]) for one, (data, ends) in zip(documents, parts)],
        ]
        return pa.RecordBatch.from_arrays(columns, ["segment", "term", "df", "total", "head", "impacts", "body"])


def build(docs: DataFrame, segment_docs: int = SEGMENT_DOCS, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The index of docs (doc_id, text), written to the shared folder: a row a segment and term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, nth, part = Segment(), 0, 0
        for batch in batches:
            for doc, text, part in zip(*[batch[c] for c in ("doc_id", "text", "part")]):
                held.add(doc.as_py(), text.as_py())
                if len(held.ids) >= segment_docs or held.size >= segment_bytes:
                    yield held.rows((part.as_py() << 32) + nth)
                    held, nth = Segment(), nth + 1
        if held.ids:
            yield held.rows((part.as_py() << 32) + nth)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.spark_partition_id().alias("part"))
    return cut(rows.mapInArrow(run, INDEX))


# ---- the search


class Postings:
    """One term's list in one segment: blocks are decompressed when they are first needed."""

    def __init__(self, df: int, head: bytes, impacts: bytes, body: bytes, reach: np.ndarray, total: int, tokens: int) -> None:
        h = np.frombuffer(head, _HEAD)
        self.first, self.last = h["first"].astype(np.int64), h["last"].astype(np.int64)
        self.count = h["count"].astype(np.int64) + 1
        self.widths = h["gap_width"].astype(np.int64), h["tf_width"].astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.count * (self.widths[0] + self.widths[1]))])
        self.start = np.concatenate([[0], np.cumsum(self.count)])
        p = np.frombuffer(impacts, _PAIR)
        n_pairs = h["pairs"].astype(np.int64) + 1
        self.most = np.maximum.reduceat(impact(p["tf"].astype(np.int64), scale(p["n"].astype(np.int64), total, tokens)), np.cumsum(n_pairs) - n_pairs)
        self.body, self.reach = body, reach
        self.doc, self.score, self.ready = np.zeros(df, np.int64), np.zeros(df, np.int64), np.zeros(len(h), bool)

    def open(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and unweighted scores of some blocks (a flag each)."""
        for b in np.flatnonzero(blocks & ~self.ready).tolist():
            count, at, wg, wt = int(self.count[b]), int(self.at[b]), int(self.widths[0][b]), int(self.widths[1][b])
            doc = np.frombuffer(self.body, f"<u{wg}", count, at).cumsum(dtype=np.int64) + self.first[b]
            tf = np.frombuffer(self.body, f"<u{wt}", count, at + count * wg).astype(np.int64)
            lo = int(self.start[b])
            self.doc[lo : lo + count], self.score[lo : lo + count] = doc, impact(tf, self.reach[doc])
            self.ready[b] = True
        if blocks.all():
            return self.doc, self.score
        some = np.repeat(blocks, self.count)
        return self.doc[some], self.score[some]


def scale(n: np.ndarray, total: int, tokens: int) -> np.ndarray:
    """What a document's length adds below: 20 * m."""
    return 20 * (50 + 50 * n * total // tokens)


def impact(tf: np.ndarray, scaled: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + scaled)


class Best:
    """An item's best k documents so far; scores under floor are of no use."""

    def __init__(self, k: int, floor: int) -> None:
        self.k, self.floor = k, max(1, floor)
        self.score = np.zeros(0, np.int64)
        self.doc = np.zeros(0, np.int64)
        self.no_id = np.zeros(0, bool)

    def threshold(self) -> int:
        return max(self.floor, int(self.score[-1])) if len(self.score) == self.k else self.floor

    def add(self, score: np.ndarray, doc: np.ndarray, no_id: np.ndarray) -> None:
        score, doc, no_id = (np.concatenate(x) for x in ((self.score, score), (self.doc, doc), (self.no_id, no_id)))
        order = np.lexsort((doc, ~no_id, -score))[: self.k]
        self.score, self.doc, self.no_id = score[order], doc[order], no_id[order]


def wand(lists: list[tuple[Postings, int]], best: Best, ids: np.ndarray, no_id: np.ndarray) -> int:
    """Brings a segment's documents into an item's best; lists have their weights. Returns how many blocks were needed."""
    lists = [(x, w) for x, w in lists if w > 0]
    if not lists:
        return 0
    ends = np.unique(np.concatenate([x.last for x, _ in lists]))
    bound = np.zeros(len(ends), np.int64)
    shallow = []
    for x, w in lists:
        # The block whose end is the next one from here; it may begin only after this stretch.
        at = np.searchsorted(x.last, ends)
        held = at < len(x.last)
        at[~held] = 0
        held &= x.first[at] <= ends
        if len(x.doc) <= len(ends):
            # A list of few documents: the pivots. Its pointer goes to the documents themselves.
            doc, score = x.open(np.ones(len(x.last), bool))
            most = np.zeros(len(ends), np.int64)
            np.maximum.at(most, np.searchsorted(ends, doc), score)
            held &= most > 0
            bound += w * most
        else:
            bound += np.where(held, w * x.most[at], 0)
        shallow.append((at, held))
    order = np.argsort(-bound, kind="stable")
    done, take, needed = 0, max(4, len(ends) // 16), 0
    while done < len(order):
        chosen = order[done : done + take]
        done, take = done + take, take * 4
        chosen = chosen[bound[chosen] >= best.threshold()]
        if not len(chosen):
            break
        live = np.zeros(len(ends), bool)
        live[chosen] = True
        total = np.zeros(int(ends[-1]) + 1, np.int64)
        for (x, w), (at, held) in zip(lists, shallow):
            blocks = np.zeros(len(x.last), bool)
            blocks[at[live & held]] = True
            if blocks.any():
                needed += int(blocks.sum())
                doc, score = x.open(blocks)
                total[doc] += w * score
        # Outside the chosen stretches sums are not whole.
        inside = np.repeat(live, np.diff(ends, prepend=-1))
        good = np.flatnonzero(inside & (total >= best.threshold()))
        if len(good) > best.k:
            kth = np.partition(total[good], len(good) - best.k)[len(good) - best.k]
            good = good[total[good] >= kth]
        best.add(total[good], ids[good], no_id[good])
    return needed


def _scan(lists: DataFrame, asked: DataFrame, blocks: int, groups: int, total: int, tokens: int, k: int) -> DataFrame:
    """item, doc_id and score: the best k of each item in each group of segments."""
    group = F.pmod(F.xxhash64("segment"), F.lit(groups)).alias("g")
    columns = ["segment", "df", "head", "impacts", "body"]
    each = lists.where("term <> ''").join(asked, "term").select("block", group, *columns, "weight", "items")
    nobody = F.array().cast(asked.schema["items"].dataType)
    whole = lists.where("term = ''").select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), group, *columns, F.lit(-1).cast("long").alias("weight"), nobody.alias("items"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found: dict[int, Best] = {}
        for _, rows in pdf.groupby("segment", sort=True):
            about = rows[rows["weight"] < 0].iloc[0]
            ids, no_id, n = np.frombuffer(about["head"], np.int64), np.frombuffer(about["impacts"], bool), np.frombuffer(about["body"], np.int64)
            reach = scale(n, total, tokens)
            of: dict[int, list[tuple[Postings, int]]] = {}
            for r in rows[rows["weight"] >= 0].itertuples(index=False):
                held = Postings(int(r.df), r.head, r.impacts, r.body, reach, total, tokens)
                for item in r.items:
                    of.setdefault(int(item["item"]), []).append((held, int(r.weight)))
                    if item["item"] not in found:
                        found[int(item["item"])] = Best(k, int(item["floor"]))
            for item, mine in of.items():
                wand(mine, found[item], ids, no_id)
        out = [(item, None if z else int(d), int(s)) for item, b in found.items() for d, s, z in zip(b.doc, b.score, b.no_id)]
        return pd.DataFrame({"item": pd.array([x[0] for x in out], "Int64"), "doc_id": pd.array([x[1] for x in out], "Int64"), "score": pd.array([x[2] for x in out], "Int64")})

    return each.unionByName(whole).groupBy("block", "g").applyInPandas(run, "item long, doc_id long, score long")


def rank(index: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score: each item's best k documents of the index, scores above 0."""
    sums = index.where("term = ''").agg(F.sum("df").alias("docs"), F.sum("total").alias("tokens")).first()
    total, tokens = sums["docs"] or 0, sums["tokens"] or 1
    # Items travel under numbers, given once, as they are written.
    of_item = items.select(F.col("item_id"), F.explode(term_column(F.col("text"))).alias("term")).groupBy("item_id").agg(F.collect_set("term").alias("terms"))
    named = cut(of_item.select(F.monotonically_increasing_id().alias("item"), "item_id", "terms"))
    blocks = max(1, -(-named.count() // ITEMS))
    wanted = named.select("item", F.explode("terms").alias("term"))
    documents = index.sparkSession.range(1).select(F.lit("").alias("term"))
    lists = cut(index.join(wanted.select("term").distinct().unionByName(documents), "term"))
    df = lists.where("term <> ''").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(F.log((F.lit(2.0) * total + 2) / (F.lit(2.0) * F.col("df") + 1)) * 1000).cast("long")
    weights = cut(wanted.join(df, "term").select("term", "item", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int").alias("block"), weight.alias("weight")))

    def asked(floors: DataFrame | None) -> DataFrame:
        # A list of at most about ITEMS entries.
        with_floor = weights.withColumn("floor", F.lit(0).cast("long")) if floors is None else weights.join(floors, "item", "left").withColumn("floor", F.coalesce("floor", F.lit(0)).cast("long"))
        return with_floor.groupBy("block", "term", "weight").agg(F.collect_list(F.struct("item", "floor")).alias("items"))

    groups = max(1, -(-total // GROUP_DOCS))
    sampled = F.pmod(F.xxhash64(F.lit(1), "segment"), F.lit(SAMPLE)) == 0
    first = cut(_scan(lists.where(sampled), asked(None), blocks, groups, total, tokens, k))
    order = W.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    floors = first.withColumn("nth", F.row_number().over(order)).where(F.col("nth") == k).select("item", F.col("score").alias("floor"))
    rest = _scan(lists.where(~sampled), asked(floors), blocks, groups, total, tokens, k)
    best = first.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(named.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """rank() over an index built for the purpose."""
    return rank(build(docs), items, k)


#: DuckDB's text of the same, scoring all documents.
SEARCH_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
p AS (SELECT id, doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d),
f AS (SELECT id, doc_id, n, term, count(*) AS tf FROM p GROUP BY ALL),
s AS (SELECT count(DISTINCT id)::BIGINT AS docs, count(*)::BIGINT AS tokens FROM p),
w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM f, s GROUP BY term, docs),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
r AS (SELECT item_id, id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // tokens))))::BIGINT AS score FROM f JOIN w USING (term) JOIN q USING (term), s GROUP BY ALL),
k AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST))::INTEGER AS rank, doc_id, score FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 50
"""
