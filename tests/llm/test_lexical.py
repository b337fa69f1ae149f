"""Ranked search against scoring every document, blocks against their postings, and what the bounds skip."""

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(docs, items, k):
    held = [(d, Counter(TERM.findall(lower(t or "")))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    N, L = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item in {i for i, _ in items}:
        asked = {t for i, text in items if i == item for t in TERM.findall(lower(text or ""))} & df.keys()
        scores = []
        for d, c in held:
            n = sum(c.values())
            m = 50 + 50 * n * N // L
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in asked if t in c)
            if s > 0:
                scores.append((-s, d is not None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def test_search_equals_scoring_all(spark):
    r = random.Random(2)
    vocabulary = [f"{a}{b}" for a in ("the", "Of", "é", "日", "x1", "Q") for b in ("", "a", "zz", "7", "ñ")]
    skewed = lambda n: " ".join(vocabulary[min(len(vocabulary) - 1, int(r.expovariate(0.15)))] + r.choice(["", ".", "-", "_\n"]) for _ in range(n))
    docs = [(i if i % 50 else None, skewed(r.randint(0, 40))) for i in range(700)] + [(1000 + i, "the Of the") for i in range(90)] + [(2000, None), (2001, ""), (2002, " .,\t"), (2003, skewed(70_000)), (1000, "the Of the")]
    items = [(i, skewed(r.randint(1, 12))) for i in range(12)] + [(3, "Qzz 日"), (None, "日 x17"), (20, None), (21, "nowhere"), (22, "the")]
    df = spark.createDataFrame([(*x, 1, 2) for x in docs], "doc_id long, text string, score int, rank int").repartition(3)
    asked = spark.createDataFrame([(*x, "y") for x in items], "item_id long, text string, term string")
    for options in ({}, {"segment_docs": 37}, {"segment_bytes": 900}):
        got = lexical.rank(lexical.build(df, **options), asked, 20)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted((tuple(x) for x in got.collect()), key=str) == brute(docs, items, 20)
    assert lexical.search(df.limit(0), asked).count() == 0 and lexical.search(df, asked.limit(0)).count() == 0
    assert lexical.search(df.where(F.col("doc_id") == 2002), asked).count() == 0


def test_terms_are_the_same_in_the_jvm(spark):
    texts = ["Ab-cD é_É 1a", "İıſK x\x80y\x7fz", "", " \n", "日本-語", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(F.coalesce(lexical.term_column(F.col("t")), F.array().cast("array<string>")).alias("x")).collect()
    assert [sorted(x.x) for x in rows] == [sorted({b.decode() for b in lexical.terms(t)}) for t in texts]


def lists_of(spread, seed=0, documents=20_000):
    rng = np.random.default_rng(seed)
    n = rng.integers(20, 400, documents)
    out, plain = [], []
    for chance in spread:
        doc = np.flatnonzero(rng.random(documents) < chance)
        tf = np.minimum(rng.geometric(0.6, len(doc)), 70_000)
        tf[rng.random(len(doc)) < 0.002] += 60_000 if len(plain) % 2 else 300
        df, ((head, _), (pairs, _), (body, _)) = lexical.packed(np.zeros(len(doc), np.int64), doc, tf, n[doc])
        assert df.tolist() == [len(doc)]
        out.append(lexical.Postings(len(doc), head.tobytes(), pairs.tobytes(), body.tobytes(), lexical.scale(n, documents, int(n.sum())), documents, int(n.sum())))
        plain.append((doc, tf))
    return out, plain, n


def test_blocks_hold_their_postings_and_maxima():
    lists, plain, n = lists_of([0.5, 0.02, 0.0005, 0.9])
    for x, (doc, tf) in zip(lists, plain):
        score = lexical.impact(tf, lexical.scale(n, len(n), int(n.sum()))[doc])
        got = x.open(np.ones(len(x.last), bool))
        assert (got[0] == doc).all() and (got[1] == score).all()
        starts = np.arange(0, len(doc), lexical.BLOCK)
        assert (x.most == np.maximum.reduceat(score, starts)).all() and (x.last == doc[np.minimum(starts + lexical.BLOCK, len(doc)) - 1]).all()


def test_bounds_skip_blocks_and_lose_nothing():
    lists, plain, n = lists_of([0.6, 0.3, 0.001, 0.0008], 1)
    ids, no_id = np.arange(len(n)) * 3, np.zeros(len(n), bool)
    weights = [40, 900, 6500, 7000]
    total = np.zeros(len(n), np.int64)
    for (doc, tf), w in zip(plain, weights):
        total[doc] += w * lexical.impact(tf, lexical.scale(n, len(n), int(n.sum()))[doc])
    best = lexical.Best(10, 0)
    needed = lexical.wand(list(zip(lists, weights)), best, ids, no_id)
    want = sorted(range(len(n)), key=lambda d: (-total[d], d))[:10]
    assert best.doc.tolist() == [3 * d for d in want] and best.score.tolist() == [total[d] for d in want]
    opened = sum(int(x.ready.sum()) for x in lists)
    assert opened <= needed and opened < 0.6 * sum(len(x.ready) for x in lists)
