"""LM scoring against direct backoff recursion over counted n-grams."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import lmscore

B = None  # a text's boundary


def texts_of(n=60):
    r = random.Random(3)
    pool = ["the", "The", "cat", "sat", "on", "mat", "é", "dog"]
    base = [" ".join(r.choice(pool) for _ in range(r.randint(0, 25))) for _ in range(n)]
    return [*base, *base[:3], None, "", " \t\n", "zebra quagga " * 3, "unseen" * 9000, "cat " * 5000]


def held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2


def tokens(text):
    return [w.decode() for w in (text or "").encode().lower().split()]


def recursion(rows, order, strength, discount):
    """log10 chance of a text, from the definition alone."""
    c = Counter()
    for doc, text in rows:
        if not held(doc):
            s = [B, *tokens(text), B]
            c.update(tuple(s[i - n : i + 1]) for i in range(1, len(s)) for n in range(min(order, i + 1)))
            c["contexts", (B,)] += 1
    total = sum(k for g, k in c.items() if len(g) == 1)
    types = sum(len(g) == 1 for g in c)

    def chance(h, w):
        if not h:
            return 1.0 if not total else (c[(w,)] - discount) / total if c[(w,)] else discount * types / total
        k = strength[min(len(h), len(strength)) - 1]
        return (c[(*h, w)] + k * chance(h[1:], w)) / (c[h] + k)

    def score(text):
        s = [B, *tokens(text), B]
        return sum(math.log10(chance(tuple(s[max(0, i - order + 1) : i]), s[i])) for i in range(1, len(s)))

    base = lambda text: sum(math.log10((c[(w,)] + 1) / (total + types + 1)) for w in [*tokens(text), B])
    known = lambda text: sum(c[(w,)] > 0 for w in [*tokens(text), B])
    return score, base, known, total


@pytest.mark.parametrize(("order", "chunk", "per_bucket"), [(3, 400, 50), (3, 1 << 20, 10**6), (1, 300, 40), (2, 300, 40), (4, 300, 40)])
def test_scores_equal_the_recursion(spark, order, chunk, per_bucket):
    rows = [*enumerate(texts_of()), (None, "the cat sat"), (None, "the cat sat"), (5, "on the mat"), (5, "on the mat")]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, part string, tokens int").repartition(3)
    score, base, known, total = recursion(rows, order, lmscore.STRENGTH, lmscore.DISCOUNT)
    got = lmscore.score(df, order=order, chunk=chunk, per_bucket=per_bucket).collect()
    want = sorted((str(i), held(i), len(tokens(t)) + 1, known(t), total, base(t), score(t)) for i, t in rows)
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [x for g in got for x in g[5:]] == pytest.approx([x for w in want for x in w[5:]], rel=1e-9)


def test_order_of_words_matters_and_repeats_show(spark):
    r = random.Random(1)
    pool = [f"w{i}" for i in range(40)]
    once = [" ".join(r.choice(pool) for _ in range(30)) for _ in range(40)]
    ids = [i for i in range(200) if not held(i)][:42]
    out = next(i for i in range(200) if held(i))
    rows = list(zip(ids, [*once, once[0], once[0]]))
    mixed = once[1].split()
    r.shuffle(mixed)
    df = spark.createDataFrame([*rows, (out, " ".join(mixed))], "doc_id long, text string")
    got = {x.doc_id: x.score for x in lmscore.score(df).collect()}
    assert got[out] < got[ids[1]] and got[ids[0]] > max(got[i] for i in ids[1:40])


def test_no_training_texts_and_no_texts(spark):
    out = next(i for i in range(200) if held(i))
    df = spark.createDataFrame([(out, "a b")], "doc_id long, text string")
    (r,) = lmscore.score(df).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)
    assert lmscore.score(df.limit(0)).count() == 0


def test_packed_numbers_come_back():
    r = random.Random(2)
    for n, spread in ((0, 5), (1, 2), (300, 300), (1000, 2**40), (50, 2**64 - 1), (4000, 2**20)):
        x = np.array(sorted(r.randrange(spread) for _ in range(n)), np.uint64)
        assert lmscore.unpack_sorted(lmscore.pack_sorted(x, spread)).tolist() == x.tolist()
        y = np.array([r.choice((0, 1, 254, 255, 256, 10**12)) for _ in range(n)], np.int64)
        assert lmscore.unpack_small(lmscore.pack_small(y)).tolist() == y.tolist()
        z = np.array([r.randrange(2**32) for _ in range(n)], np.int64)
        assert lmscore.unpack_ids(lmscore.pack_ids(z)).tolist() == z.tolist()
