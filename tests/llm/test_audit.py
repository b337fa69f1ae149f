"""Token counts against the library, and the filter audit against a walk through every order."""

import random
from itertools import permutations

import pytest

from lodestone.llm import audit, tokencount

POOL = list(map(chr, [*range(0x250), 0x3A3, 0x4E00, 0x4E01, 0x1F600, 0x2028, 0x3000, 0x661, 0x301, 0xFFFD]))


def texts():
    r = random.Random(3)
    fixed = [None, "", " ", "a" * 5000, "ab" * 20_000, "日本語" * 2000, " " * 3000 + "x", "<|endoftext|>", "a<|endoftext|><|endoftext|>  b <|endoftext", "it's I'LL we'll\n\n  now"]
    return fixed + ["".join(r.choice(POOL) for _ in range(r.randint(1, 200))) for _ in range(400)]


def test_token_counts_equal_the_library(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = [(i if i else None, t, 7) for i, t in enumerate(texts() + texts()[:30])]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(3)
    got = sorted(tokencount.count(df, path).collect(), key=str)
    want = [(d, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t, _ in rows]
    assert got == sorted([(d, b, n, n > 1024) for d, b, n in want], key=str)
    assert tokencount.count(df.limit(0), path).count() == 0


def test_merging_equals_a_plain_loop():
    P = pytest.importorskip("public_tokenizers")
    counter = tokencount.Counter(open(P.path("byte_bpe_50k.json"), encoding="utf-8").read())
    rank = dict(zip(counter.keys.tolist(), counter.ranks.tolist()))
    r = random.Random(5)
    pieces = ["".join(r.choice("aeinrst ") for _ in range(r.randint(1, 40))).encode() for _ in range(300)] + [b"aaa", b"aaaaaaaaaaaaa", bytes(range(256))]
    for piece, n in zip(pieces, counter.survivors(pieces).tolist()):
        ids = [int(counter.first[b]) for b in piece]
        while True:
            found = min(((rank[k], i) for i, k in enumerate(a * int(counter.width) + b for a, b in zip(ids, ids[1:])) if k in rank), default=None)
            if found is None:
                break
            ids[found[1] : found[1] + 2] = [int(counter.made[found[0]])]
        assert len(ids) == n


def walked(docs, labels):
    """Every order, document by document."""
    def fails(doc, text):
        words = text.encode().split()
        at = ""
        at += "A" * (len(words) < 50)
        at += "B" * (100 * len(set(words)) < 65 * len(words))
        at += "C" * (100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text))
        at += "D" * any(c in "#$%&*|" for c in text)
        at += "E" * any(d is not None and doc is not None and d < doc and (t or "") == text for d, t, _ in docs)
        return at

    rows = [(fails(d, t or ""), s or "", *(max([x[k] == 1 for x in labels if x[0] == d and d is not None], default=False) for k in (1, 2))) for d, t, s in docs]
    out = {}
    for order in map("".join, permutations("ABCDE")):
        for part in {r[1] for r in rows}:
            left = [r for r in rows if r[1] == part]
            mine = left
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                failing = [r for r in mine if f in r[0]]
                out[part, order, k + 1] = [len(left), len(gone), len(failing) - len(gone), sum(r[0] == f for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone), f]
    total = {}
    for (part, _, _), v in out.items():
        total[part, v[6]] = total.get((part, v[6]), 0) + v[1]
    return sorted((*k, *v[:6], total[k[0], v[6]]) for k, v in out.items())


def test_audit_equals_the_walk(spark):
    r = random.Random(1)
    base = [" ".join(r.choice(["al", "Be", "ce", "DE", "#e", "fé", f"w{r.randint(0, 60)}"]) for _ in range(r.randint(0, 90))) for _ in range(25)]
    base += [None, "", " \t\n", "one " * 60, "\x0bX\x0c y\x85z", "word " * 20_000]
    docs = [(i % 70 if i % 9 else None, r.choice(base), r.choice(["a", "b", None, "", "hot"])) for i in range(150)]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in list(range(0, 70, 2)) + [4, 4, None]]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, source string, mask int, part string").repartition(4)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(tuple(x) for x in audit.audit(df, lab).collect())
    assert got == walked(docs, labels)
    assert audit.audit(df.limit(0), lab).count() == 0
    assert all(x.good_lost == 0 for x in audit.audit(df, lab.limit(0)).collect())
