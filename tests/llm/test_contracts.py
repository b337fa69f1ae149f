"""Contracts of operators that no other file compares: targets and draws, clashing names, copies, letters, top-k by SQL."""

import random
from collections import Counter

import pytest

from lodestone.llm import langid, mixing, simhash


def words(n, seed, pool="abcdefgh"):
    r = random.Random(seed)
    return " ".join("".join(r.choice(pool) for _ in range(r.randint(2, 6))) for _ in range(n))


def wanted_targets(sizes, share=1.5, cap=2.0):
    """Water filling by bisection on the height of one weight."""
    weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    total, lo, hi = share * sum(sizes), 0.0, 1e12
    for _ in range(300):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(cap * s, mid * w) for s, w in zip(sizes, weights)) < total else (lo, mid)
    return [min(cap * s, hi * w) for s, w in zip(sizes, weights)]


def test_mixing_meets_its_targets(spark):
    r = random.Random(4)
    sources = ["é", "b", "z", None, "B", "hot"]
    rows = [(i, words(r.randint(0, 30), i), r.choice(sources) if i % 3 else "hot", i, 1, "a.b") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, passes long, mix_taken int, `x.y` string").repartition(5)
    got = mixing.mix(df).collect()
    assert len(got) == 900 and got[0].asDict().keys() == {"doc_id", "text", "source", "passes", "x.y", *mixing.ADDED}
    names = sorted({r[2] for r in rows} - {None}) + [None]
    sizes = {n: sum(len(t.split()) for _, t, s, *_ in rows if s == n) for n in names}
    goal = dict(zip(names, wanted_targets([sizes[n] for n in names])))
    for n in names:
        mine = [x for x in got if x.source == n]
        assert all(x.mix_source_size == sizes[n] and x.mix_target == pytest.approx(goal[n]) for x in mine)
        assert all(x.mix_taken == len(x.mix_shards) * x.mix_size <= 2 * x.mix_size and all(0 <= s < mixing.SHARDS for s in x.mix_shards) for x in mine)
        assert {len(x.mix_shards) for x in mine if x.mix_size} <= {int(goal[n] // sizes[n]), min(2, int(goal[n] // sizes[n]) + 1)}
        # Off by no more than half of the largest document.
        assert abs(sum(x.mix_taken for x in mine) - goal[n]) <= max(x.mix_size for x in mine) / 2
    again = mixing.mix(df.repartition(2)).collect()
    assert Counter((x.doc_id, tuple(x.mix_shards)) for x in got) == Counter((x.doc_id, tuple(x.mix_shards)) for x in again)
    out = mixing.emit(df)
    assert out.columns == df.columns and Counter(x.doc_id for x in out.collect()) == Counter({x.doc_id: len(x.mix_shards) for x in got if x.mix_shards})


def test_small_sources_come_near_their_targets(spark):
    r = random.Random(9)
    rows = [(i, words(r.choice([3, 20, 90, 400]), i), f"s{i % 12:02}") for i in range(120)] + [(500 + i, "one and the same text here", "s03") for i in range(300)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)).collect()
    for n in {x.source for x in got}:
        mine = [x for x in got if x.source == n]
        assert abs(sum(x.mix_taken for x in mine) - mine[0].mix_target) <= max(x.mix_size for x in mine) / 2 and all(x.mix_taken <= 2 * x.mix_size for x in mine)


def test_leaves_split_the_quotas_exactly():
    cut = mixing.split_tree([1000, 7, 0, 31], 64, 3)
    assert cut.shape == (64, 4) and cut.sum(axis=0).tolist() == [1000, 7, 0, 31] and (cut >= 0).all()
    assert cut.sum(axis=1).max() - cut.sum(axis=1).min() <= 6


def test_one_row_of_each_component_stays(spark):
    a, b, c = words(40, 1), words(40, 2), words(40, 3)
    rows = [(1, a, "x"), (1, a, "y"), (1, a, "y"), (1, b, "x"), (2, a, "x"), (None, c, "x"), (None, c, "x"), (None, b, "x"), (5, "", "x"), (6, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `k.a` string")
    got = [(r.doc_id, r.text) for r in simhash.keep_one(df).collect()]
    assert sorted(got, key=str) == sorted([(1, a), (1, b), (None, c), (5, "")], key=str)
    assert simhash.keep_one(df).columns == df.columns and simhash.keep_one(df.limit(0)).count() == 0


def test_numbers_are_not_letters_and_names_do_not_clash(spark):
    texts = [words(40, i, ("abcdmno", "efghpqr")[i % 2]) for i in range(40)] + ["½ ²³ Ⅷ ① 12", None, words(9000, 1, "efghpqr")]
    df = spark.createDataFrame([(i, t, ["en", "de"][i % 2] if i < 40 else None, "old", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, lang_pred string, `a.b` int")
    model = langid.fit(df, log2=14)
    rows = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert [rows[i].lang_pred for i in range(43)] == [["en", "de"][i % 2] for i in range(40)] + ["und", "und", "de"]
    assert rows[40].lang_score == 0 and langid.keep_known(df, model).columns == df.columns
    same = {r.doc_id: r.lang_score for r in langid.identify(df, langid.fit(df.unionByName(df).repartition(3), log2=14)).collect()}
    assert same == {i: r.lang_score for i, r in rows.items()}  # copies teach nothing
