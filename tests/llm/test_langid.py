"""Language ID: masks of several words, rare languages, and the filter against exact sets of n-grams."""

import random
from collections import Counter

import numpy as np

from lodestone.llm import langid


def speakers(n, texts, seed=5):
    """n languages of own syllables, and that many texts of each."""
    r = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    out = []
    for k in range(n):
        syllables = ["".join(r.choice(letters) for _ in range(3)) for _ in range(12)]
        out += [(f"l{k:03}", " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(60))) for _ in range(texts)]
    return out


def test_seventy_languages_of_three_texts(spark):
    rows = [(i, t, lang) for i, (lang, t) in enumerate(speakers(70, 3))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df.where("doc_id % 3 <> 2"), log2=18)
    assert len(model["languages"]) == 70 and model["bits"].shape[0] == 2
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert all(got[i].lang_pred == lang and 0 < got[i].lang_score <= 1 for i, _, lang in rows)


def test_languages_of_a_single_text_are_known(spark):
    df = spark.createDataFrame([(0, "abc abd abe", "aa"), (1, "xyz xyw xyv", "bb")], "doc_id long, text string, lang string")
    model = langid.fit(df, log2=14)
    assert langid.decide("xyz xyw", model)[0] == "bb" and langid.decide("abd abe", model)[0] == "aa"


def test_the_filter_equals_exact_sets(spark):
    rows = [(i, t, lang) for i, (lang, t) in enumerate(speakers(66, 12, 9))]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), log2=21)
    df, n = Counter(), Counter()
    for _, t, lang in rows:
        n[lang] += 1
        df.update((g, lang) for g in set(langid.grams(t).tolist()))
    rate = {k: v / n[k[1]] for k, v in df.items()}
    best = Counter()
    for (g, _), x in rate.items():
        best[g] = max(best[g], x)
    held = {k for k, v in df.items() if v >= 3 and rate[k] >= langid.RATIO * best[k[0]]}
    wrong = missed = 0
    for _, t, _ in rows[::40]:
        h = langid.grams(t)
        at = [a.astype(np.int64) for a in langid.slots(h, 21, langid.HASHES)]
        for i, lang in enumerate(model["languages"]):
            plane = model["bits"][i // langid.WORD]
            has = (plane[at[0]] & plane[at[1]]) >> np.uint64(i % langid.WORD) & np.uint64(1)
            exact = np.array([(g, lang) in held for g in h.tolist()])
            missed += int((exact & (has == 0)).sum())
            wrong += int((~exact & (has == 1)).sum())
    assert missed == 0 and wrong <= 20  # two of 2**21 slots set by others: a chance of about one in a million
