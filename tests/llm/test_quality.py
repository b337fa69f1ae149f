"""Quality rules: flat arrays against a plain walk of the trees, monotonic bounds, base counts against the contract, and labels left out."""

import math
import random
from pathlib import Path

import numpy as np
import pytest

from lodestone.llm import quality

SF = Path("/root/testdata/sf0.01")


def walked(row, m):
    """One row's chance by walking each tree from its root, node by node."""
    total = float(m["bias"])
    for root in m["roots"].tolist():
        at = root
        while m["feature"][at] >= 0:
            at = int(m["left"][at]) + (1 if row[int(m["feature"][at])] > m["threshold"][at] else 0)
        total += float(m["value"][at])
    return 1 / (1 + math.exp(-total))


def fixture(n=600, seed=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, len(quality.FEATURES))), 1)
    y = (x[:, 0] - x[:, 2] + 0.5 * x[:, 1] * x[:, 5] + rng.normal(size=n) > 0).astype(float)
    return x, y, quality.train(x, y, list(quality.FEATURES.values()), trees=25)


def test_flat_arrays_equal_a_walk():
    x, _, m = fixture()
    edge = np.where(np.isin(np.arange(x.shape[1]), m["feature"]), 0.0, 1.0)
    rows = np.vstack([x, x + 0.05, np.tile(edge, (2, 1)), np.full((1, x.shape[1]), 1e9), np.full((1, x.shape[1]), -1e9)])
    # Values that stand exactly on a threshold go left.
    rows[0, int(m["feature"][m["roots"][0]])] = m["threshold"][m["roots"][0]]
    assert quality.good(rows, m) == pytest.approx([walked(r, m) for r in rows.tolist()], abs=1e-12)
    assert (m["feature"] >= 0).sum() > 50 and set(m["left"][m["feature"] >= 0].tolist()).isdisjoint(m["roots"].tolist())


def test_constrained_features_are_monotonic_everywhere():
    x, _, m = fixture(seed=5)
    for j, sign in enumerate(quality.FEATURES.values()):
        if sign:
            for row in x[::40]:
                line = np.tile(row, (60, 1))
                line[:, j] = np.linspace(-4, 4, 60)
                assert (np.diff(sign * quality.good(line, m)) >= -1e-12).all()


def counts(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    three = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = {t for t in three if three.count(t) > 1}
    held = {k for i, t in enumerate(three) if t in many for k in (i, i + 1, i + 2)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(held)]


def test_base_counts_equal_the_contract():
    r = random.Random(4)
    bits = ["a", "b", "é", "#", "<x>", " ", " ", "\n", "\t", "\x0b", "\x85", "|", "two words", "日本"]
    for text in [None, "", " \n ", "a a a a", "x\ny\nx\nx\n\n\n"] + ["".join(r.choice(bits) for _ in range(r.randint(0, 60))) for _ in range(400)]:
        assert [int(v) for v in quality.statistics(text)[0]] == counts(text), text


@pytest.mark.skipif(not SF.exists(), reason="needs the test tables")
def test_labels_left_out_are_told():
    import duckdb

    rows = duckdb.sql(f"SELECT d.doc_id, d.text, l.quality FROM '{SF}/documents.parquet' d JOIN '{SF}/labels.parquet' l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL ORDER BY d.doc_id").fetchall()
    x = np.array([quality.statistics(t)[1] for _, t, _ in rows])
    y = np.array([q for *_, q in rows], float)
    out = np.arange(len(rows)) % 4 == 0
    m = quality.train(x[~out], y[~out], list(quality.FEATURES.values()))
    told = (quality.good(x[out], m) >= quality.THRESHOLD) == (y[out] == 1)
    print("held out:", told.sum(), "of", out.sum(), "majority", max(y[out].mean(), 1 - y[out].mean()))
    assert told.mean() >= 0.9 and told.mean() > max(y[out].mean(), 1 - y[out].mean())
