"""Quality rules (operator 4): gradient-boosted trees over document statistics.

Statistics are computed per document from its whole text. The trees are trained here by histogram-based Newton
boosting, with monotonic constraints (a more symbol-laden or more repetitive text can never gain), on a bounded
sample of labelled rows (SAMPLE, taken by a hash of doc_id), and are flattened into arrays of feature,
threshold, child and value, so that a batch is scored by a few numpy gathers a level.

Defined cases: a null text has no words, so it fails the base rules; without any labelled row of either class
the model keeps everything that passes them; repeated rows each get a row, and of a doc_id with several texts the
least is learned from; whole texts of any length are measured; equal gains go to the first feature and threshold; empty tables give
empty results; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import words

#: Statistics, and how the chance of good quality may move with each (1 up, -1 down, 0 either way).
FEATURES = {"log_words": 0, "word_len": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": 0, "digit_share": 0, "letter_share": 0, "bang_share": -1, "pipe_share": -1, "stop_share": 0, "line_words": 0}
SAMPLE, TREES, DEPTH, RATE, BINS, MIN_LEAF, THRESHOLD = 20_000, 60, 3, 0.2, 32, 5, 0.5
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The counts of the base rules, and the model's features."""
    text = text or ""
    w = words(text)
    n = len(w)
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    symbols = sum(map(text.count, "#*$%&|<>"))
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(" \t\n\v\f\r"):
            lines += 1
            dup += line in seen
            seen.add(line)
    repeat = 0
    if n > 2:
        tri = list(zip(w, w[1:], w[2:]))
        once, twice = set(), set()
        if len(set(tri)) < len(tri):
            for t in tri:
                (twice if t in once else once).add(t)
            end = 0  # words before this one are counted already
            for i, t in enumerate(tri):
                if t in twice:
                    repeat += i + 3 - max(end, i)
                    end = i + 3
    size = max(1, chars)
    data = text.encode("utf-8", "surrogatepass")
    kinds = np.bincount(np.frombuffer(data, np.uint8), minlength=256) if data else np.zeros(256, int)
    upper, lower, digit, wide = kinds[65:91].sum(), kinds[97:123].sum(), kinds[48:58].sum(), kinds[192:].sum()
    feats = [np.log1p(n), chars / max(1, n), symbols / size, dup / max(1, lines), repeat / max(1, n), upper / size, digit / size, (upper + lower + wide) / size, kinds[33] / max(1, n), kinds[124] / max(1, n), sum(len(x) < 4 for x in w) / max(1, n), n / max(1, lines)]
    return [n, chars, symbols, dup, repeat], [float(x) for x in feats]


def train(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> dict[str, np.ndarray]:
    """Boosted trees as flat arrays: feature (-1 at a leaf), threshold, left child (right is next), value, root.

    A split on a constrained feature is refused when its sides are in the wrong order, and the middle of its
    two sides bounds everything below, so the whole sum is monotonic.
    """
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = [np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)]  # bin b: x <= edges[b]
    feature, threshold, left, value, roots = [], [], [], [], []
    p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(p0 / (1 - p0)))
    score = np.full(len(y), bias)

    def node() -> int:
        for a, v in ((feature, -1), (threshold, 0.0), (left, 0), (value, 0.0)):
            a.append(v)
        return len(feature) - 1

    def grow(at: int, rows: np.ndarray, g: np.ndarray, h: np.ndarray, lo: float, hi: float, level: int) -> None:
        best_of = lambda a, b: np.clip(-a / (b + 1.0), lo, hi)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        value[at] = float(rate * best_of(total_g, total_h))
        gain_of = lambda a, b, v: -(a * v + 0.5 * (b + 1.0) * v * v)
        base = gain_of(total_g, total_h, best_of(total_g, total_h))
        best = None
        if level < depth and len(rows) >= 2 * MIN_LEAF:
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                b = binned[j][rows]
                cg, ch, cn = (np.bincount(b, weights=v, minlength=len(e) + 1).cumsum()[:-1] for v in (g[rows], h[rows], np.ones(len(rows))))
                vl, vr = best_of(cg, ch), best_of(total_g - cg, total_h - ch)
                gain = gain_of(cg, ch, vl) + gain_of(total_g - cg, total_h - ch, vr) - base
                ok = (cn >= MIN_LEAF) & (len(rows) - cn >= MIN_LEAF)
                if monotone[j]:
                    ok &= monotone[j] * (vr - vl) >= 0
                gain = np.where(ok, gain, -1.0)
                k = int(gain.argmax())
                if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                    best = (gain[k], j, k, vl[k], vr[k])
        if best is None:
            return
        _, j, k, vl, vr = best
        a, b = node(), node()
        feature[at], threshold[at], left[at] = j, float(edges[j][k]), a
        mid = (vl + vr) / 2
        bounds = {0: ((lo, hi), (lo, hi)), 1: ((lo, mid), (mid, hi)), -1: ((mid, hi), (lo, mid))}[monotone[j]]
        goes = binned[j][rows] <= k
        grow(a, rows[goes], g, h, *bounds[0], level + 1)
        grow(b, rows[~goes], g, h, *bounds[1], level + 1)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        roots.append(at := node())
        grow(at, np.arange(len(y)), p - y, p * (1 - p), -4.0, 4.0, 0)
        score = bias + predict_raw(x, {k: np.array(v) for k, v in (("feature", feature), ("threshold", threshold), ("left", left), ("value", value), ("roots", roots))})
    return {"feature": np.array(feature), "threshold": np.array(threshold), "left": np.array(left), "value": np.array(value), "roots": np.array(roots, dtype=int), "bias": np.array(bias)}


def predict_raw(x: np.ndarray, m: dict[str, np.ndarray]) -> np.ndarray:
    """Sum of the leaves that each row reaches, all rows and trees at once."""
    if not len(x) or not len(m["roots"]):
        return np.zeros(len(x))
    at = np.broadcast_to(m["roots"], (len(x), len(m["roots"]))).copy()
    rows = np.arange(len(x))[:, None]
    while True:
        f = m["feature"][at]
        if (f < 0).all():
            return m["value"][at].sum(axis=1)
        step = m["left"][at] + (x[rows, np.maximum(f, 0)] > m["threshold"][at])
        at = np.where(f < 0, at, step)


def good(x: np.ndarray, m: dict[str, np.ndarray] | None) -> np.ndarray:
    """The chance of good quality; 1 without a model."""
    return np.ones(len(x)) if m is None else 1 / (1 + np.exp(-(m["bias"] + predict_raw(x, m))))


def measured(docs: DataFrame, model: dict[str, np.ndarray] | None = None, threshold: float = THRESHOLD, features: bool = False) -> DataFrame:
    """doc_id, the base counts, base_failed, quality and kept of every row; with features, those as an array."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            both = [statistics(t) for t in pdf["text"]]
            out = pd.DataFrame([b for b, _ in both], columns=list(BASE), dtype=np.int64)
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            x = np.array([f for _, f in both], dtype=float).reshape(len(both), len(FEATURES))
            out["base_failed"] = (out["n_words"] < 50) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
            out["quality"] = good(x, model)
            out["kept"] = ~out["base_failed"] & (out["quality"] >= threshold)
            if features:
                out["features"] = list(x)
            yield out

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality double, kept boolean"
    return docs.select("doc_id", "text").mapInPandas(run, schema + ", features array<double>" * features)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict[str, np.ndarray] | None:
    """Trees from at most `sample` labelled documents, chosen by a hash of doc_id; the sample bounds what comes to the driver."""
    few = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("label"))
    few = few.orderBy(F.xxhash64(F.lit(4), "doc_id"), "doc_id").limit(sample)
    # One text a doc_id, so that repeated ids do not pass the bound.
    known = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    rows = measured(known, features=True).select("doc_id", "features").join(F.broadcast(few), "doc_id").collect()
    rows = sorted(rows, key=lambda r: (r.doc_id, r.features))
    y = np.array([r.label for r in rows], dtype=float)
    if not len(y) or y.min() == y.max():
        return None
    return train(np.array([r.features for r in rows]), y, list(FEATURES.values()))


def filter_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The verdict on every document, by trees trained on the labels."""
    return measured(docs, fit(docs, labels))
