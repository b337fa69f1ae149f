"""Language ID (operator 1): language-bitmask n-gram filters.

A Bloom filter whose slots hold a bitmask of languages instead of a bit (bit-sliced): one lookup of an n-gram
ANDs its slots and yields all languages that contain it. Per language, the popcount over a text's n-grams is
corrected for the filter's false positives, and the largest corrected share decides.

The n-grams (3 and 4 letters, words joined by one space, lower case) are learned from a bounded sample of different labelled texts (about SAMPLE a
language, those with the least hashes); the filter has 2**SLOTS_LOG2 slots of as many words as the languages need (WORD each,
at most MAX_LANGUAGES languages, those with most labelled rows), so the model does not grow with the corpus. An n-gram must stand in MIN_DF texts of a language, in fewer where the
language has few: in a quarter of them. Defined cases: a null text, or one without a letter, is "und" with score 0; without any
labelled row all texts are "und"; ties go to the first language in order; texts of any length are used whole;
repeated rows each get a row, but a text is learned from once; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE, SLOTS_LOG2, HASHES, ORDERS, MIN_DF = 1000, 21, 2, (3, 4), 3
#: A language holds an n-gram only if its rate there is at least this part of its highest rate in any language.
RATIO = 0.5
#: Languages to a word of the masks, and in all: those with most labelled texts.
WORD, MAX_LANGUAGES = 62, 992
_NOT_LETTERS = re.compile(r"[\W\d_]+")
#: What \w holds beside letters, digits and _: numbers like one half or Roman eight. Built by that rule.
_NUMBERS = re.compile("[" + "".join(c for c in map(chr, range(0x110000)) if c.isalnum() and not c.isalpha() and not c.isdecimal()) + "]+")


def grams(text: str | None, orders: tuple[int, ...] = ORDERS) -> np.ndarray:
    """Hashes of all n-grams of the text's letters, with repeats."""
    s = _NOT_LETTERS.sub(" ", (text or "").lower())
    if not s.replace(" ", "").isalpha():  # rare: numbers that are no digits
        s = " ".join(_NUMBERS.sub(" ", s).split())
    s = f" {s.strip()} "
    if s.isspace():
        return np.zeros(0, np.uint64)
    c = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out, h = [], c.copy()
    for n in range(2, max(orders) + 1):
        if len(c) < n:
            break
        h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :]
        h ^= h >> np.uint64(29)
        if n in orders:
            out.append(h * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(n))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def slots(h: np.ndarray, log2: int, hashes: int) -> list[np.ndarray]:
    """Where the filter keeps each hash."""
    m = np.uint64((1 << log2) - 1)
    h = h ^ (h >> np.uint64(31))
    step = (h * np.uint64(0x94D049BB133111EB)) >> np.uint64(20) | np.uint64(1)
    return [((h + np.uint64(k) * step) >> np.uint64(7)) & m for k in range(hashes)]


def fit(docs: DataFrame, sample: int = SAMPLE, log2: int = SLOTS_LOG2, min_df: int = MIN_DF) -> dict:
    """languages and the table of bitmasks, from the labelled rows of docs (text, lang)."""
    known = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    # At most MAX_LANGUAGES rows.
    names = sorted(r.lang for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect())
    place = docs.sparkSession.createDataFrame([(n, i // WORD, 1 << (i % WORD)) for i, n in enumerate(names)], "lang string, word int, bit long")
    known = known.join(F.broadcast(place.select("lang")), "lang", "left_semi")
    # Of each language's different texts those with the least hashes, by a cut-off from their number: no group is ever ranked in one task.
    known = known.withColumn("th", F.xxhash64(F.lit(1), "text"))
    texts = known.select("lang", "th").distinct()
    most = texts.groupBy("lang").agg(F.count("*").alias("n"))
    unit = F.pmod(F.xxhash64(F.lit(2), "th"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    ids = texts.join(most, "lang").where(unit * F.col("n") < sample).select("lang", "th")
    rows = known.join(F.broadcast(ids), ["lang", "th"]).groupBy("lang", "th").agg(F.min("text").alias("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df: Counter = Counter()
        n: Counter = Counter()
        for pdf in batches:
            for text, lang in zip(pdf["text"], pdf["lang"]):
                n[lang] += 1
                df.update((g, lang) for g in np.unique(grams(text)).view(np.int64).tolist())
        df.update({(0, lang): k for lang, k in n.items()})  # gram 0: the documents themselves
        if df:
            yield pd.DataFrame([(g, lang, k) for (g, lang), k in df.items()], columns=["gram", "lang", "df"])

    each = rows.select("text", "lang").mapInPandas(count, "gram long, lang string, df long").groupBy("gram", "lang").agg(F.sum("df").alias("df"))
    # One row a language.
    sizes = each.where("gram = 0").select("lang", F.col("df").alias("n")).join(F.broadcast(place), "lang")
    rated = each.where("gram <> 0").join(F.broadcast(sizes), "lang").withColumn("rate", F.col("df") / F.col("n"))
    most = rated.groupBy("gram").agg(F.collect_list(F.struct("df", "n", "rate", "word", "bit")).alias("in"), F.max("rate").alias("most"))
    enough = F.col("x.df") >= F.least(F.lit(min_df), F.ceil(F.col("x.n") / 4))
    held = most.select("gram", "most", F.explode("in").alias("x")).where(enough & (F.col("x.rate") >= RATIO * F.col("most")))
    held = held.groupBy("gram", F.col("x.word").alias("word")).agg(F.bit_or("x.bit").alias("mask"))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = slots(pdf["gram"].to_numpy().view(np.uint64), log2, HASHES)
            yield pd.DataFrame({"word": np.tile(pdf["word"].to_numpy(), HASHES), "slot": np.concatenate(at).astype(np.int64), "mask": np.tile(pdf["mask"].to_numpy(), HASHES)})

    # At most 2**log2 rows a word come back, whatever the corpus.
    got = held.mapInPandas(spread, "word int, slot long, mask long").groupBy("word", "slot").agg(F.bit_or("mask").alias("mask")).toPandas()
    width = np.uint8 if len(names) <= 8 else np.uint64
    bits = np.zeros((max(1, -(-len(names) // WORD)), 1 << log2), dtype=width)
    bits[got["word"].to_numpy(dtype=np.int64), got["slot"].to_numpy(dtype=np.int64)] = got["mask"].to_numpy(dtype=np.int64).astype(width)
    # A plane's chance of a false positive: all of a gram's slots set by others.
    fill = [float(((bits[i // WORD] >> width(i % WORD)) & width(1)).mean()) for i in range(len(names))]
    return {"languages": names, "bits": bits, "log2": log2, "false": [f**HASHES for f in fill]}


def decide(text: str | None, model: dict) -> tuple[str, float, float]:
    """Language, score (the winner's share of all corrected counts) and coverage (its share of the text's n-grams)."""
    h = grams(text)
    if not len(h) or not model["languages"]:
        return "und", 0.0, 0.0
    at = slots(h, model["log2"], HASHES)
    at = [a.astype(np.int64) for a in at]
    n, hits = len(h), []
    for first, bits in enumerate(model["bits"]):
        mask = bits[at[0]]
        for a in at[1:]:
            mask = mask & bits[a]
        some = min(WORD, len(model["languages"]) - first * WORD)
        if mask.dtype == np.uint8:
            by = np.bincount(mask, minlength=256)
            hits += [int(by[np.arange(256) >> i & 1 == 1].sum()) for i in range(some)]
        else:
            hits += [int((mask >> np.uint64(i) & np.uint64(1)).sum()) for i in range(some)]
    share = np.array([max(0.0, (x / n - f) / (1 - f)) if f < 1 else 0.0 for x, f in zip(hits, model["false"])])
    best = int(share.argmax())
    total = float(share.sum())
    return model["languages"][best], float(share[best] / total) if total > 0 else 0.0, float(share[best])


def identify(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """docs with lang_pred, lang_score and lang_coverage."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    @F.pandas_udf("lang_pred string, lang_score double, lang_coverage double")
    def predict(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decide(t, shared.value) for t in s], columns=["lang_pred", "lang_score", "lang_coverage"])

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "lang_score", "lang_coverage")]
    # The row travels as one column, so names cannot clash; columns called like the new ones are replaced.
    rows = docs.select(F.struct(F.lit(0).alias("_"), *kept).alias("row"), predict(F.col(f"`{text}`")).alias("lang_id"))
    return rows.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in ("lang_pred", "lang_score", "lang_coverage")], "lang_id.*")


def keep_known(docs: DataFrame, model: dict, least: float = 0.2) -> DataFrame:
    """docs without those that have no letter or whose n-grams are mostly of no known language; without a model only the former go."""
    got = identify(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text"), model)
    if not model["languages"]:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return got.where((F.col("lang_pred") != "und") & (F.col("lang_coverage") >= least)).select(*[F.col(f"row.`{c}`") for c in docs.columns])
