"""Text and vector search: BM25, cosine, a blend of both, chunks, incremental embedding."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Constants of BM25, weights of the blend, sizes of chunks.
K1, B, W_LEXICAL, W_VECTOR = 1.5, 0.75, 0.4, 0.6
CHUNK, OVERLAP = 1800, 400


def tokens(text: str | Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0), lambda x: x)


def _equals(term: str):
    return lambda x: x == F.lit(term)


def bm25(docs: DataFrame, query: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, bm25 of every document with a query term; repeated query terms count as often as they stand there."""
    import re

    terms = Counter(re.findall("[a-z0-9]+", query.lower()))
    bag = docs.select(key, tokens(F.coalesce(F.col(text), F.lit(""))).alias("bag")).withColumn("dl", F.size("bag"))
    stats = bag.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))  # one row
    # Only the query's terms leave a document, as one small map, so no word of the rest is shuffled.
    hit = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(float(q)).alias("qn"), F.size(F.filter("bag", _equals(t))).alias("tf")) for t, q in sorted(terms.items())])
    tf = bag.select(key, "dl", F.inline(hit)).where("tf > 0")
    df = tf.groupBy("term").agg(F.count("*").alias("df"))  # at most one row a query term
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    part = F.col("qn") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats)).groupBy(key).agg(F.sum(part).alias("bm25"))


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product in double precision, left to right."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(vectors: DataFrame, query: list[float], key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, cosine, for normalised vectors."""
    return vectors.select(key, dot(F.array(*[F.lit(float(x)) for x in query]), F.col(vector)).alias("cosine"))


def hybrid(lexical: DataFrame, semantic: DataFrame, key: str, k: int) -> DataFrame:
    """key, score: each side divided by its greatest value, blended, positive, the k best; ties to the smaller key."""
    both = lexical.join(semantic, key, "full")
    top = both.agg(F.max("bm25").alias("mb"), F.max("cosine").alias("mc"))
    norm = lambda c, m: F.when(F.col(m) > 0, F.coalesce(c, F.lit(0.0)) / F.col(m)).otherwise(0.0)
    score = W_LEXICAL * norm("bm25", "mb") + W_VECTOR * norm("cosine", "mc")
    return both.crossJoin(F.broadcast(top)).select(key, F.bround(score, 6).alias("score")).where("score > 0").orderBy(F.desc("score"), key).limit(k)


#: Where a window may end: behind a paragraph's break, else behind a sentence's period; each with how much of the mark counts for its place.
BORDERS = (("\n\n", 0), (". ", 1))


def _end(text: str, at: int, size: int) -> int:
    """Where the window that begins at a place ends: at the last border of its second half, the better kind first, else when it is full."""
    full = at + size
    if full >= len(text):
        return len(text)
    for mark, counts in BORDERS:
        found = text.rfind(mark, at, full)
        if found >= 0 and found + counts >= at + size // 2:
            return found + len(mark) - counts
    return full


def spans(text: str, size: int = CHUNK, overlap: int = OVERLAP) -> Iterator[tuple[int, int]]:
    """The windows of a text as (begin, end); each begins `overlap` before the last one's end, and the last one ends with the text."""
    begin, end = 0, 0
    while end < len(text):
        begin = max(end - overlap, begin + 1) if end else 0
        end = _end(text, begin, size)
        yield begin, end


def chunk(text: str, size: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """Overlapping windows that end after a paragraph's break, or else a sentence's period, if either stands in their second half."""
    return [text[a:b] for a, b in spans(text, size, overlap)]


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, chunk_index, content_hash, preview of every chunk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, c) for k, t in zip(pdf[key], pdf[text]) for i, c in enumerate(chunk(t or ""))]
            yield pd.DataFrame(rows, columns=[key, "chunk_index", "chunk"])

    out = docs.select(key, text).mapInPandas(run, f"{key} long, chunk_index int, chunk string")
    return out.select(key, "chunk_index", content_hash("chunk").alias("content_hash"), preview("chunk").alias("preview"))


def content_hash(text: str) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.col(text), 256))


def preview(text: str) -> Column:
    return F.replace(F.substring(F.col(text), 1, 120), F.lit("\n"), F.lit(" "))


def carry_forward(new: DataFrame, prior: DataFrame) -> DataFrame:
    """new with status: carried (its content_hash was embedded before) or embed."""
    old = prior.select("content_hash").distinct().withColumn("known", F.lit(True))
    return new.join(old, "content_hash", "left").withColumn("status", F.when(F.col("known"), "carried").otherwise("embed")).drop("known")
