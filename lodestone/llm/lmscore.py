"""LM scoring (operator 10): a weighted backoff automaton over word n-grams.

Two scores a text. Base: add-one unigrams. Model: n-grams of up to ORDER tokens, counted with all their occurrences over
the token streams of the training texts and smoothed by Dirichlet priors, order upon order:
P(w | h) = (c(hw) + K * P(w | h')) / (c(h) + K), where h' is h without its first token. The lowest order takes DISCOUNT off
each known token's count: P(w) = (c(w) - DISCOUNT) / N; what this frees is the chance of an unknown token, one event as in the base.
As an automaton: a state for each context h, an arc for each n-gram hw that occurs, with log10 P(w | h), leading to
the longest state that the new context ends in, and a failure arc with log10 K / (c(h) + K) to h'. A text is
traversed once from left to right, from the state of the text's boundary to its end token; the state is carried
from token to token, and the weights of the arcs taken are summed.

How it is spread: texts are packed into chunks of about CHUNK bytes as they are read, so a frequent key, source or
text never decides where a row goes. A chunk lists its different words, and its different n-grams as hashes, with their counts in
its training texts; each goes to the bucket that its hash names. A bucket adds up what all chunks said and
answers each with the totals, in the order asked. A chunk then builds the part of the automaton that its own texts
can reach and traverses them. Nothing of the corpus is broadcast or brought to the driver but three sums; a bucket
gets each n-gram at most once from a chunk. Words are compared as they are, so the base is exact. Longer n-grams are told apart by hashes
whose width grows with the corpus: the chance that an n-gram shares its count with another stays under 2 ** -SPARE.

Defined cases: a null or empty text is one end token; without training texts every token has chance 1
(V = N = 0); alike rows get alike scores, each a row of its own; a null doc_id counts as training; a text longer than a
chunk is a chunk by itself; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, remainder, words

ORDER, CHUNK, PER_BUCKET, SPARE = 3, 8 << 20, 2_000_000, 13
#: Strength K of the prior of orders 2, 3, ... (the last holds for all beyond).
STRENGTH = (500.0, 20.0)
DISCOUNT = 0.75


# --- bytes that travel ---------------------------------------------------------------------------------------


def pack_small(x: np.ndarray) -> bytes:
    """Numbers of which most are under 255, a byte each; the others follow in full."""
    low = np.minimum(x, 255).astype(np.uint8)
    return struct.pack("<I", len(x)) + low.tobytes() + x[low == 255].astype("<i8").tobytes()


def unpack_small(data: bytes) -> np.ndarray:
    (n,) = struct.unpack_from("<I", data)
    out = np.frombuffer(data, np.uint8, n, 4).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<i8", -1, 4 + n)
    return out


def pack_sorted(x: np.ndarray, spread: int) -> bytes:
    """Ascending numbers below spread: low bytes as they are, the rest by their steps, so that a step fits a byte."""
    low = max(0, math.ceil((math.log2(max(2, spread)) - math.log2(len(x) + 1) - 5) / 8))
    planes = x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :low].T.tobytes()
    high = (x >> np.uint64(8 * low) if low < 8 else np.zeros_like(x)).astype(np.int64)
    return struct.pack("<BI", low, len(x)) + planes + pack_small(np.diff(high, prepend=0))


def unpack_sorted(data: bytes) -> np.ndarray:
    low, n = struct.unpack_from("<BI", data)
    out = np.zeros((n, 8), np.uint8)
    out[:, :low] = np.frombuffer(data, np.uint8, low * n, 5).reshape(low, n).T
    high = unpack_small(data[5 + low * n :]).cumsum().astype(np.uint64)
    return out.view("<u8").reshape(-1) | (high << np.uint64(8 * low) if low < 8 else np.uint64(0))


def pack_ids(x: np.ndarray) -> bytes:
    """Numbers under 2 ** 32, in byte planes, compressed."""
    return zstandard.compress(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def unpack_ids(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


# --- chunks ---------------------------------------------------------------------------------------------------


class _Numbers(dict):
    """Numbers things in order of first sight."""

    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        return n


class Chunk:
    """Texts as one stream of word numbers; 0 is the boundary, which stands before and after every text."""

    def __init__(self, stream: np.ndarray, sizes: np.ndarray, train: np.ndarray, names: list[bytes]) -> None:
        self.stream, self.sizes, self.train, self.names = stream, sizes, train, names

    @classmethod
    def of(cls, texts: list[str | None], train: list[bool]) -> Chunk:
        number = _Numbers()
        number[b""]  # the boundary; no word is empty
        get = number.__getitem__
        parts, sizes = [], []
        for text in texts:
            w = words(text, lower=True)
            parts += [np.zeros(1, np.int64), np.fromiter(map(get, w), np.int64, len(w)), np.zeros(1, np.int64)]
            sizes.append(len(w))
        stream = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        # Frequent words get small numbers, which take less room.
        often = np.bincount(stream, minlength=len(number))
        order = np.r_[0, 1 + np.argsort(-often[1:], kind="stable")]
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        names = list(number)
        return cls(place[stream], np.array(sizes, np.int64), np.array(train, bool), [names[i] for i in order.tolist()])

    def pack(self) -> dict:
        return {
            "tokens": int(self.sizes.sum()) + len(self.sizes),
            "stream": pack_ids(self.stream),
            "sizes": pack_ids(self.sizes),
            "train": self.train.tobytes(),
            "names": zstandard.compress(b"\n".join(self.names), 3),
        }

    @classmethod
    def unpack(cls, row) -> Chunk:
        return cls(unpack_ids(row["stream"]), unpack_ids(row["sizes"]), np.frombuffer(row["train"], bool), zstandard.decompress(row["names"]).split(b"\n"))

    def analyse(self, order: int = ORDER) -> None:
        """All n-grams of the stream.

        at[n]: which n-gram of order n + 1 ends at each place of the stream (-1: none, as it would cross a boundary).
        first[n]: for each n-gram a place where it ends. own[n]: its occurrences in training texts. hashes[n]: its hash.
        """
        s, self.order = self.stream, order
        starts = np.r_[0, (self.sizes + 2).cumsum()[:-1]].astype(np.int64)
        since = np.arange(len(s)) - np.repeat(starts, self.sizes + 2)
        counted = np.repeat(self.train, self.sizes + 2)
        self.starts = starts
        self.word_hash = np.array([xxhash.xxh64_intdigest(w) for w in self.names], np.uint64)
        predicted = since > 0
        self.at, self.first, self.own, self.hashes = [s], [None], [np.bincount(s[predicted & counted], minlength=len(self.names))], [self.word_hash]
        for n in range(1, order):
            place = np.flatnonzero(since >= n)
            context, last = self.at[-1][place - 1], s[place]
            _, first, which = np.unique(context * len(self.names) + last, return_index=True, return_inverse=True)
            at = np.full(len(s), -1, np.int64)
            at[place] = which
            first = place[first]
            h = self.hashes[-1][self.at[-1][first - 1]] * np.uint64(0x9E3779B97F4A7C15) + self.word_hash[s[first]]
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            self.at.append(at)
            self.first.append(first)
            self.own.append(np.bincount(which[counted[place]], minlength=len(first)))
            self.hashes.append(h ^ (h >> np.uint64(32)))

    def asks(self, width: int, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each bucket: its number, the words and the n-grams (over all orders from 2, joined) that it counts, and the n-grams' hashes."""
        shift, ends = np.uint64(64 - width), [-(-(b << width) // buckets) for b in range(buckets + 1)]
        edges = np.array([min(e, 2**64 - 1) for e in ends], np.uint64)
        w, g = self.word_hash >> shift, np.concatenate([np.zeros(0, np.uint64), *self.hashes[1:]]) >> shift
        by_w, by_g = np.argsort(w, kind="stable"), np.argsort(g, kind="stable")
        w, g = w[by_w], g[by_g]
        cut_w, cut_g = np.searchsorted(w, edges[:-1]).tolist() + [len(w)], np.searchsorted(g, edges[:-1]).tolist() + [len(g)]
        for b in range(buckets):
            mine = slice(cut_g[b], cut_g[b + 1])
            yield b, by_w[cut_w[b] : cut_w[b + 1]], by_g[mine], g[mine] - edges[b]


def chunked(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """Chunks (part, tokens, train_tokens, doc_ids, known_ids and the packed texts) of docs (doc_id, text, held_out)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, seq = TaskContext.get().partitionId(), 0
        ids, texts, train, held = [], [], [], 0

        def row() -> pd.DataFrame:
            c = Chunk.of(texts, train)
            known = np.array([i is not None and i == i for i in ids], bool)
            plain = np.array([i if k else 0 for i, k in zip(ids, known)], "<i8")
            trained = int((c.sizes[c.train] + 1).sum())
            return pd.DataFrame([{"part": (task << 32) + seq, "train_tokens": trained, "doc_ids": plain.tobytes(), "known_ids": known.tobytes(), **c.pack()}])

        for pdf in batches:
            for i, text, out in zip(pdf["doc_id"].astype("Int64").tolist(), pdf["text"], pdf["held_out"]):
                ids.append(None if i is pd.NA else i)
                texts.append(text)
                train.append(not out)
                held += len(text or "") + 1
                if held >= size:
                    yield row()
                    seq += 1
                    ids, texts, train, held = [], [], [], 0
        if ids:
            yield row()

    return docs.mapInPandas(run, "part long, train_tokens long, doc_ids binary, known_ids binary, tokens long, stream binary, sizes binary, train binary, names binary")


# --- counting -------------------------------------------------------------------------------------------------


def asked(chunks: DataFrame, order: int, width: int, buckets: int) -> DataFrame:
    """One row for each chunk and bucket that has something to count for it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, row in pdf.iterrows():
                c = Chunk.unpack(row)
                c.analyse(order)
                own = np.concatenate([np.zeros(0, np.int64), *c.own[1:]])
                out = []
                for b, w, g, h in c.asks(width, buckets):
                    if len(w) or len(g):
                        names = zstandard.compress(b"\n".join([c.names[i] for i in w.tolist()]), 1)
                        out.append((b, row["part"], len(w), names, pack_small(c.own[0][w]), pack_sorted(h, (1 << width) // buckets + 1), pack_small(own[g])))
                yield pd.DataFrame(out, columns=["bucket", "part", "n_words", "names", "word_own", "grams", "gram_own"])

    return chunks.mapInPandas(run, "bucket int, part long, n_words long, names binary, word_own binary, grams binary, gram_own binary")


def answered(asks: DataFrame) -> DataFrame:
    """For each row asked the totals over all chunks, in the order asked; types: of the bucket's words, how many occur in training (in one of its rows)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        number, named, said = _Numbers(), [], []
        for n, names, own in zip(pdf["n_words"], pdf["names"], pdf["word_own"]):
            w = zstandard.decompress(names).split(b"\n") if n else []
            named.append(np.fromiter(map(number.__getitem__, w), np.int64, len(w)))
            said.append(unpack_small(own))
        total = np.bincount(np.concatenate(named), weights=np.concatenate(said), minlength=len(number)).astype(np.int64)
        hashes = [unpack_sorted(g) for g in pdf["grams"]]
        _, which = np.unique(np.concatenate(hashes), return_inverse=True)
        own = np.concatenate([unpack_small(x) for x in pdf["gram_own"]])
        sums = np.bincount(which, weights=own).astype(np.int64) if len(which) else own
        ends = np.cumsum([len(h) for h in hashes])
        return pd.DataFrame(
            {
                "bucket": pdf["bucket"],
                "part": pdf["part"],
                "word_counts": [pack_small(total[x]) for x in named],
                "gram_counts": [pack_small(sums[which[e - len(h) : e]]) for e, h in zip(ends, hashes)],
                "types": [int((total > 0).sum()), *repeat(0, len(pdf) - 1)],
            }
        )

    return asks.groupBy("bucket").applyInPandas(run, "bucket int, part long, word_counts binary, gram_counts binary, types long")


# --- the automaton --------------------------------------------------------------------------------------------


class Automaton:
    """Arcs and failure arcs for the texts of a chunk.

    A state is a context: an n-gram of up to order - 1 tokens. Order n of arcs holds, for each n-gram of n + 1 tokens,
    the weight of the arc from its context (NONE where there is no arc), order n of fails the weight of the failure arc
    of each n-gram as a state, to the state without its first token; it is free where the context never occurred.
    """

    NONE = 1.0

    def __init__(self, chunk: Chunk, counts: list[np.ndarray], total: int, types: int, strength: tuple = STRENGTH, discount: float = DISCOUNT) -> None:
        self.chunk = chunk
        self.base = np.log10((counts[0] + 1.0) / (total + types + 1.0))
        chance = np.where(counts[0] > 0, counts[0] - discount, discount * types) / total if total else np.ones(len(counts[0]))
        self.arcs, self.fails = [np.log10(chance)], []
        for n in range(1, chunk.order):
            k = strength[min(n, len(strength)) - 1]
            first = chunk.first[n]
            of = counts[n - 1][chunk.at[n - 1][first - 1]]
            chance = (counts[n] + k * chance[chunk.at[n - 1][first]]) / (of + k)
            self.arcs.append(np.where(counts[n] > 0, np.log10(chance), self.NONE))
            self.fails.append(np.log10(k / (counts[n - 1] + k)))

    def traverse(self, lo: int, hi: int) -> float:
        """The weight of the stream's tokens from lo to hi, after the boundary at lo - 1."""
        at = self.chunk.at
        arcs = [a[g[lo:hi]].tolist() if len(a) else [self.NONE] * (hi - lo) for a, g in zip(self.arcs, at)]
        fails = [f[g[lo - 1 : hi - 1]].tolist() for f, g in zip(self.fails, at)]
        weight, depth, deepest = 0.0, min(1, self.chunk.order - 1), self.chunk.order - 1
        if deepest == 2:  # the same as below, without its inner lists
            for a1, a2, a3, f1, f2 in zip(*arcs, *fails):
                if depth == 2:
                    if a3 <= 0.0:
                        weight += a3
                        continue
                    weight += f2
                if a2 <= 0.0 and depth:
                    weight += a2
                    depth = 2
                else:
                    weight += f1 + a1 if depth else a1
                    depth = 1
            return weight
        for i in range(hi - lo):
            while depth and arcs[depth][i] > 0.0:
                depth -= 1
                weight += fails[depth][i]  # no arc: the failure arc to the state without its first token
            weight += arcs[depth][i]
            depth = min(depth + 1, deepest)
        return weight


def score(docs: DataFrame, order: int = ORDER, chunk: int = CHUNK, per_bucket: int = PER_BUCKET, strength: tuple = STRENGTH, discount: float = DISCOUNT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    held = remainder("doc_id", 7) == 2
    chunks = cut(chunked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held_out")), chunk))
    sums = chunks.agg(F.sum("tokens").alias("tokens"), F.sum("train_tokens").alias("train")).first()
    tokens, total = int(sums.tokens or 0), int(sums.train or 0)
    width = min(64, max(16, (tokens * order).bit_length() + SPARE))
    buckets = max(1, -(-tokens * order // per_bucket))
    answers = cut(answered(asked(chunks, order, width, buckets)))
    types = int(answers.agg(F.sum("types")).first()[0] or 0)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        c = Chunk.unpack(left.iloc[0])
        c.analyse(order)
        got = {b: (w, g) for b, w, g in zip(right["bucket"], right["word_counts"], right["gram_counts"])}
        ends = np.cumsum([0, *(len(h) for h in c.hashes[1:])])
        word_counts, gram_counts = np.zeros(len(c.names), np.int64), np.zeros(int(ends[-1]), np.int64)
        for b, w, g, _ in c.asks(width, buckets):
            if b in got:
                word_counts[w], gram_counts[g] = unpack_small(got[b][0]), unpack_small(got[b][1])
        counts = [word_counts, *(gram_counts[a:b] for a, b in zip(ends, ends[1:]))]
        a = Automaton(c, counts, total, types, strength, discount)
        ids = np.frombuffer(left["doc_ids"].iloc[0], "<i8").tolist()
        known_ids = np.frombuffer(left["known_ids"].iloc[0], bool).tolist()
        known, rows = counts[0] > 0, []
        for i, k, out, lo, n in zip(ids, known_ids, (~c.train).tolist(), (c.starts + 1).tolist(), (c.sizes + 1).tolist()):
            mine = c.stream[lo : lo + n]
            rows.append((i if k else None, out, n, int(known[mine].sum()), total, math.fsum(a.base[mine].tolist()), a.traverse(lo, lo + n)))
        frame = pd.DataFrame(rows, columns=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
        return frame.astype({"doc_id": "Int64"})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return chunks.groupBy("part").cogroup(answers.drop("types").groupBy("part")).applyInPandas(run, schema)
