"""BPE encoding and decoding (operator 5) with the vocabulary of a public tokenizer file.

Encoding: special tokens are cut out of the raw text; the rest is normalised (NFC, white space to one space,
lower case) and cut into pieces; each piece's bytes are symbols of a doubly linked list. A priority queue of
(merge rank, position) picks the lowest rank, leftmost first; entries whose symbols have changed since are
skipped as stale. Decoding concatenates vocabulary strings (this file has no decoder, so with a space between).

The vocabulary (a fixed 1.7 MB) travels with the function; pieces are cached in each worker up to a bound that
empties the cache. Defined cases: a null text is empty (no ids, empty decoding); very long pieces cost
n log n; ties between equal pairs go to the left.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

#: The pieces, as the tokenizer file states them.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Entries of a worker's cache; rows of a batch that are returned at once.
CACHE, SLICE = 250_000, 256


def byte_symbols() -> list[str]:
    """The printable stand-in of every byte, by the usual rule: printable Latin-1 stays, the rest follow from 256."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


class WordBPE:
    """An encoder and decoder over one tokenizer file's JSON."""

    def __init__(self, source: str) -> None:
        spec = json.loads(source)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.width = len(self.vocab) + 1
        #: Rank of a pair of ids (as one number), and what each rank makes.
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault(self.vocab[a] * self.width + self.vocab[b], rank)
            self.made.append(self.vocab[a + b])
        symbols = byte_symbols()
        self.inner = [self.vocab[x] for x in symbols]
        self.final = [self.vocab[x + self.end] for x in symbols]
        self.pieces = regex.compile(PIECES)
        self.space = regex.compile(r"\s+")
        self.cut = regex.compile("|".join(f"({regex.escape(s)})" for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.cache: dict[str, tuple[bytes, str]] = {}

    def merge(self, piece: str) -> list[int]:
        """Ids of one piece."""
        data = piece.encode("utf-8", "surrogatepass")
        ids = [self.inner[b] for b in data]
        if not ids:
            return ids
        ids[-1] = self.final[data[-1]]
        n, width, rank_of = len(ids), self.width, self.ranks.get
        after = [*range(1, n), -1]
        queue = []  # rank * n + position
        for i in range(n - 1):
            r = rank_of(ids[i] * width + ids[i + 1])
            if r is not None:
                queue.append(r * n + i)
        if not queue:
            return ids
        before = list(range(-1, n - 1))
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            rank, i = divmod(pop(queue), n)
            j = after[i]
            if j < 0 or ids[i] < 0 or rank_of(ids[i] * width + ids[j]) != rank:
                continue  # stale: the pair that stands here now is another
            ids[i], ids[j] = made, _ = self.made[rank], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                r = rank_of(made * width + ids[k])
                if r is not None:
                    push(queue, r * n + i)
            h = before[i]
            if h >= 0:
                r = rank_of(ids[h] * width + made)
                if r is not None:
                    push(queue, r * n + h)
        return [x for x in ids if x >= 0]

    def normal(self, text: str) -> str:
        """NFC and lower case character by character; white space is cut away next."""
        s = text if text.isascii() or unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
        # Without context: a capital sigma is always the plain small one.
        return s.replace("Σ", "σ").lower()

    def look(self, run: str) -> tuple[bytes, str]:
        """Of a run without white space: its ids (little-endian, 4 bytes each) and its tokens joined by a space."""
        pieces = self.pieces.findall(run)
        if len(pieces) == 1:
            ids = self.merge(pieces[0])
            got = (b"".join([x.to_bytes(4, "little") for x in ids]), " ".join([self.names[x] for x in ids]))
        else:
            parts = [self.cache.get(p) or self.look(p) for p in pieces]
            got = (b"".join([a for a, _ in parts]), " ".join([b for _, b in parts]))
        if len(self.cache) >= CACHE:
            self.cache.clear()
        if len(run) < 64:
            self.cache[run] = got
        return got

    def plain(self, text: str) -> list[tuple[bytes, str]]:
        """look() of each run; no piece spans white space, so runs are independent."""
        text = self.normal(text)
        # str.split() also cuts at four separators that the file's white space lacks.
        odd = not text.isprintable() and any(c in text for c in "\x1c\x1d\x1e\x1f")
        runs = self.space.split(text) if odd else text.split()
        get, look = self.cache.get, self.look
        return [get(r) or look(r) for r in runs if r]

    def both(self, text: str | None) -> tuple[bytes, str]:
        """The whole text's ids as bytes, and their decoding."""
        text = text or ""
        if self.cut is None or not any(s in text for s in self.special):
            got = self.plain(text)
        else:
            got = []
            for part in self.cut.split(text):
                if part in self.special:
                    got.append((self.special[part].to_bytes(4, "little"), part))
                elif part:
                    got += self.plain(part)
        return b"".join([a for a, _ in got]), " ".join([b for _, b in got])

    def encode(self, text: str | None) -> list[int]:
        data = self.both(text)[0]
        return [int.from_bytes(data[i : i + 4], "little") for i in range(0, len(data), 4)]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.names[i] for i in ids if i in self.names)


_held: dict[int, WordBPE] = {}


def held(source: str) -> WordBPE:
    """One encoder a worker process."""
    key = hash(source)
    if key not in _held:
        _held[key] = WordBPE(source)
    return _held[key]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded_chars (code points of the decoded text) of every row; path is the tokenizer file's place."""
    source = open(path, encoding="utf-8").read()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = held(source)
        for whole in batches:
            for lo in range(0, len(whole), SLICE):
                pdf = whole.iloc[lo : lo + SLICE]
                ids, chars = [], []
                for text in pdf["text"]:
                    a, b = bpe.both(text)
                    ids.append(np.frombuffer(a, "<i4"))
                    chars.append(len(b))
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": [len(x) for x in ids], "ids": ids, "decoded_chars": chars})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_tokens long, ids array<int>, decoded_chars long")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256; ids and decoded texts stay in the worker."""
    source = open(path, encoding="utf-8").read()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = held(source)
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                a, b = bpe.both(text)
                rows.append((doc, len(a) // 4, hashlib.sha256(a).hexdigest(), hashlib.sha256(b.encode("utf-8", "surrogatepass")).hexdigest()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
