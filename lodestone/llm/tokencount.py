"""Token counts (operator 12): byte-level BPE by rank-synchronous merging of ragged arrays.

Texts are cut at special tokens (one token each, anywhere in a text, longest first), the rest into pre-tokens by the file's
pattern. The different pre-tokens of a batch lie behind one another in one numpy array of symbols, with a flag where a
sequence begins. Each round looks up the rank of every neighbouring pair, takes the lowest rank of each sequence and
joins all its occurrences, from the left, in all sequences at once; sequences without a pair left go out with the
number of symbols that survive. Sequences are also cut between bytes that stand side by side in no vocabulary string,
where nothing can be joined: so a run of letters without spaces falls into short sequences, exactly.

Counts of pre-tokens of up to KEPT characters are kept in each worker up to a bound that empties the store; arrays hold at most CHUNK symbols, or one
pre-token. Rows need no shuffle, so no group can be hot. Defined cases: a null text is empty (0 bytes, 0 tokens); texts of any
length are counted whole; repeated rows each get a row; a tie of equal pairs goes to the left; an empty table gives an
empty result; columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .bpe import byte_symbols

#: Fixed value: the pattern of pre-tokens that the byte-level files are made for.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LIMIT, CACHE, KEPT, CHUNK = 1024, 400_000, 64, 2_000_000
#: Rank of a pair that cannot be joined.
NONE = np.int64(1) << 40


class Counter:
    """Counts tokens by one tokenizer file's JSON."""

    def __init__(self, source: str) -> None:
        spec = json.loads(source)
        vocab: dict[str, int] = spec["model"]["vocab"]
        pairs = [p if isinstance(p, list) else p.split(" ") for p in spec["model"]["merges"]]
        self.width = np.int64(max(vocab.values()) + 1)
        keys = np.array([vocab[a] * int(self.width) + vocab[b] for a, b in pairs], np.int64)
        # Of a pair listed twice the first counts.
        self.keys, first = np.unique(keys, return_index=True)
        self.ranks = first.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        symbols = byte_symbols()
        self.first = np.array([vocab[x] for x in symbols], np.int64)
        #: Whether two bytes stand side by side in any vocabulary string.
        self.near = np.zeros((256, 256), bool)
        byte_of = {x: i for i, x in enumerate(symbols)}
        for token in vocab:
            if all(x in byte_of for x in token):
                for a, b in zip(token, token[1:]):
                    self.near[byte_of[a], byte_of[b]] = True
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.pieces = regex.compile(PIECES)
        self.known: dict[str, int] = {}

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols."""
        key = a * self.width + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def survivors(self, pieces: list[bytes]) -> np.ndarray:
        """Number of symbols left of each piece; pieces are not empty."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        of = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
        new = np.ones(len(data), bool)
        new[1:] = (of[1:] != of[:-1]) | ~self.near[data[:-1], data[1:]]
        symbol = self.first[data]
        out = np.zeros(len(pieces), np.int64)
        while len(symbol):
            starts = np.flatnonzero(new)
            # The rank of each symbol with the next one of its sequence.
            rank = np.full(len(symbol), NONE)
            joint = np.flatnonzero(~new[1:])
            rank[joint] = self.rank(symbol[joint], symbol[joint + 1])
            least = np.minimum.reduceat(rank, starts)
            seq = np.cumsum(new) - 1
            done = (least == NONE)[seq]
            if done.any():
                out += np.bincount(of[done], minlength=len(out))
                symbol, of, new, rank, seq = (x[~done] for x in (symbol, of, new, rank, seq))
                if not len(symbol):
                    break
            hit = rank == least[seq]
            # In a run of neighbouring hits, which are pairs of one symbol with itself, every second one counts, from the left.
            at = np.flatnonzero(hit)
            apart = np.ones(len(at), bool)
            apart[1:] = np.diff(at) > 1
            nth = np.arange(len(at)) - np.maximum.accumulate(np.where(apart, np.arange(len(at)), 0))
            at = at[nth % 2 == 0]
            symbol = symbol.copy()
            symbol[at] = self.made[rank[at]]
            stay = np.ones(len(symbol), bool)
            stay[at + 1] = False
            symbol, of, new = symbol[stay], of[stay], new[stay]
        return out

    def learn(self, pieces: list[str]) -> None:
        """Counts pre-tokens that are not known yet, CHUNK symbols at a time."""
        part: list[str] = []
        size = 0
        for p in [*pieces, None]:
            if part and (p is None or size + len(p) > CHUNK):
                self.known.update(zip(part, self.survivors([x.encode("utf-8", "surrogatepass") for x in part]).tolist()))
                part, size = [], 0
            if p is not None:
                part.append(p)
                size += len(p)

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text."""
        cut: list[list[str]] = []
        specials: list[int] = []
        for text in texts:
            text = text or ""
            if self.cut is not None and any(s in text for s in self.special):
                parts = self.cut.split(text)
                specials.append(len(parts) - 1)
                cut.append([p for part in parts for p in self.pieces.findall(part)])
            else:
                specials.append(0)
                cut.append(self.pieces.findall(text))
        if len(self.known) >= CACHE:
            self.known.clear()
        new = list({p for pieces in cut for p in pieces} - self.known.keys())
        self.learn(new)
        known = self.known
        got = [n + sum(map(known.__getitem__, pieces)) for n, pieces in zip(specials, cut)]
        for p in new:
            if len(p) > KEPT:
                del known[p]
        return got


_held: dict[int, Counter] = {}


def held(source: str) -> Counter:
    """One counter a worker process."""
    key = hash(source)
    if key not in _held:
        _held[key] = Counter(source)
    return _held[key]


def _groups(texts: list[str | None], most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about that many characters."""
    lo = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= most:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def count(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row; path is the tokenizer file's place."""
    source = open(path, encoding="utf-8").read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = held(source)
        for batch in batches:
            texts = batch["text"].to_pylist()
            tokens = [n for lo, hi in _groups(texts, CHUNK) for n in counter.counts(texts[lo:hi])]
            size = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
            columns = [batch["doc_id"], pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
