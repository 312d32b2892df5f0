"""Byte-level BPE by segment trees over the ranks of adjacent pairs.

Each pre-token is a row of symbols. A segment tree holds, for each symbol, the rank of the pair that it forms
with the next one; the root is the leftmost pair of the lowest rank. A merge changes three leaves and their
paths to the root, until no pair has a rank. Pre-tokens of up to ``WIDE`` bytes are encoded many at a time, one
tree in each row of an array; longer ones have a tree of their own, so a text without blanks costs n log n.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from vectorloom.llm.common import hide_nulls, own_columns, ship, show_nulls

WIDE = 64
#: Characters of text encoded together, and pre-tokens that a worker keeps; both only bound memory.
CHUNK, CACHED = 2_000_000, 600_000
#: The pre-tokens of byte-level BPE, as published with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encodes and decodes as the tokenizers library does with the same file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, letters = whole["model"], byte_letters()
        vocab = model["vocab"]
        added = {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.tokens: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if t not in added and all(c in letters for c in t)}
        self.tokens |= {i: t.encode() for t, i in added.items()}
        self.added = {t: np.array([i], "<u4").tobytes() for t, i in added.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.words = regex.compile(PATTERN)
        self.first = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.first[b] = vocab[c]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.rank_of = dict(zip(keys.tolist(), range(len(pairs)), strict=True))
        self.none = len(pairs)
        self.known: dict[str, bytes] = {}

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.none)

    def encode_long(self, data: bytes) -> np.ndarray:
        """One pre-token by one tree."""
        n = len(data)
        symbol = self.first[np.frombuffer(data, np.uint8)].tolist()
        size = 1 << max(1, (n - 1).bit_length())
        none = self.none * size
        tree = [none] * (2 * size)
        get = self.rank_of.get
        for i in range(n - 1):
            r = get(symbol[i] << 32 | symbol[i + 1])
            if r is not None:
                tree[size + i] = r * size + i
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, value: int) -> None:
            k = size + i
            tree[k] = value
            k >>= 1
            while k:
                least = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == least:
                    break
                tree[k] = least
                k >>= 1

        def link(i: int) -> None:
            r = get(symbol[i] << 32 | symbol[after[i]]) if after[i] < n else None
            put(i, none if r is None else r * size + i)

        while tree[1] < none:
            rank, i = divmod(tree[1], size)
            j = after[i]
            symbol[i] = int(self.merged[rank])
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            put(j, none)
            link(i)
            if before[i] >= 0:
                link(before[i])
        out, i = [], 0
        while i < n:
            out.append(symbol[i])
            i = after[i]
        return np.array(out, np.int64)

    def encode_many(self, items: list[bytes], size: int) -> list[bytes]:
        """Pre-tokens of at most ``size`` bytes, a power of two: a tree in each row."""
        w = len(items)
        length = np.fromiter(map(len, items), np.int64, w)
        raw = np.zeros((w, size), np.uint8)
        inside = np.arange(size) < length[:, None]
        raw[inside] = np.frombuffer(b"".join(items), np.uint8)
        symbol = np.zeros((w, size + 1), np.int64)
        symbol[:, :size] = self.first[raw]
        none = self.none * size
        tree = np.full((w, 2 * size), none, np.int64)
        rank = self.pair_ranks(symbol[:, : size - 1], symbol[:, 1:size])
        rank[~inside[:, 1:]] = self.none
        tree[:, size : 2 * size - 1] = np.where(rank < self.none, rank * size + np.arange(size - 1), none)
        k = size
        while k > 1:
            k //= 2
            tree[:, k : 2 * k] = np.minimum(tree[:, 2 * k : 4 * k : 2], tree[:, 2 * k + 1 : 4 * k : 2])
        # the place after the last symbol is ``size``; the one before the first is ``size`` too, a spare column
        after = np.tile(np.arange(1, size + 1), (w, 1))
        after[np.arange(w), length - 1] = size
        after = np.concatenate([after, np.full((w, 1), size)], 1)
        before = np.tile(np.arange(-1, size), (w, 1))
        before[:, 0] = size
        alive = inside.copy()

        def put(rows: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
            node = size + at
            tree[rows, node] = value
            while len(node) and node[0] > 1:  # all leaves are as deep
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        def link(rows: np.ndarray, at: np.ndarray) -> None:
            to = after[rows, at]
            r = self.pair_ranks(symbol[rows, at], symbol[rows, to])
            put(rows, at, np.where((to < size) & (r < self.none), r * size + at, none))

        rows = np.flatnonzero(tree[:, 1] < none)
        while len(rows):
            rank, i = np.divmod(tree[rows, 1], size)
            j = after[rows, i]
            k = after[rows, j]
            symbol[rows, i] = self.merged[rank]
            after[rows, i] = k
            before[rows, k] = i
            alive[rows, j] = False
            put(rows, j, np.full(len(rows), none))
            link(rows, i)
            p = before[rows, i]
            has = p < size
            link(rows[has], p[has])
            rows = rows[tree[rows, 1] < none]
        ids = symbol[:, :size][alive].astype("<u4").tobytes()
        ends = np.cumsum(alive.sum(1) * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def learn(self, words: Iterable[str]) -> None:
        """Encodes the pre-tokens that aren't known yet."""
        if len(self.known) > CACHED:
            self.known.clear()
        by_size: dict[int, list[str]] = {}
        for x in words:
            n = len(x.encode())
            by_size.setdefault(0 if n > WIDE else 1 << max(1, (n - 1).bit_length()), []).append(x)
        for size, group in by_size.items():
            if size == 0:
                self.known |= {x: self.encode_long(x.encode()).astype("<u4").tobytes() for x in group}
                continue
            for k in range(0, len(group), 1 << 15):
                part = group[k : k + (1 << 15)]
                self.known |= zip(part, self.encode_many([x.encode() for x in part], size), strict=True)

    def encode_batch(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        split: list[list[str]] = []
        for text in texts:
            pieces: list[str] = []
            for part in self.cut.split(text) if self.cut else [text]:
                if part in self.added:
                    pieces.append(part)
                elif part:
                    pieces += self.words.findall(part)
            split.append(pieces)
        new = {x for pieces in split for x in pieces}
        if len(self.known) > CACHED:
            self.known.clear()
        self.learn(new - self.known.keys() - self.added.keys())
        # a pre-token can't hold an added token, as texts are cut at those first
        known = self.known | self.added if any(t in new for t in self.added) else self.known
        for pieces in split:
            yield b"".join(map(known.__getitem__, pieces))

    def decode(self, ids: bytes) -> str:
        get = self.tokens.get
        return b"".join([get(i, b"") for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One for each Python worker and file."""
    return Codec(path)


def chunks(texts: list[str], limit: int) -> Iterator[list[int]]:
    """Runs of positions whose texts have about ``limit`` characters together."""
    run, held = [], 0
    for i, text in enumerate(texts):
        if run and held + len(text) > limit:
            yield run
            run, held = [], 0
        run.append(i)
        held += len(text)
    if run:
        yield run


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (binary, little-endian 32-bit), decoded of each row; a null text counts as an empty one.

    Rows are taken one by one, so repeated rows and null doc_ids get a row each; other columns are ignored.
    """
    ship(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for frame in frames:
            texts = frame["text"].fillna("").tolist()
            for part in chunks(texts, CHUNK):
                ids = list(c.encode_batch([texts[i] for i in part]))
                yield frame[["doc_id", "_null_doc_id"]].iloc[part].assign(ids=ids, decoded=[c.decode(x) for x in ids])

    rows = hide_nulls(own_columns(docs, "doc_id", "text"), "doc_id")
    return show_nulls(rows.mapInPandas(run, "doc_id long, _null_doc_id boolean, ids binary, decoded string"), "doc_id")
