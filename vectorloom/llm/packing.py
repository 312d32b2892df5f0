"""Best-fit packing of token sequences under several capacities.

Texts become pieces of at most ``capacity`` tokens, and pieces are packed into sequences by vector best-fit: a
sequence has residual capacities of tokens, documents and attention cost (the sum of squared lengths), and a
piece, longest first, goes to the sequence that can hold it under every constraint and fits it best, by the
weighted norm of what is left or by the weighted dot product of residual and demand.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.common import hide_nulls, materialise, own_columns, ship, show_nulls
from vectorloom.llm.words import split, spread, text_slices

#: Words and stems that a worker keeps the ids of, about 200 bytes each; bounds memory, not results.
KEPT = 1_500_000


@dataclass(frozen=True)
class Capacity:
    tokens: int = 4096
    #: By default these two never bind before the tokens do, so that sequences are as few as they can be.
    documents: int = 4096
    attention: int = 4096 * 4096
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    #: "norm": least residual norm; "dot": largest dot product of residual and demand.
    rule: str = "norm"
    #: Pieces that one task packs; at most one sequence in so many pieces stays partly empty for it.
    group_pieces: int = 32_768


def best_fit(lengths: np.ndarray, cap: Capacity) -> np.ndarray:
    """Number of the sequence of each piece, from 0; pieces are taken longest first, equal ones in their order."""
    limit = np.array([cap.tokens, cap.documents, cap.attention], float)
    weight = np.array(cap.weights)
    demand = np.stack([lengths, np.ones(len(lengths)), lengths.astype(float) ** 2], 1)
    if len(lengths) and (demand > limit).any():
        raise ValueError("a piece is larger than a sequence")
    need, out = demand / limit, np.empty(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    least = lengths.min() if len(lengths) else 0
    left, name, n, made = np.empty((3, 1024)), np.empty(1024, np.int64), 0, 0
    for i in order:
        d, best = need[i], -1
        if n:
            free = left[:, :n] - d[:, None]
            fits = (free >= -1e-12).all(0)
            if cap.rule == "dot":
                score = np.where(fits, (left[:, :n] * (weight * d)[:, None]).sum(0), -1.0)
                best = int(score.argmax())
            else:
                score = np.where(fits, (free * free * weight[:, None]).sum(0), np.inf)
                best = int(score.argmin())
            if not fits[best]:
                best = -1
        if best < 0:
            if n == left.shape[1]:
                left, name = np.concatenate([left, np.empty_like(left)], 1), np.concatenate([name, np.empty_like(name)])
            left[:, n], name[n] = 1.0, made
            best, n, made = n, n + 1, made + 1
        left[:, best] -= d
        out[i] = name[best]
        if left[0, best] * cap.tokens < least - 1e-6 or left[1, best] * cap.documents < 1 - 1e-6:  # full: the last one takes its place
            n -= 1
            left[:, best], name[best] = left[:, n], name[n]
    return out


class WordTokens:
    """Ids of words from a tokenizer that drops white space, so that each run between blanks stands alone."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        def opened() -> Tokenizer:
            found = Tokenizer.from_file(path)
            found.no_padding()
            found.no_truncation()
            return found

        # the second is the model alone, for runs of letters that normaliser and pre-tokeniser would leave whole
        self.tokenizer, self.plain = opened(), opened()
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        vocab = self.tokenizer.get_vocab()
        #: Ids that end a word.
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.kept = KEPT
        self.clear()

    def clear(self) -> None:
        #: Run of ids of each word; the runs' first places in ``flat`` and sizes.
        self.known: dict[str, int] = {}
        self.first, self.size, self.runs = np.zeros(1024, np.int64), np.zeros(1024, np.int64), 0
        self.flat, self.used = np.zeros(4096, "<u4"), 0

    def add(self, words: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        n, at = len(words), self.runs
        while at + n > len(self.first):
            self.first, self.size = np.concatenate([self.first, self.first]), np.concatenate([self.size, self.size])
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat])
        self.flat[self.used : self.used + len(ids)] = ids
        self.first[at : at + n], self.size[at : at + n] = self.used + np.cumsum(size) - size, size
        self.used, self.runs = self.used + len(ids), at + n
        self.known |= zip(words, range(at, at + n), strict=True)

    def learn(self, words: list[str]) -> np.ndarray:
        """The run of each word.

        Letters of Latin-1 are a token run of their own whatever their case, and what ends them, a full stop or
        comma, is another.
        """
        if len(self.known) > self.kept:
            self.clear()
        if not self.known:
            self.add_others([".", ","])
        run = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(run < 0)
        if len(missing):  # words that are known, most of them, are looked up once
            new = list(map(words.__getitem__, missing.tolist()))
            self.add_new(new)
            run[missing] = np.fromiter(map(self.known.__getitem__, new), np.int64, len(new))
        return run

    def add_new(self, words: list[str]) -> None:
        known = self.known
        whole, ended, rest = [], [], []
        for x in words:
            body = x[:-1] if x[-1] in ".," else x
            if body.isalpha() and (body.isascii() or max(body) < "\u0100"):
                (whole if body is x else ended).append((x, body.lower()))
            else:
                rest.append(x)
        self.add_plain([s for s in dict.fromkeys(s for _, s in whole + ended) if s not in known])
        known |= {x: known[s] for x, s in whole}
        if ended:
            both = np.array([(known[s], known[x[-1]]) for x, s in ended]).reshape(-1)
            size = self.size[both].reshape(-1, 2).sum(1)
            self.add([x for x, _ in ended], self.flat[spread(both, self.first, self.size)], size)
        self.add_others([x for x in rest if x not in known])

    def add_others(self, words: list[str]) -> None:
        for k in range(0, len(words), 1 << 14):
            part = words[k : k + (1 << 14)]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            size = np.fromiter(map(len, found), np.int64, len(found))
            self.add(part, np.fromiter(chain.from_iterable(found), "<u4", int(size.sum())), size)

    def add_plain(self, words: list[str]) -> None:
        for k in range(0, len(words), 1 << 16):
            groups = [words[a : a + 256] for a in range(k, min(len(words), k + (1 << 16)), 256)]
            for group, e in zip(groups, self.plain.encode_batch_fast(groups, is_pretokenized=True, add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                ends = np.flatnonzero(self.last[ids]) + 1
                self.add(group, ids, np.diff(ends, prepend=0))

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by ``end_id``, and the number of ids of each text."""
        words, place, n_words = split(texts)
        run = np.append(self.learn(words.to_pylist()), self.run_of_end(end_id))
        # the runs of this batch side by side, as most words come again
        own, size = self.flat[spread(run, self.first, self.size)], self.size[run]
        # the end stands behind the words of each text like one more word
        ends = np.cumsum(n_words + 1) - 1
        is_word = np.ones(len(place) + len(ends), bool)
        is_word[ends] = False
        whole = np.full(len(is_word), len(words), place.dtype)
        whole[is_word] = place
        return own[spread(whole, np.cumsum(size) - size, size)], np.add.reduceat(size[whole], ends - n_words)

    def run_of_end(self, end_id: int) -> int:
        name = f" {end_id}"  # no word holds a blank
        if name not in self.known:
            self.add([name], np.array([end_id], "<u4"), np.ones(1, np.int64))
        return self.known[name]


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    """One for each Python worker and file."""
    return WordTokens(path)


def pieces(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = True, kept: int = KEPT) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and (if wanted) ids of every piece of every row.

    A document is the ids of its whole text and ``end_id``; a null or empty text is ``end_id`` alone. Only
    documents of more than ``capacity`` tokens are cut. Repeated rows and null doc_ids are documents of
    their own; other columns are ignored. A worker keeps the ids of about ``kept`` words: more are faster, fewer
    take less memory.
    """
    ship(docs.sparkSession)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
    out_schema = pa.schema(list(zip(names, types, strict=True)))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(path)
        tokens.kept = kept
        for frame in frames:
            for at, texts in text_slices(frame.column("text")):
                ids, total = tokens.encode(texts, end_id)
                cuts = -(-total // capacity)
                row = np.repeat(np.arange(len(total)), cuts)
                number = np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                start = number * capacity
                length = np.minimum(capacity, total[row] - start)
                first = np.repeat(np.cumsum(total) - total, cuts) + start
                view = memoryview(ids).cast("B")
                parts = [view[4 * a : 4 * b] for a, b in zip(first.tolist(), (first + length).tolist(), strict=True)]
                columns = [frame.column("doc_id").take(pa.array(row + at)), number, start, length, list(map(zlib.crc32, parts))] + [parts] * with_ids
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)], schema=out_schema)
            pa.default_memory_pool().release_unused()

    rows = own_columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def pack(parts: DataFrame, cap: Capacity = Capacity()) -> DataFrame:
    """``parts`` (one row for each piece, with its ``length``) with sequence_id and offset added.

    Pieces that fill a sequence alone have one each, with a negative number, without a shuffle. The others are
    dealt evenly to groups of about ``group_pieces``, whatever their documents and also if rows repeat, and each
    group is packed by ``best_fit``. Ids of sequences are unique, and the offsets in each are gapless from 0. An
    empty table gives an empty table. ``parts`` is written first, as rows are dealt by their place in it.
    """
    ship(parts.sparkSession)
    placed = materialise(parts, "pieces").withColumn("_row", F.monotonically_increasing_id())
    full = F.col("length") >= cap.tokens
    alone = placed.where(full).select(*parts.columns, (-1 - F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = placed.where(~full)
    groups = max(1, -(-rest.count() // cap.group_pieces))
    longs = [f.name for f in parts.schema if f.dataType.simpleString() == "bigint"]
    dealt = hide_nulls(rest.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups))), *longs)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "_row"], ascending=[False, True], kind="stable").reset_index(drop=True)
        out = frame.assign(sequence_id=int(frame["_group"].iloc[0]) * (1 << 32) + best_fit(frame["length"].to_numpy(), cap))
        out["offset"] = out.groupby("sequence_id")["length"].cumsum() - out["length"]
        return out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema) + ", sequence_id long, offset long"
    packed = show_nulls(dealt.groupBy("_group").applyInPandas(run, schema), *longs)
    return packed.select(*alone.columns).unionByName(alone)


def pack_documents(docs: DataFrame, path: str, cap: Capacity = Capacity(), end_id: int = 1, kept: int = KEPT) -> DataFrame:
    """The pieces of all documents, packed; ids stay out of the shuffle, ``pieces`` gives them by (doc_id, piece)."""
    return pack(pieces(docs, path, cap.tokens, end_id, with_ids=False, kept=kept), cap)
