"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's likelihood is the sum over
all its segmentations into pieces of the product of their probabilities, which a forward algorithm gives;
a text's is the product over its words. The probabilities are fitted by expectation maximisation, with the
backward algorithm, on the words of a bounded sample of labelled documents.

Words are taken many at a time. Their letters are laid out by place: first the first letters of all words, longest
word first, then the second letters, and so on. A trie walk finds the pieces that start at each letter, and the
sweeps add up what ends (or starts) at each place. Likelihoods of long runs of letters are scaled as they
go, so runs of any length are summed over all of their segmentations.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vectorloom.llm.bpe import CACHED
from vectorloom.llm.common import own_columns, ship
from vectorloom.llm.words import split, text_slices

MODELS = count()
MARK = "▁"
#: Code points are smaller than this.
CODES = 0x110000
#: Letters that are scored together, and places between two scalings; both bound memory and underflow, not results.
BATCH, SCALED = 1 << 18, 16


@dataclass(frozen=True)
class Fit:
    """What is learned; ``docs_per_language`` bounds the sample, and all words of the whole sampled texts count."""

    docs_per_language: int = 300
    rounds: int = 2
    #: Added to the expected count of each piece.
    smoothing: float = 0.01
    #: Probability of a letter that isn't a piece itself.
    unknown: float = 1e-7


def held_out(doc_id: Column) -> Column:
    """crc32 of the doc_id as text modulo 3 is 1; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def letters(word: str) -> str:
    low = word.lower()
    return low if low.isalpha() else "".join(filter(str.isalpha, low))


def vocabulary(path: str) -> list[str]:
    """The pieces made of letters, in lower case, that may start with the mark of a word's beginning."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {}
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        bare = piece.removeprefix(MARK)
        if sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or not bare.isalpha() or bare != bare.lower():
            continue
        found[piece] = None
    return list(found)


class Trie:
    """The pieces as a tree of letters, with its branches in an open hash table."""

    def __init__(self, pieces: list[str]) -> None:
        self.longest = max(map(len, pieces), default=1)
        nodes: dict[int, int] = {}
        piece = [-1]
        for i, text in enumerate(pieces):
            at = 0
            for c in text:
                key = at * CODES + ord(c)
                if key not in nodes:
                    nodes[key] = len(piece)
                    piece.append(-1)
                at = nodes[key]
            piece[at] = i
        self.piece = np.array(piece, np.int64)
        self.bits = max(10, (8 * len(nodes)).bit_length())
        self.keys, self.to = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        left = np.fromiter(nodes, np.int64, len(nodes)) if nodes else np.empty(0, np.int64)
        values = np.fromiter(nodes.values(), np.int64, len(nodes)) if nodes else np.empty(0, np.int64)
        slot = self.slot(left)
        while len(left):  # each round settles one key of each free slot, and moves the rest on
            free = np.flatnonzero(self.keys[slot] == -1)
            won = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[won]], self.to[slot[won]] = left[won], values[won]
            rest = np.ones(len(left), bool)
            rest[won] = False
            left, values, slot = left[rest], values[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The node below each node by a letter, or -1."""
        key = node * CODES + code
        slot = self.slot(key)
        found = np.where(self.keys[slot] == key, self.to[slot], -1)
        open_ = np.flatnonzero((self.keys[slot] != key) & (self.keys[slot] != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            at = self.keys[slot[open_]]
            hit = at == key[open_]
            found[open_[hit]] = self.to[slot[open_[hit]]]
            open_ = open_[~hit & (at != -1)]
        return found


class Lattice:
    """All pieces in a list of words, longest word first; node (w, j) is the place before letter j of word w."""

    def __init__(self, words: list[str], trie: Trie, none: int) -> None:
        size = np.fromiter(map(len, words), np.int64, len(words))
        longest = int(size[0])
        # words of at least j letters, and the first node of each place
        self.alive = len(words) - np.searchsorted(size[::-1], np.arange(longest + 2), side="left")
        self.first = np.concatenate([[0], np.cumsum(self.alive)])
        self.size, self.longest, self.end = size, longest, self.first[size] + np.arange(len(words))
        flat = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        word = np.repeat(np.arange(len(words)), size)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        code = np.full(int(self.first[longest + 1]), -1, np.int64)  # the last place of a word has no letter
        code[self.first[place] + word] = flat
        node_place = np.repeat(np.arange(longest + 1), self.alive[: longest + 1])
        node_word = np.arange(len(code)) - self.first[node_place]
        #: Of each length of piece: where pieces start (ascending), which they are, where they end, and the bounds of each place.
        self.runs: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        start = np.flatnonzero(code >= 0)
        node = np.zeros(len(start), np.int64)
        for depth in range(1, max(trie.longest, 1) + 1):
            at = node_place[start] + depth - 1
            inside = at < size[node_word[start]]
            start, node, at = start[inside], node[inside], at[inside]
            to = trie.step(node, code[self.first[at] + node_word[start]])
            live = to >= 0
            piece = np.where(live, trie.piece[to], -1)
            if depth == 1:  # a letter that isn't a piece is an unknown one
                piece[piece < 0] = none
            has = piece >= 0
            s, p = start[has], piece[has]
            self.runs.append((s, p, self.first[node_place[s] + depth] + node_word[s], np.searchsorted(s, self.first[: longest + 2])))
            start, node = start[live], to[live]
            if not len(start):
                break

    def forward(self, table: np.ndarray, logs: bool = False) -> np.ndarray:
        """Log likelihood of each word in each language; with ``logs`` of the part before every node."""
        alpha = np.zeros((int(self.first[self.longest + 1]), table.shape[1]))
        alpha[: self.alive[0]] = 1
        scale = np.zeros((len(self.size), table.shape[1]))
        kept = np.zeros_like(alpha) if logs else None
        for j in range(1, self.longest + 1):
            for d, (s, p, e, bound) in enumerate(self.runs[:j], 1):
                lo, hi = bound[j - d], bound[j - d + 1]
                if lo < hi:
                    alpha[e[lo:hi]] += alpha[s[lo:hi]] * table[p[lo:hi]]
            a, n = self.first[j], self.alive[j]
            if kept is not None:
                kept[a : a + n] = np.log(alpha[a : a + n]) + scale[:n]
            if j % SCALED == 0 and j < self.longest:
                by = alpha[a : a + n].copy()
                scale[:n] += np.log(by)
                for k in range(max(0, j - len(self.runs)), j + 1):
                    alpha[self.first[k] : self.first[k] + n] /= by
        return kept if kept is not None else np.log(alpha[self.end]) + scale

    def backward(self, table: np.ndarray) -> np.ndarray:
        """Log likelihood of the part of a word after every node, in each language."""
        beta = np.zeros((int(self.first[self.longest + 1]), table.shape[1]))
        beta[self.end] = 1
        scale, kept = np.zeros((len(self.size), table.shape[1])), np.zeros_like(beta)
        for j in range(self.longest - 1, -1, -1):
            for s, p, e, bound in self.runs:
                lo, hi = bound[j], bound[j + 1]
                if lo < hi:
                    beta[s[lo:hi]] += beta[e[lo:hi]] * table[p[lo:hi]]
            a, n = self.first[j], self.alive[j]
            kept[a : a + n] = np.log(beta[a : a + n]) + scale[:n]
            if j % SCALED == 0 and j:
                by = beta[a : a + n].copy()
                scale[:n] += np.log(by)
                for k in range(j, min(self.longest, j + len(self.runs)) + 1):
                    m = self.alive[k]
                    beta[self.first[k] : self.first[k] + m] /= by[:m]
        return kept


def batches(words: list[str]) -> Iterator[list[int]]:
    """Places of the words in batches of about ``BATCH`` letters, longest first."""
    order, run, held = sorted(range(len(words)), key=lambda i: -len(words[i])), [], 0
    for i in order:
        if run and held + len(words[i]) > BATCH:
            yield run
            run, held = [], 0
        run.append(i)
        held += len(words[i])
    if run:
        yield run


class Model:
    """Piece probabilities of each language, and what a worker has scored so far."""

    def __init__(self, pieces: list[str], languages: list[str], table: np.ndarray, fit: Fit) -> None:
        self.languages, self.fit, self.none = languages, fit, len(pieces)
        # the last row is an unknown letter
        self.table = np.vstack([table, np.full((1, len(languages)), fit.unknown)])
        self.trie = Trie(pieces)
        #: Places of runs of letters, and of words whatever their case and marks, in ``scores``; place 0 is of words without a letter.
        self.stems: dict[str, int] = {"": 0}
        self.known: dict[str, int] = {}
        self.scores = np.zeros((1, len(languages)))
        self.used = 1

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log likelihood of each word (mark and letters) in each language."""
        out = np.zeros((len(words), len(self.languages)))
        for part in batches(words):
            out[part] = Lattice([words[i] for i in part], self.trie, self.none).forward(self.table)
        return out

    def expect(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected count of each piece in each language; counts: of each word in each language."""
        total = np.zeros_like(self.table)
        for part in batches(words):
            lattice = Lattice([words[i] for i in part], self.trie, self.none)
            before, after = lattice.forward(self.table, logs=True), lattice.backward(self.table)
            rest = counts[part]
            for s, p, e, _ in lattice.runs:
                word = s - lattice.first[np.searchsorted(lattice.first, s, side="right") - 1]
                flow = np.exp(before[s] + np.log(self.table[p]) + after[e] - before[lattice.end[word]]) * rest[word]
                for k in range(total.shape[1]):
                    total[:, k] += np.bincount(p, flow[:, k], len(total))
        return total

    def learn(self, words: list[str]) -> np.ndarray:
        """The place in ``scores`` of each word; runs of letters that aren't known yet are scored."""
        if len(self.known) > CACHED:
            self.known, self.stems, self.used = {}, {"": 0}, 1
        new = [x for x in words if x not in self.known]
        bare = [letters(x) for x in new]
        fresh = list(set(bare) - self.stems.keys())
        if fresh:
            found = self.word_scores([MARK + x for x in fresh])
            if self.used + len(fresh) > len(self.scores):
                self.scores = np.vstack([self.scores[: self.used], np.zeros((len(fresh) + len(self.scores), len(self.languages)))])
            self.scores[self.used : self.used + len(fresh)] = found
            self.stems |= zip(fresh, range(self.used, self.used + len(fresh)), strict=True)
            self.used += len(fresh)
        self.known |= zip(new, map(self.stems.__getitem__, bare), strict=True)
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and posterior of each text."""
        words, place, size = split(texts, unicode=True)
        own = self.learn(words.to_pylist())
        has = np.zeros(len(size), bool)
        sums = np.zeros((len(size), len(self.languages)))
        text = np.repeat(np.arange(len(size)), size)
        has[text[own[place] > 0]] = True  # words without a letter add nothing
        for k in range(len(self.languages)):
            sums[:, k] = np.bincount(text, self.scores[own, k][place], len(size))
        if not self.languages:
            return ["und"] * len(size), np.zeros(len(size))
        best = sums.argmax(1)
        sure = 1 / np.exp(np.maximum(sums - sums.max(1, keepdims=True), -700)).sum(1)
        return [self.languages[i] if h else "und" for i, h in zip(best.tolist(), has.tolist(), strict=True)], np.where(has, sure, 0.0)


def sample_words(docs: DataFrame, fit: Fit) -> pd.DataFrame:
    """lang, word, count of the sampled documents' whole texts."""
    rows = own_columns(docs, "doc_id", "lang", "text").where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))

    def least(df: DataFrame, *by: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.xxhash64("doc_id"), "doc_id")
        return df.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= fit.docs_per_language).drop("_at")

    # in 64 parts of each language first, so that no task sees more than 64 times the sample's rows of it
    ids = rows.select("doc_id", "lang", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(64)).alias("_part")).distinct()
    picked = least(least(ids, "lang", "_part"), "lang").select("doc_id", "lang")
    return (
        rows.join(F.broadcast(picked), ["doc_id", "lang"])  # at most docs_per_language rows for each language
        .select("lang", F.explode(F.split(F.lower("text"), r"[\s]+")).alias("word"))
        .groupBy("lang", "word")
        .count()
        .toPandas()
    )


def train(docs: DataFrame, path: str, fit: Fit = Fit()) -> tuple[list[str], list[str], np.ndarray]:
    """Pieces, languages and their table of probabilities.

    Learns from rows with a text and a lang that are not held out: of every language the ``docs_per_language`` rows
    with the least hash of their doc_id, with all of their words. So what the driver holds is bounded by the
    number of languages and that parameter, whatever the table's size.
    """
    words = sample_words(docs, fit)
    words["stem"] = [MARK + letters(x) for x in words["word"]]
    words = words[words["stem"] != MARK]
    pieces = vocabulary(path)
    lang, languages = pd.factorize(words["lang"], sort=True)
    if not len(languages):
        return pieces, [], np.zeros((len(pieces), 0))
    place, stems = pd.factorize(words["stem"], sort=True)
    counts = np.zeros((len(stems), len(languages)))
    np.add.at(counts, (place, lang), words["count"].to_numpy(float))
    table, stems, languages = np.full((len(pieces), len(languages)), 1 / max(1, len(pieces))), stems.tolist(), languages.tolist()
    for _ in range(fit.rounds):
        total = Model(pieces, languages, table, fit).expect(stems, counts)[:-1] + fit.smoothing
        table = total / total.sum(0)
    return pieces, languages, table


@lru_cache(maxsize=2)
def _held(key: str) -> list:
    return []


def predict(docs: DataFrame, model: tuple[list[str], list[str], np.ndarray], fit: Fit = Fit()) -> DataFrame:
    """The columns doc_id, held_out, lang_pred, score of every row of ``docs``, from its text alone.

    ``und`` with score 0 if the text is null or has no letter, or if nothing was learned. The score is the
    posterior of the predicted language at equal priors; at a tie the language that sorts first wins. Rows are
    judged one by one, so repeated rows and null doc_ids get a row each; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    sent: Broadcast = spark.sparkContext.broadcast(model)  # pieces x languages
    key = f"{spark.sparkContext.applicationId}-{next(MODELS)}"

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _held(key)
        if not held:
            held.append(Model(*sent.value, fit))
        for frame in frames:
            for at, texts in text_slices(frame.column("text")):
                labels, sure = held[0].predict(texts)
                ids, out = (frame.column(c).slice(at, len(texts)) for c in ("doc_id", "held_out"))
                yield pa.RecordBatch.from_arrays([ids, out, pa.array(labels, pa.string()), pa.array(sure)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text"), held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
