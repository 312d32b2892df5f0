"""Spelling variants grouped by full neighbourhood generation.

Every distinct deletion, replacement and insertion of each word over the letters of the vocabulary is generated as a
64-bit number, those that a Bloom filter of the vocabulary lets through become texts, and a hash join of texts
finds the words among them. Equal texts need no distance. A word's form is its commonest near word, if that
is much commoner, and forms are followed to their root.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.common import materialise, own_columns, parts_of, ship
from vectorloom.llm.lines import LOWER, UPPER

LETTERS = r"[A-Za-zÀ-ÿ]+"
#: Factor of the polynomial hash and its inverse modulo 2 ** 64.
_P = 0x9E3779B97F4A7C15
_INVERSE = pow(_P, -1, 1 << 64)
#: Candidates that are generated together, and bytes of words that are; bounds memory, not results.
BLOCK, WORD_BYTES = 1 << 21, 1 << 20


@dataclass(frozen=True)
class Rules:
    #: Least code points and least occurrences of a word.
    min_length: int = 6
    min_count: int = 5
    #: A form has so many times the occurrences of its word.
    ratio: int = 5
    #: One of so many (document, run) pairs loses a letter by the rule of the damage; 0 damages nothing.
    damage: int = 199
    #: Bits of the filter for each word, and the most bits in all (32 MB). Beyond these more candidates reach the join.
    bits_per_word: int = 32
    most_bits: int = 1 << 28
    #: Words up to which the vocabulary is broadcast where forms are followed (about 60 bytes each).
    broadcast_rows: int = 200_000


def vocabulary(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """word, n: the distinct runs of letters and their occurrences, of at least the rules' length and count.

    Only A-Z are put in lower case. A null text has no words; a null doc_id is an empty string in the rule of the
    damage. Each occurrence in each row counts. Counts are summed before the shuffle, so a frequent word is no hot key.
    """
    runs = F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(LETTERS), F.lit(0))).alias("run")
    rows = own_columns(docs, "doc_id", "text").select(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":")).alias("said"), runs)
    word = F.col("run")
    if rules.damage:
        h = F.crc32(F.concat("said", "run"))
        at = (h % F.length("run")).cast("int")
        # a run of n - 1 letters may still be long enough
        word = F.when(h % rules.damage != 0, F.col("run")).otherwise(F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run"))))
    words = rows.where(F.length("run") >= rules.min_length).select(word.alias("word")).where(F.length("word") >= rules.min_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= rules.min_count)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


def _powers(n: int) -> np.ndarray:
    """Powers of the factor, from 0 to n."""
    out = np.full(n + 1, _P, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _letters(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: the places of its words, and their code points, a row for each word."""
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        place = np.flatnonzero(sizes == size)
        step = max(1, WORD_BYTES // (4 * int(size)))
        for k in range(0, len(place), step):
            some = place[k : k + step]
            joined = "".join(words.take(pa.array(some)).to_pylist())
            yield some, np.frombuffer(joined.encode("utf-32-le"), "<u4").reshape(len(some), size)


def hashes(letters: np.ndarray) -> np.ndarray:
    """The polynomial hash of each row of code points."""
    return (letters.astype(np.uint64) * _powers(letters.shape[1])[:-1]).sum(1, dtype=np.uint64)


class Filter:
    """A Bloom filter of 64-bit blocks: four rounds of two bits, each in a block of its own."""

    ROUNDS = 4

    def __init__(self, blocks: np.ndarray) -> None:
        self.blocks = blocks

    @staticmethod
    def places(h: np.ndarray, k: int, n_blocks: int) -> tuple[np.ndarray, np.ndarray]:
        """Block and bits of round ``k``; ``n_blocks`` is a power of two."""
        m = _mixed(h + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & ((1 << 64) - 1)))
        one = np.uint64(1)
        return (m >> np.uint64(12)) & np.uint64(n_blocks - 1), (one << (m & np.uint64(63))) | (one << ((m >> np.uint64(6)) & np.uint64(63)))

    def among(self, h: np.ndarray) -> np.ndarray:
        """Places of those that may be in the filter."""
        left = np.arange(len(h))
        for k in range(self.ROUNDS):
            block, bits = self.places(h[left], k, len(self.blocks))
            left = left[(self.blocks[block] & bits) == bits]
        return left


def build_filter(words: DataFrame, bits: int) -> Filter:
    """The filter of all ``word`` of ``words``; each task sets the bits of some blocks, so the driver gets the filter once."""
    n_blocks = max(64, 1 << max(0, (bits - 1).bit_length() - 6))
    parts = min(parts_of(words.sparkSession), 64)

    def set_bits(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for _, letters in _letters(frame.column("word")):
                h = hashes(letters)
                found = [Filter.places(h, k, n_blocks) for k in range(Filter.ROUNDS)]
                block = np.concatenate([b for b, _ in found]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(np.concatenate([b for _, b in found]).view(np.int64))], ["block", "bits"])

    own = words.select("word").mapInArrow(set_bits, "block long, bits long").groupBy("block").agg(F.bit_or("bits").alias("bits"))
    span = -(-n_blocks // parts)

    def filled(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for frame in frames:
            block = frame.column("block").to_numpy(zero_copy_only=False)
            bits = frame.column("bits").to_numpy(zero_copy_only=False).view(np.uint64)
            for slice_ in np.unique(block // span):
                own = block // span == slice_
                held.setdefault(int(slice_), np.zeros(span, np.uint64))[block[own] % span] |= bits[own]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["slice", "data"])

    blocks = np.zeros(parts * span, np.uint64)
    for r in own.repartition(parts, F.floor(F.col("block") / span)).mapInArrow(filled, "slice long, data binary").collect():
        blocks[r["slice"] * span : (r["slice"] + 1) * span] |= np.frombuffer(bytes(r["data"]), np.uint64)
    return Filter(blocks[:n_blocks])


def neighbourhood(letters: np.ndarray, alphabet: np.ndarray, known: Filter) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of ``letters`` and the code points of their distinct deletions, replacements and insertions that ``known`` may hold.

    Words of one length. Each candidate is generated once: a letter is deleted at the first place of its run, replaced
    by another, and put before another, or last.
    """
    m, size = letters.shape
    wide = letters.astype(np.uint64)
    power = _powers(size)
    before = np.concatenate([np.zeros((m, 1), np.uint64), np.cumsum(wide * power[:-1], 1, dtype=np.uint64)], 1)
    whole = before[:, -1:]
    a = alphabet.astype(np.uint64)

    def kept(h: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, ...]:
        at = np.flatnonzero(allowed.ravel())
        return np.unravel_index(at[known.among(h.ravel()[at])], h.shape)

    if size > 1:
        left_out = before[:, :-1] + (whole - before[:, 1:]) * np.uint64(_INVERSE)
        first = np.concatenate([np.ones((m, 1), bool), letters[:, 1:] != letters[:, :-1]], 1)
        row, at = kept(left_out, first)
        if len(row):
            place = np.arange(size - 1)
            yield row, letters[row[:, None], place + (place >= at[:, None])]
    step = max(1, BLOCK // (m * len(a)))
    for k in range(0, size + 1, step):
        to = min(size, k + step)
        if to > k:
            other = letters[:, k:to, None] != alphabet
            changed = whole[:, :, None] + (a - wide[:, k:to, None]) * power[k:to, None]
            row, at, which = kept(changed, other)
            if len(row):
                out = letters[row]
                out[np.arange(len(row)), at + k] = alphabet[which]
                yield row, out
        end = min(size + 1, k + step)
        put = before[:, k:end, None] + a * power[k:end, None] + ((whole - before[:, k:end]) * np.uint64(_P))[:, :, None]
        free = np.ones((m, end - k, len(a)), bool)
        free[:, : to - k] = letters[:, k:to, None] != alphabet
        row, at, which = kept(put, free)
        if len(row):
            at = at + k
            out = np.empty((len(row), size + 1), letters.dtype)
            place = np.arange(size + 1)
            out[:] = letters[row[:, None], np.minimum(place - (place > at[:, None]), size - 1)]
            out[np.arange(len(row)), at] = alphabet[which]
            yield row, out


def candidates(words: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """word, n, near: the neighbourhood of every word over the letters of all, but for what the filter of the words shuts out."""
    spark = words.sparkSession
    ship(spark)
    seen = words.select(F.explode(F.split("word", "")).alias("c")).distinct().collect()  # at most the letters of LETTERS
    alphabet = np.array(sorted(ord(r["c"]) for r in seen if r["c"]), np.uint32)
    bits = min(rules.most_bits, max(1, rules.bits_per_word * words.count()))
    known = spark.sparkContext.broadcast(build_filter(words, bits).blocks)
    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("near", pa.string())])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = Filter(known.value)
        for frame in frames:
            for place, letters in _letters(frame.column("word")):
                step = max(1, BLOCK // (len(alphabet) * (letters.shape[1] + 1)))
                for k in range(0, len(place), step):
                    for row, found in neighbourhood(letters[k : k + step], alphabet, filter_):
                        own = pa.array(place[k + row])
                        near = pa.array(np.ascontiguousarray(found, "<u4").view(f"<U{found.shape[1]}").ravel(), pa.string())
                        yield pa.RecordBatch.from_arrays([frame.column("word").take(own), frame.column("n").take(own), near], schema=schema)

    # the same work for each word, however they were counted
    return words.select("word", "n").repartition(4 * parts_of(spark), "word").mapInArrow(run, "word string, n long, near string")


def group(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of the vocabulary.

    A form has at least ``ratio`` times the occurrences of its word, so a chain of forms has at most as many steps as
    the counts have digits to that base, and steps are doubled until none is left. An empty table, or one without
    words, gives no rows; extra columns are ignored.
    """
    ship(docs.sparkSession)
    words = materialise(vocabulary(docs, rules), "vocabulary")
    other = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    found = candidates(words, rules).join(other, "near").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    best = words.join(found, "word", "left").withColumn("holds", -F.col("best.less") >= rules.ratio * F.col("n"))
    named = best.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("holds"), F.col("best.form")).alias("form"), F.when(F.col("holds"), -F.col("best.less")).alias("form_n"))
    forms = materialise(named, "forms")
    few = forms.limit(rules.broadcast_rows + 1).count() <= rules.broadcast_rows
    ups = materialise(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        higher = ups.select(F.col("word").alias("root"), F.col("root").alias("above"))
        step = ups.join(F.broadcast(higher) if few else higher, "root", "left")
        ups = materialise(step.select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "roots")
        if ups.where("moved").isEmpty():
            break
        ups = ups.select("word", "root")
    roots = ups.select("word", "root")
    return forms.join(F.broadcast(roots) if few else roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
