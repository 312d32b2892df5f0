"""Token ids in ORC files, in the order of doc_id.

Rows are range-sorted by doc_id, so a file holds a range of ids and its metadata prunes: a manifest names the range and
the first token of each file, stripes and row groups have their least and largest doc_id, and Bloom filters tell
absent ids. Ids are lists of 32-bit integers, which ORC run-length encodes. Stripes are read side by side.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.llm.common import own_columns, parts_of, ship
from vectorloom.llm.packing import WordTokens
from vectorloom.llm.words import spread, text_slices

ROWS = "doc_id long, part int, first long, n_tokens long, ids array<int>"
MANIFEST = "part int, file string, docs long, tokens long, first_doc long, last_doc long, start long"
#: Ids and pieces of text that a worker keeps, and bytes of text that are encoded together; bounds memory, not results.
KEPT_IDS, KEPT_PIECES, SLICE = 8_000_000, 800_000, 8_000_000


@dataclass(frozen=True)
class Layout:
    """How the files are laid out; defaults suit large tables."""

    stripe_bytes: int = 64 << 20
    #: Rows for each entry of the row index and for each Bloom filter.
    index_rows: int = 10_000
    false_positives: float = 0.01
    #: Rows between looks at the stripe's size, few as a document may be long.
    check_rows: int = 500
    codec: str = "zstd"


class ByteTokens(WordTokens):
    """Ids of byte-level BPE. A space between two other characters starts a pre-token, so texts are cut there.

    What ends a word, a full stop or comma after a letter, is a pre-token of its own. New pieces are encoded many
    together, as the first token of each, and no other, starts with the letter that stands for a space.
    """

    #: Blanks of any alphabet, and the end of a text; next to these a space may belong to the pre-token before it.
    BLANK = frozenset(["", *filter(str.isspace, map(chr, range(0x3001)))])

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        vocab = self.tokenizer.get_vocab()
        #: Ids that start with a space.
        self.opens = np.zeros(max(vocab.values()) + 1, bool)
        self.opens[[i for t, i in vocab.items() if t[0] == "\u0120"]] = True
        self.clear()

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def add_spaced(self, pieces: list[str]) -> None:
        """Pieces of a space and characters that aren't blank."""
        for k in range(0, len(pieces), 1 << 16):
            groups = [pieces[a : a + 256] for a in range(k, min(len(pieces), k + (1 << 16)), 256)]
            for group, ids in zip(groups, self.whole(["".join(g) for g in groups]), strict=True):
                starts = np.flatnonzero(self.opens[ids])
                if len(starts) == len(group):
                    self.add(group, ids, np.diff(starts, append=len(ids)))
                else:  # another vocabulary
                    self.add_others(group)

    def learn(self, words: list[str]) -> np.ndarray:
        """The run of each piece; pieces that start with a space have no other blank at their ends."""
        if len(self.known) > KEPT_PIECES or self.used > KEPT_IDS:
            self.clear()
        if not self.known:
            self.add_others(["", ".", ","])
        known = self.known
        new = [x for x in words if x not in known]
        self.add_spaced([x for x in new if x[0] == " " and x[-1] not in self.BLANK])
        self.add_others([x for x in new if x[0] != " " or x[-1] in self.BLANK])
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by ``end_id``, and the number of ids of each text."""
        listed = pc.split_pattern(texts, " ")
        coded = listed.flatten().dictionary_encode()
        place = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        size = pc.list_value_length(listed).to_numpy(zero_copy_only=False).astype(np.int64)
        # each different piece without its mark, 1 for a full stop and 2 for a comma
        ended = pc.match_substring_regex(coded.dictionary, r"\p{L}[.,]$")
        mark = ended.to_numpy(zero_copy_only=False) * (1 + pc.ends_with(coded.dictionary, ",").to_numpy(zero_copy_only=False))
        bare = pc.if_else(ended, pc.utf8_slice_codeunits(coded.dictionary, 0, -1), coded.dictionary).dictionary_encode()
        bare_of = bare.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        words = bare.dictionary.to_numpy(zero_copy_only=False).tolist()
        text = np.repeat(np.arange(len(size)), size)
        ends = np.cumsum(size)
        head, tail = np.zeros(len(place), bool), np.zeros(len(place), bool)
        head[ends - size], tail[ends - 1] = True, True
        opens = np.array([w[:1] in self.BLANK for w in words], bool)[bare_of]
        closes = np.array([w[-1:] in self.BLANK for w in words], bool)[bare_of] & (mark == 0)
        # texts with other blanks beside a space are encoded whole
        odd = np.bincount(text[(opens[place] & ~head) | (closes[place] & ~tail)], minlength=len(size)) > 0
        if odd.any():
            keep = ~odd[text]
            text, place, head = text[keep], place[keep], head[keep]
        code = bare_of[place] + len(words) * ~head
        needed = np.zeros(2 * len(words), bool)
        needed[code] = True
        codes = np.flatnonzero(needed)
        runs = np.zeros(2 * len(words), np.int64)
        runs[codes] = self.learn([words[c] if c < len(words) else " " + words[c - len(words)] for c in codes.tolist()])
        marks = np.array([self.known[x] for x in ("", ".", ",")] if self.known else [0] * 3)
        run = np.stack([runs[code], marks[mark[place]]], 1).ravel()
        # the runs of these texts side by side, as most pieces come again
        n = self.size[run].reshape(-1, 2).sum(1)
        ids = self.flat[spread(run, self.first, self.size)]
        per_text = np.bincount(text, weights=n, minlength=len(size)).astype(np.int64)
        rest = dict(zip(np.flatnonzero(odd).tolist(), self.whole(texts.filter(pa.array(odd)).to_pylist()), strict=True))
        plain = per_text.copy()
        for k, own in rest.items():
            per_text[k] = len(own)
        total = per_text + 1
        out = np.full(int(total.sum()), end_id, "<u4")
        start = np.cumsum(total) - total
        out[np.arange(len(ids)) + np.repeat(start - (np.cumsum(plain) - plain), plain)] = ids
        for k, own in rest.items():
            out[start[k] : start[k] + len(own)] = own
        return out, total


@lru_cache(maxsize=2)
def byte_tokens(path: str) -> ByteTokens:
    """One for each Python worker and file."""
    return ByteTokens(path)


def write(docs: DataFrame, to: str, path: str, end_id: int = 0, layout: Layout = Layout()) -> None:
    """Files of the ids of every document and ``end_id`` under ``to``, by the tokenizer at ``path``.

    ``to``/ids has a file for each range of doc_ids, ``to``/manifest a row for each file, written last: a folder
    without it is not whole. Null doc_ids come first, and rows of the same doc_id in the order of the hash of their
    text; each row is a document. A null text is an empty one, so it is ``end_id`` alone. Other columns are ignored. An
    empty table gives a manifest without rows. Ranges are of (doc_id, hash, place), so rows that share a doc_id
    are spread as well.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("place"))
    order = ["doc_id", "hash", "place"]
    dealt = rows.repartitionByRange(parts_of(spark), *order).sortWithinPartitions(*order).select("doc_id", "text")
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("first", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, tokens, before = TaskContext.get().partitionId(), byte_tokens(path), 0
        for frame in frames:
            for at, texts in text_slices(frame.column("text"), SLICE):
                ids, total = tokens.encode(texts, end_id)
                ends = np.cumsum(total)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.view("<i4"), pa.int32()))
                columns = [frame.column("doc_id").slice(at, len(texts)), pa.array(np.full(len(texts), part, np.int32)), pa.array(before + ends - total), pa.array(total), lists.cast(schema.field("ids").type)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
                before += int(ends[-1])
            pa.default_memory_pool().release_unused()

    options = {
        "compression": layout.codec,
        "orc.stripe.size": str(layout.stripe_bytes),
        "orc.create.index": "true",
        "orc.row.index.stride": str(layout.index_rows),
        "orc.bloom.filter.columns": "doc_id",
        "orc.bloom.filter.fpp": str(layout.false_positives),
        "orc.rows.between.memory.checks": str(layout.check_rows),
        "maxRecordsPerFile": "0",  # a file for each range
    }
    dealt.mapInArrow(run, ROWS).write.options(**options).orc(f"{to}/ids")
    _write_manifest(spark, to)


def _write_manifest(spark: SparkSession, to: str) -> None:
    """A row for each file, from the short columns alone."""
    files = spark.read.schema(ROWS).orc(f"{to}/ids").select("*", "_metadata.file_name").groupBy("part").agg(F.max("file_name").alias("file"), F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    rows, start = [], 0
    for r in sorted(files.collect(), key=lambda r: r["part"]):  # one row for each file
        rows.append((*r, start))
        start += r["tokens"]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.json(f"{to}/manifest")


def manifest(spark: SparkSession, at: str) -> DataFrame:
    """part, file, docs, tokens, first_doc, last_doc, start of each file."""
    return spark.read.schema(MANIFEST).json(f"{at}/manifest")


def read(spark: SparkSession, at: str, files: list[str] | None = None) -> DataFrame:
    """doc_id, start (the ids of all documents before it), n_tokens, ids of every document, or of those in some files."""
    starts = manifest(spark, at).select("part", F.col("start").alias("base"))  # one row for each file
    rows = spark.read.schema(ROWS).orc([f"{at}/ids/{f}" for f in files] if files else f"{at}/ids")
    return rows.join(F.broadcast(starts), "part").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, at: str, doc_ids: list[int]) -> DataFrame:
    """The rows of ``read`` for some doc_ids, from those files alone whose range may hold one of them.

    Within these the doc_ids are pushed to the ORC reader, which skips stripes and row groups by their range
    and their Bloom filters.
    """
    wanted = sorted({int(i) for i in doc_ids})
    near = F.array(*[F.lit(i).cast("long") for i in wanted])
    known = manifest(spark, at).where(F.exists(near, lambda i: i.between(F.col("first_doc"), F.col("last_doc"))))
    files = [r["file"] for r in known.select("file").collect()]
    return read(spark, at, files).where(F.col("doc_id").isin(wanted)) if files else read(spark, at).where(F.lit(False))


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the rows of ``read``."""
    ship(rows.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            ids = frame.column("ids")
            size = pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(size) * 4
            view = memoryview(np.ascontiguousarray(ids.flatten().to_numpy(zero_copy_only=False).astype("<u4"))).cast("B")
            crc = [zlib.crc32(view[a:b]) for a, b in zip((ends - 4 * size).tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([frame.column("doc_id"), frame.column("start"), pa.array(size), pa.array(crc, pa.int64())], schema=schema)
            pa.default_memory_pool().release_unused()

    return rows.select("doc_id", "start", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
