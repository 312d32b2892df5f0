"""Interaction of filters: what each one removes in every order, alone, and by its Shapley share.

Each document becomes a mask of the filters that it fails. Four look at the document alone. The fifth, duplicates, is
sort-based: documents are range-sorted by text fingerprint, full text and doc_id and compared with their
predecessors; texts that go on over the bounds of a part are settled from one row for each part and text. Masks are
then merged into counters of each part of the corpus, which add up, and every order is read from those.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.common import materialise, own_columns, parts_of, ship
from vectorloom.llm.words import split, text_slices

FILTERS = "ABCDE"
SHORT, REPEATED, CAPITALS, SYMBOLS, DUPLICATE = (1 << i for i in range(len(FILTERS)))
SYMBOL = r"[#$%&*|]"
_NONE = np.iinfo(np.int64).max

_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("parted", pa.int32()), ("run", pa.int64()), ("fp", pa.int64()), ("edge_text", pa.string()), ("least", pa.int64())]
)


def own_failures(texts: pa.Array) -> np.ndarray:
    """Mask of the filters that look at a text alone, for texts without nulls."""
    out = np.zeros(len(texts), np.int32)
    for at, some in text_slices(texts):
        n = len(some)
        known, place, size = split(some)
        text = np.repeat(np.arange(n), size)
        different = np.bincount(np.unique(text * max(1, len(known)) + place) // max(1, len(known)), minlength=n)
        wide = some.cast(pa.large_string())
        _, offsets, data = wide.buffers()
        ends = np.frombuffer(offsets, np.int64, n + 1, 8 * wide.offset)
        own = np.frombuffer(data, np.uint8, ends[-1] - ends[0], ends[0]) if data is not None else np.zeros(0, np.uint8)
        capitals = np.concatenate([[0], np.cumsum(own - np.uint8(65) < 26)])
        capitals = capitals[ends[1:] - ends[0]] - capitals[ends[:-1] - ends[0]]
        points = pc.utf8_length(some).to_numpy(zero_copy_only=False).astype(np.int64)
        symbols = pc.match_substring_regex(some, SYMBOL).to_numpy(zero_copy_only=False)
        out[at : at + n] = SHORT * (size < 50) + REPEATED * (100 * different < 65 * size) + CAPITALS * (100 * capitals > 5 * points) + SYMBOLS * symbols
    return out


def _compared(part: int, frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted part: their masks, and the least doc_id of their text so far; then the part's edge texts.

    A run is the rows of one text. The first and the last fingerprint of a part may go on in its neighbours; their
    runs, one for each unless two texts share a fingerprint, follow as rows with their text and no mask.
    """
    last, run, least = None, -1, _NONE
    first_fp = None
    heads: list[tuple] = []  # run, fp, text, least
    for frame in frames:
        n = frame.num_rows
        if not n:
            continue
        texts, ids = frame.column("text"), frame.column("doc_id")
        fps = frame.column("fp").to_numpy(zero_copy_only=False)
        fresh = np.ones(n, bool)
        fresh[1:] = ~pc.equal(texts.slice(1), texts.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        fresh[0] = last is None or texts[0].as_py() != last
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        own = np.where(known, pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), _NONE)
        starts = np.flatnonzero(fresh | (np.arange(n) == 0))
        so_far = np.minimum.reduceat(own, starts)
        if not fresh[0]:
            so_far[0] = min(so_far[0], least)
        place = np.cumsum(fresh) - fresh[0]
        number = run + fresh[0] + place
        duplicate = known & (own > so_far[place])
        if first_fp is None:
            first_fp = int(fps[0])
        if not fresh[0]:
            heads[-1] = (*heads[-1][:3], int(so_far[0]))
        # runs of the first fingerprint and of the latest one are kept, others can't reach a neighbour
        latest = int(fps[-1])
        for k in np.flatnonzero((fps[starts] == first_fp) | (fps[starts] == latest)):
            if fresh[starts[k]]:
                heads.append((int(number[starts[k]]), int(fps[starts[k]]), texts[int(starts[k])].as_py(), int(so_far[k])))
        heads = [h for h in heads if h[1] in (first_fp, latest)]
        last, run, least = texts[n - 1].as_py(), int(number[-1]), int(so_far[-1])
        mask = own_failures(texts) | (DUPLICATE * duplicate).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [ids, frame.column("part"), pa.array(mask, pa.int32()), pa.array(np.full(n, part, np.int32)), pa.array(number, pa.int64()), frame.column("fp"), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())], schema=_SCHEMA
        )
        pa.default_memory_pool().release_unused()
    if heads:
        n = len(heads)
        runs, edge_fps, edge_texts, leasts = zip(*heads, strict=True)
        columns = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int32()), pa.array([part] * n, pa.int32()), pa.array(runs, pa.int64()), pa.array(edge_fps, pa.int64()), pa.array(edge_texts, pa.string()), pa.array([None if x == _NONE else x for x in leasts], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part (the source), mask of each row; bit i of mask says that filter ``FILTERS[i]`` fails.

    A null text is an empty one, a null source an empty part. A row is a duplicate if a smaller doc_id has the same text
    anywhere in the table; equal doc_ids are no duplicates of each other. A null doc_id is neither smaller nor
    larger than another, so its row never is a duplicate and makes none. Other columns are ignored, an
    empty table gives no rows. Rows are dealt by ranges of (fingerprint, doc_id, place), so a text that a third of all
    rows hold is spread over as many parts as another third, and no bound of a range holds a text.
    """
    ship(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = own_columns(docs, "doc_id", "text", "source").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"), F.xxhash64(text).alias("fp"), F.monotonically_increasing_id().alias("place"))
    dealt = rows.repartitionByRange(parts_of(docs.sparkSession), "fp", "doc_id", "place").sortWithinPartitions("fp", "text", "doc_id").select("doc_id", "part", "text", "fp")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        return _compared(TaskContext.get().partitionId(), frames)

    found = materialise(dealt.mapInArrow(run, "doc_id long, part string, mask int, parted int, run long, fp long, edge_text string, least long"), "masks")
    # a few rows for each part: the same text in several parts has the least doc_id of all
    edges = found.where("mask IS NULL").select("parted", "run", "fp", "edge_text", "least")
    over = edges.groupBy("fp", "edge_text").agg(F.min("least").alias("least"), F.collect_list(F.struct("parted", "run")).alias("at")).where(F.size("at") > 1)
    fixed = over.select(F.explode("at").alias("at"), F.col("least").alias("before")).select("at.parted", "at.run", "before")
    again = F.coalesce(F.col("doc_id") > F.col("before"), F.lit(False))
    return found.where("mask IS NOT NULL").join(F.broadcast(fixed), ["parted", "run"], "left").select("doc_id", "part", F.col("mask").bitwiseOR(F.when(again, DUPLICATE).otherwise(0)).alias("mask"))


def counters(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents of each mask, and those that ``labels`` calls good or toxic.

    Counts of (doc_id, part, mask) are summed before labels are joined, so a doc_id that many rows share is a few
    rows there. Several labels of a document count as one that is good (toxic) if any is; labels of unknown documents and
    labels without a doc_id have no effect.
    """
    named = own_columns(labels, "doc_id", "quality", "toxic").where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("is_good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("is_toxic"))
    each = masks.groupBy("doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    return each.join(named, "doc_id", "left").groupBy("part", "mask").agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col(flag), F.col("n")).otherwise(0)).alias(name) for flag, name in (("is_good", "good"), ("is_toxic", "toxic"))])


def report(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Every order and step of ``filters`` for each part of ``counters``, zeros included.

    A part is one row of at most 2 ** len(filters) counters, and the steps are an array literal that it is
    exploded by. The Shapley sum needs no orders: of the filters that a document fails, each comes first in
    equally many orders.
    """
    steps = [
        {"filter_order": order, "step": k + 1, "before": sum(1 << filters.index(f) for f in order[:k]), "own": 1 << filters.index(order[k])}
        for order in map("".join, permutations(filters))
        for k in range(len(filters))
    ]
    listed = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, before: int, own: int>>")
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("c")).select("part", "c", F.explode(listed).alias("s")).select("part", "c", "s.*")

    def total(value: str, when) -> Column:
        return F.aggregate(F.filter("c", when), F.lit(0).cast("long"), lambda t, x: t + x[value])

    def fails(x: Column) -> Column:
        return x["mask"].bitwiseAND(F.col("own")) != 0

    def gone(x: Column) -> Column:
        return x["mask"].bitwiseAND(F.col("before")) != 0

    orders = factorial(len(filters))
    share = F.aggregate(F.filter("c", fails), F.lit(0).cast("long"), lambda t, x: t + x["n"] * (F.lit(orders) / F.bit_count(x["mask"])).cast("long"))
    return parts.select(
        "part",
        "filter_order",
        "step",
        total("n", lambda x: ~fails(x) & ~gone(x)).alias("kept"),
        total("n", lambda x: fails(x) & ~gone(x)).alias("removed"),
        total("n", lambda x: fails(x) & gone(x)).alias("redundant"),
        total("n", lambda x: x["mask"] == F.col("own")).alias("unique_fails"),
        total("good", lambda x: fails(x) & ~gone(x)).alias("good_lost"),
        total("toxic", lambda x: fails(x) & ~gone(x)).alias("toxic_lost"),
        share.alias("shapley"),
    )


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The report over all documents and the five filters; 600 rows for each part."""
    return report(counters(failures(docs), labels))
