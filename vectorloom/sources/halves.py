"""Vectors in half precision, in blocks of rows that are aligned by their number.

A block is a row of a table: the little-endian float16 of ``rows`` vectors, one after the other. A range of rows is a
range of blocks, which Parquet finds by its statistics, so a shard of training reads its own part. Whole batches
are converted at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.functions.cluster import ship

#: Vectors of a block; at 1,024 components 2 MB.
ROWS = 1024
BLOCK = "subset string, side string, block long, n int, dims int, data binary"


def write(rows: DataFrame, path: str, size: int = ROWS) -> None:
    """Writes vectors (subset, side, row_idx, v); row_idx counts from 0 without gaps in each subset and side.

    A row that is missing or given twice, a null vector or one of another length than its block raises, as
    readers align rows by their number alone. Components over 65,504 would be infinite in half precision, and raise too.
    """
    ship(rows.sparkSession)
    schema = pa.schema([("subset", pa.string()), ("side", pa.string()), ("block", pa.int64()), ("n", pa.int32()), ("dims", pa.int32()), ("data", pa.binary())])

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("row_idx")
        n, first = table.num_rows, table["block"][0].as_py() * size
        place = table["row_idx"].to_numpy()
        if not np.array_equal(place, np.arange(first, first + n)):
            raise ValueError(f"rows from {first} on are not one each without gaps: {place[:20].tolist()}")
        dims = pc.list_value_length(table["v"]).to_numpy()
        if table["v"].null_count or (dims != dims[0]).any():
            raise ValueError(f"vectors from row {first} on are null or of several lengths")
        flat = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        if (np.abs(flat) > np.finfo(np.float16).max).any():
            raise ValueError(f"a component of the rows from {first} on is too large for half precision")
        return pa.table([[table[c][0].as_py()] for c in ("subset", "side", "block")] + [[n], [int(dims[0])], [flat.astype("<f2").tobytes()]], schema=schema)

    named = rows.select("subset", "side", F.col("row_idx").cast("long").alias("row_idx"), F.col("v").cast("array<float>").alias("v"), F.floor(F.col("row_idx") / size).cast("long").alias("block"))
    packed = named.groupBy("subset", "side", "block").applyInArrow(pack, BLOCK)
    packed.sortWithinPartitions("block").write.mode("overwrite").option("parquet.block.size", str(32 << 20)).partitionBy("subset", "side").parquet(path)
    _check(rows.sparkSession, path, size)


def _check(spark: SparkSession, path: str, size: int) -> None:
    """All blocks but the last of each subset and side are full, and none is missing; their short columns alone are read."""
    each = _blocks(spark, path).groupBy("subset", "side").agg(F.count(F.lit(1)).alias("blocks"), F.max("block").alias("last"), F.count_if(F.col("n") < size).alias("short"), F.max(F.when(F.col("n") < size, F.col("block"))).alias("where"))
    wrong = each.where((F.col("blocks") != F.col("last") + 1) | (F.col("short") > 1) | ((F.col("short") == 1) & (F.col("where") != F.col("last"))))
    bad = wrong.first()
    if bad:
        raise ValueError(f"blocks of {bad['subset']}, {bad['side']} are missing or short")


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCK).parquet(path)


def counts(spark: SparkSession, path: str) -> DataFrame:
    """subset, side, n of the rows."""
    return _blocks(spark, path).groupBy("subset", "side").agg(F.sum("n").alias("n"))


def read(spark: SparkSession, path: str, subset: str | None = None, start: int = 0, end: int | None = None, size: int = ROWS) -> DataFrame:
    """subset, side, row_idx, v (single precision) of the rows from ``start`` to before ``end``; other blocks aren't read."""
    ship(spark)
    blocks = _blocks(spark, path).where(F.col("block") >= start // size)
    if end is not None:
        blocks = blocks.where(F.col("block") <= (end - 1) // size)
    if subset is not None:
        blocks = blocks.where(F.col("subset") == subset)
    schema = pa.schema([("subset", pa.string()), ("side", pa.string()), ("row_idx", pa.int64()), ("v", pa.list_(pa.float32()))])

    def unpack(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for b in frame.to_pylist():
                first, n = b["block"] * size, b["n"]
                if len(b["data"]) != 2 * n * b["dims"]:
                    raise ValueError(f"the block from row {first} on has {len(b['data'])} bytes")
                a, z = max(start - first, 0), n if end is None else min(end - first, n)
                if a < z:
                    flat = np.frombuffer(b["data"], "<f2")[a * b["dims"] : z * b["dims"]].astype(np.float32)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(z - a + 1) * b["dims"], pa.int32()), pa.array(flat)).cast(pa.list_(pa.float32()))
                    yield pa.RecordBatch.from_arrays([pa.array([b["subset"]] * (z - a)), pa.array([b["side"]] * (z - a)), pa.array(np.arange(first + a, first + z)), lists], schema=schema)

    return blocks.mapInArrow(unpack, "subset string, side string, row_idx long, v array<float>")


def aligned(rows: DataFrame, path: str, subset: str, size: int = ROWS) -> DataFrame:
    """``rows`` (row_idx, ...) with teacher_q and teacher_p of the same number; fewer vectors than rows raise before any row is read."""
    spark = rows.sparkSession
    need = rows.agg((F.max("row_idx") + 1).alias("n")).first()["n"] or 0
    held = {r["side"]: r["n"] for r in counts(spark, path).where(F.col("subset") == subset).collect()}  # two rows
    short = {s: held.get(s, 0) for s in ("query", "positive") if held.get(s, 0) < need}
    if short:
        raise ValueError(f"{need} rows of {subset}, but vectors: {short}")
    found = read(spark, path, subset, 0, need, size) if need else read(spark, path, subset, 0, 1, size).limit(0)
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("v")))
    return rows.join(found.groupBy("row_idx").agg(side("query").alias("teacher_q"), side("positive").alias("teacher_p")), "row_idx")
