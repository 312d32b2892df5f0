"""Capped scans of files from the front, which stop as soon as the cap is met.

Order is that of the files' paths, of the blocks of each file, and of the places in each block. It needs no sort: a block is
read by one task from its front, so counts of the blocks, one row each, say where every row stands.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Each group of files that is read is so many times as long as the one before.
GROWTH = 4


def first_rows(spark: SparkSession, path: str, read: Callable[[list[str]], DataFrame], most: int, keep: Column | None = None) -> DataFrame:
    """The first ``most`` rows that ``keep`` holds for, with ``place``: their number from 0 among all rows of the files.

    ``read`` gives the rows of some files, a plain scan without a shuffle. Files are taken from the front in groups that
    grow, and none is read once the cap is met; a file is the least that is read whole. A group is scanned
    once to count its blocks and once by whoever reads the result; of the last block only the rows up to one place
    are taken. ``place`` gives the order, as tables have none. The driver holds a row for each block that is read.
    """
    if most < 1:
        raise ValueError("a cap is at least 1")
    files = sorted(read([path]).inputFiles())
    good = F.coalesce(keep, F.lit(False)) if keep is not None else F.lit(True)
    own = ["_file", "_block", "_at"]
    found, seen, taken, size = [], 0, 0, 1
    while taken < most and (files or not found):
        group, files = files[:size], files[size:]
        size *= GROWTH
        rows = read([unquote(f) for f in group] or [path]).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
        blocks = []
        for b in sorted(rows.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("n"), F.count_if(good).alias("good"), F.min("_at").alias("first")).collect()):
            need, last = most - taken, None
            if need <= 0:
                break
            if b["good"] > need:  # the block where the cap is met: up to the place of its last row
                inside = rows.where((F.col("_file") == b["_file"]) & (F.col("_block") == b["_block"]) & good)
                last = inside.select("_at").orderBy("_at").limit(need).agg(F.max("_at")).first()[0]
            blocks.append((b["_file"], b["_block"], seen - b["first"], last))
            seen, taken = seen + b["n"], taken + min(b["good"], need)
        named = spark.createDataFrame(blocks, "_file string, _block long, _base long, _last long")
        inside = rows.join(F.broadcast(named), ["_file", "_block"]).where(good & (F.col("_last").isNull() | (F.col("_at") <= F.col("_last"))))
        found.append(inside.withColumn("place", F.col("_at") + F.col("_base")).drop(*own, "_base", "_last"))
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole


def text_lines(spark: SparkSession, path: str, most: int, keep: Column | None = None) -> DataFrame:
    """value, place of the first lines of text files."""
    return first_rows(spark, path, lambda files: spark.read.text(files), most, keep)
