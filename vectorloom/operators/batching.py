"""Batches, shards and padding of training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vectorloom.functions.tables import ordinals


def stratified_batches(rows: DataFrame, group: str, key: str, batch_size: int, ranks: int = 1, seed: int = 42, epoch: int = 0) -> DataFrame:
    """``key``, ``group``, rank, batch, slot: full batches of one group each.

    A group is shuffled by the md5 of the key and the seed, dealt to ranks in equal runs (the remainder goes), and
    cut into full batches (the rest goes). batch_order tells the order of a rank's batches over all groups.
    """
    shuffled = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"_{seed + epoch}")))
    placed = ordinals(rows.select(key, group).withColumn("_by", shuffled), ["_by", key], by=group, name="_at")
    sizes = placed.groupBy(group).agg(F.floor(F.count(F.lit(1)) / ranks).alias("_each"))
    dealt = placed.join(sizes, group).where(F.col("_at") < F.col("_each") * ranks)
    dealt = dealt.withColumn("rank", F.floor(F.col("_at") / F.col("_each")).cast("int")).withColumn("_place", F.col("_at") % F.col("_each"))
    full = dealt.where(F.col("_place") < F.floor(F.col("_each") / batch_size) * batch_size)
    batch = F.floor(F.col("_place") / batch_size).cast("int")
    return full.select(
        key, group, "rank", batch.alias("batch"), (F.col("_place") % batch_size).cast("int").alias("slot"),
        F.md5(F.concat_ws("_", F.col(group).cast("string"), F.col("rank"), batch, F.lit(seed + epoch))).alias("batch_order"),
    )


def shard_ranges(rows: DataFrame, order: str, shards: int) -> DataFrame:
    """``rows`` with shard: runs of ceil(n / shards) rows by ``order``; the last shards may be short or empty."""
    size = max(1, -(-rows.count() // shards))
    return ordinals(rows, [order], name="_at").withColumn("shard", F.floor(F.col("_at") / size).cast("int")).drop("_at")


def pad_list(values: Column, width: Column, empty: Column) -> Column:
    """``values`` cut or filled up to ``width``: by its last value, or by ``empty`` if it has none."""
    last = F.coalesce(F.try_element_at(values, F.lit(-1)), empty)
    return F.when(F.size(values) >= width, F.slice(values, F.lit(1), width)).otherwise(F.concat(values, F.array_repeat(last, width - F.size(values))))


def pad_negatives(rows: DataFrame, batch: str, values: str, empty: Column) -> DataFrame:
    """``rows`` with padded: every list of a batch as long as the longest one of the batch."""
    longest = rows.groupBy(batch).agg(F.max(F.size(values)).alias("_width"))
    return rows.join(longest, batch).withColumn("padded", pad_list(F.col(values), F.col("_width"), empty)).drop("_width")


def collate(rows: DataFrame, batch: str, slot: str, fields: list[str]) -> DataFrame:
    """A row for each batch with its fields as parallel lists in the order of slots; a null score is 0 if any has one."""
    scored = [F.coalesce(F.col(f), F.lit(0.0)).alias(f) if f == "score" else F.col(f) for f in fields]
    listed = rows.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct(slot, *scored))).alias("_rows"))
    return listed.select(batch, F.size("_rows").alias("size"), *[F.col("_rows")[f].alias(f) for f in fields])


def resume(batches: DataFrame, first: int, column: str = "batch") -> DataFrame:
    """Batches from number ``first`` on."""
    return batches.where(F.col(column) >= first)


def steps(rows: int, batch_size: int, accumulate: int, epochs: int, warmup_ratio: float) -> tuple[int, int]:
    """Optimiser steps and how many of them warm up."""
    total = rows // batch_size // accumulate * epochs
    return total, int(total * warmup_ratio)


def plain_shuffle(rows: DataFrame, key: str, batch_size: int, ranks: int = 1, seed: int = 42, epoch: int = 0) -> DataFrame:
    """``key``, rank, batch, slot: all rows shuffled by the md5 of the key and the seed, dealt to the ranks in turn, in full batches.

    Every rank has the same number of rows and batches; what is left over goes.
    """
    shuffled = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"_{seed + epoch}")))
    placed = ordinals(rows.select(key).withColumn("_by", shuffled), ["_by", key], name="_at")
    full = placed.count() // (ranks * batch_size) * batch_size
    place = F.floor(F.col("_at") / ranks)
    return placed.where(F.col("_at") < full * ranks).select(
        key, (F.col("_at") % ranks).cast("int").alias("rank"), F.floor(place / batch_size).cast("int").alias("batch"), (place % batch_size).cast("int").alias("slot")
    )


def gather(rows: DataFrame, batch: str = "batch", rank: str = "rank", slot: str = "slot") -> DataFrame:
    """``rows`` with global_slot: their place in the batch that all ranks make together, rank by rank.

    A loss over global batches joins within ``batch`` alone, which is what an exchange of vectors between workers gives.
    """
    before = Window.partitionBy(batch).orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)  # a row for each rank
    sizes = rows.groupBy(batch, rank).agg(F.count(F.lit(1)).alias("_n"))
    first = sizes.select(batch, rank, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    return rows.join(first, [batch, rank]).withColumn("global_slot", (F.col("_first") + F.col(slot)).cast("long")).drop("_first")
