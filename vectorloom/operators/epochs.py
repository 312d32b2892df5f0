"""The order of each epoch by arithmetic: a keyed permutation of row numbers, so that no epoch and no resume sorts the table.

Rows are numbered once (``functions.tables.ordinals``). The place of a row in an epoch is then a function of its number, the
count of rows, the seed and the epoch alone, and it can be inverted: the rows of a batch are known without reading others.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Half rounds of the permutation, and how often a number may be permuted again until it is one of the rows.
ROUNDS, WALKS = 8, 17
PRIME = (1 << 31) - 1
#: Rows whose places one task computes, and tasks at most.
PART_ROWS, MOST_PARTS = 200_000, 20_000


def round_keys(seed: int, epoch: int) -> list[tuple[int, int]]:
    """A factor and a summand of 28 bits for each half round."""
    digests = [hashlib.md5(f"{seed}_{epoch}_{k}".encode()).hexdigest() for k in range(ROUNDS)]
    return [(int(x[:7], 16) | 1, int(x[7:14], 16)) for x in digests]


def _mixed(half: Column, factor: Column, summand: Column) -> Column:
    """A number from 0 to 2^62 for a half below 2^31."""
    first = half * factor + summand
    second = F.pmod(first.bitwiseXOR(F.shiftright(first, 17)), F.lit(PRIME)) * factor + summand
    return second.bitwiseXOR(F.shiftright(second, 23))


def _sides(n: Column) -> tuple[Column, Column]:
    """Sides of the least nearly square grid that has a cell for each of ``n`` rows; fewer cells than a side are in excess."""
    a = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("long"), F.lit(1))
    return a, F.greatest(F.ceil(n / a).cast("long"), F.lit(1))


def _permuted(x: Column, a: Column, b: Column, keys: Column, sign: int) -> Column:
    """A permutation of the a x b numbers: the two halves of a number, row and column of the grid, are shifted in turn by each other's mix."""

    def half_round(at: Column, key: Column) -> Column:
        row, column = F.floor(at / b).cast("long"), F.pmod(at, b)
        # the quotient of two longs is exact below 2^53, as the numbers of rows are
        down = F.pmod(row + sign * F.pmod(_mixed(column, key["factor"], key["summand"]), a), a) * b + column
        along = row * b + F.pmod(column + sign * F.pmod(_mixed(row, key["factor"], key["summand"]), b), b)
        return F.when(key["down"], down).otherwise(along)

    return F.aggregate(keys, x, half_round)


def _walked(x: Column, n: Column | int, seed: int, epoch: int, forward: bool) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    n = n.cast("long")
    listed = [F.struct(F.lit(f).cast("long").alias("factor"), F.lit(s).cast("long").alias("summand"), F.lit(k % 2 == 0).alias("down")) for k, (f, s) in enumerate(round_keys(seed, epoch))]
    keys = F.array(*(listed if forward else reversed(listed)))

    def walk(sides: Column) -> Column:
        step = lambda at: _permuted(at, sides["a"], sides["b"], keys, 1 if forward else -1)
        again = lambda s, _: F.struct(F.when(s["x"] < n, s["x"]).otherwise(step(s["x"])).alias("x"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), F.struct(step(x.cast("long")).alias("x")), again)["x"]

    a, b = _sides(n)
    # the sides are computed once a row, not in each half round
    last = F.element_at(F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), walk), 1)
    lost = F.raise_error(F.lit(f"a row has no place after {WALKS} steps")).cast("long")
    found = F.element_at(F.transform(F.array(last), lambda y: F.when(y < n, y).otherwise(lost)), 1)
    return F.when(x.isNull() | (x < 0) | (x >= n), F.lit(None).cast("long")).otherwise(found)


def place(number: Column, n: Column | int, seed: int = 42, epoch: int = 0) -> Column:
    """Where the row with a number from 0 to before ``n`` stands in an epoch, which is a permutation of the numbers.

    Numbers go through a grid whose cells exceed the rows by less than one side; a row that falls on an excess cell goes
    on from there. For up to 300 rows 17 such steps always suffice; beyond, they don't with a probability below 1e-20 a row, and
    that raises. Numbers outside of the range and nulls have no place. There may be 2^52 rows. ``n`` may be a column,
    such as the size of the row's group.
    """
    return _walked(number, n, seed, epoch, True)


def number_at(at: Column, n: Column | int, seed: int = 42, epoch: int = 0) -> Column:
    """The number of the row that stands at a place: the inverse of ``place``."""
    return _walked(at, n, seed, epoch, False)


def _with_place(rows: DataFrame, at: Column) -> DataFrame:
    """``rows`` with _place, computed once: a plain column would be computed again in each filter on it."""
    return rows.select("*", F.explode(F.array(at)).alias("_place"))


def epoch_batches(numbered: DataFrame, n: int, batch_size: int, ranks: int = 1, seed: int = 42, epoch: int = 0, first: int = 0, number: str = "ordinal") -> DataFrame:
    """``numbered`` with rank, batch, slot in an epoch, in full batches that all ranks have; batches before ``first`` are left out.

    Places are dealt to the ranks in turn. A projection and a filter: nothing is shuffled or sorted, however far a run had come.
    """
    full = n // (ranks * batch_size) * batch_size
    placed = _with_place(numbered, place(F.col(number), n, seed, epoch))
    turn = F.floor(F.col("_place") / ranks).cast("long")
    kept = placed.where((F.col("_place") < full * ranks) & (turn >= first * batch_size))
    return kept.select("*", F.pmod("_place", F.lit(ranks)).cast("int").alias("rank"), F.floor(turn / batch_size).cast("int").alias("batch"), F.pmod(turn, F.lit(batch_size)).cast("int").alias("slot")).drop("_place")


def batch_rows(numbered: DataFrame, n: int, batch_size: int, batches: range, ranks: int = 1, seed: int = 42, epoch: int = 0, number: str = "ordinal") -> DataFrame:
    """The rows of some batches, as ``epoch_batches`` has them, found by their numbers: these are computed from the places and joined.

    The numbers are as many as the rows of the batches; where they are few, Spark broadcasts them by its own threshold.
    """
    full = n // (ranks * batch_size)
    low, high = (min(max(b, 0), full) * batch_size * ranks for b in (batches.start, batches.stop))
    if batches.step != 1:
        raise ValueError("batches are a range of step 1")
    wanted = numbered.sparkSession.range(low, max(low, high)).select(F.col("id").alias("_place"))
    turn = F.floor(F.col("_place") / ranks).cast("long")
    named = wanted.select(
        number_at(F.col("_place"), n, seed, epoch).alias(number), F.pmod("_place", F.lit(ranks)).cast("int").alias("rank"),
        F.floor(turn / batch_size).cast("int").alias("batch"), F.pmod(turn, F.lit(batch_size)).cast("int").alias("slot"),
    )
    return numbered.join(named, number)


def group_epoch(numbered: DataFrame, sizes: DataFrame, group: str, batch_size: int, ranks: int = 1, seed: int = 42, epoch: int = 0, number: str = "ordinal", most: int = 100_000) -> DataFrame:
    """``numbered`` (``group``, number within it) with rank, batch, slot, batch_order: full batches of one group each.

    A group's places are dealt to the ranks in equal runs (the remainder goes) and cut into full batches (the rest goes).
    ``sizes``: ``group``, n. It is broadcast if it has at most ``most`` rows, which is counted. A null group is a group.
    Rows are spread by group and number before their places are computed, so no task has those of a whole group.
    """
    listed = sizes.select(F.col(group).alias("_group"), F.col("n").cast("long").alias("_n"))
    side = F.broadcast(listed) if listed.limit(most + 1).count() <= most else listed
    total = listed.agg(F.sum("_n")).first()[0] or 0
    parts = max(int(numbered.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_ROWS))
    joined = numbered.join(side, F.col(group).eqNullSafe(F.col("_group"))).repartition(min(parts, MOST_PARTS), group, number)
    each = F.floor(F.col("_n") / ranks)
    placed = _with_place(joined, place(F.col(number), F.col("_n"), seed, epoch)).where(F.col("_place") < each * ranks)
    inside = F.pmod("_place", each)
    batch = F.floor(inside / batch_size).cast("int")
    full = placed.where(inside < F.floor(each / batch_size) * batch_size)
    rank = F.floor(F.col("_place") / each).cast("int")
    order = F.md5(F.concat_ws("_", F.col(group).cast("string"), rank, batch, F.lit(seed + epoch)))
    return full.select("*", rank.alias("rank"), batch.alias("batch"), F.pmod(inside, F.lit(batch_size)).cast("int").alias("slot"), order.alias("batch_order")).drop("_group", "_n", "_place")
