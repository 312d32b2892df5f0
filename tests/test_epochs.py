"""Orders of epochs by arithmetic: permutations, their inverses, batches that agree however they are found."""

import pytest
from pyspark.sql import functions as F

from vectorloom.functions.tables import ordinals
from vectorloom.operators import epochs, evaluation


def mixed(half, factor, summand):
    first = half * factor + summand
    second = (first ^ (first >> 17)) % epochs.PRIME * factor + summand
    return second ^ (second >> 23)


def plain_place(i, n, seed, epoch):
    a = 1
    while a * a < n:
        a += 1
    b = max(1, -(-n // a))
    while True:
        for k, (factor, summand) in enumerate(epochs.round_keys(seed, epoch)):
            row, column = divmod(i, b)
            if k % 2 == 0:
                row = (row + mixed(column, factor, summand)) % a
            else:
                column = (column + mixed(row, factor, summand)) % b
            i = row * b + column
        if i < n:
            return i


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 101, 290, 1000])
def test_places_are_a_permutation(spark, n):
    rows = spark.range(n).select("id", epochs.place(F.col("id"), n, 7, 3).alias("place"))
    found = {r["id"]: r["place"] for r in rows.select("*", epochs.number_at(F.col("place"), n, 7, 3).alias("back")).where("back = id").collect()}
    assert found == {i: plain_place(i, n, 7, 3) for i in range(n)}
    assert sorted(found.values()) == list(range(n))


def test_large_counts_and_odd_numbers(spark):
    n = 10**13 + 7
    rows = spark.createDataFrame([(0,), (1,), (n - 1,), (n,), (-1,), (None,)], "i long")
    found = rows.select("i", epochs.place(F.col("i"), n).alias("p")).select("*", epochs.number_at(F.col("p"), n).alias("back")).collect()
    assert [r["p"] for r in found] == [plain_place(0, n, 42, 0), plain_place(1, n, 42, 0), plain_place(n - 1, n, 42, 0), None, None, None]
    assert [r["back"] for r in found][:3] == [0, 1, n - 1]


def test_orders_look_random(spark):
    n = 20_000
    both = spark.range(n).select("id", epochs.place(F.col("id"), n).alias("a"), epochs.place(F.col("id"), n, epoch=1).alias("b"))
    r = both.agg(F.corr("id", "a").alias("ia"), F.corr("a", "b").alias("ab"), F.count_if(F.col("a") == F.col("id")).alias("fixed"), F.count_distinct("a").alias("n")).first()
    assert abs(r["ia"]) < 0.03 and abs(r["ab"]) < 0.03 and r["fixed"] < 12 and r["n"] == n
    near = both.alias("x").join(both.alias("y"), F.col("y.id") == F.col("x.id") + 1).where("abs(x.a - y.a) < 100").count()
    assert 120 < near < 290  # 199 are expected of 19,999 neighbours


def test_batches_by_row_and_by_place(spark):
    numbered = ordinals(spark.range(500).select((F.col("id") * 3).alias("key")), ["key"])
    whole = epochs.epoch_batches(numbered, 500, 16, ranks=3, epoch=2)
    rows = {(r["rank"], r["batch"], r["slot"]): r["key"] for r in whole.collect()}
    assert len(rows) == 500 // 48 * 48 == len({*rows.values()})
    assert {k: v for k, v in rows.items() if k[1] >= 4} == {(r["rank"], r["batch"], r["slot"]): r["key"] for r in epochs.epoch_batches(numbered, 500, 16, ranks=3, epoch=2, first=4).collect()}
    some = epochs.batch_rows(numbered, 500, 16, range(3, 6), ranks=3, epoch=2)
    assert {(r["rank"], r["batch"], r["slot"]): r["key"] for r in some.collect()} == {k: v for k, v in rows.items() if 3 <= k[1] < 6}
    assert epochs.batch_rows(numbered, 500, 16, range(10, 99), ranks=3).count() == 0
    with pytest.raises(ValueError):
        epochs.batch_rows(numbered, 500, 16, range(0, 4, 2))
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_group_epochs(spark):
    rows = spark.range(300).select("id", F.when(F.col("id") < 200, "big").when(F.col("id") < 290, "small").alias("kind"))
    numbered = ordinals(rows, ["id"], by="kind")
    sizes = numbered.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    for most in (10, 1):  # broadcast, and beyond the limit a join
        found = epochs.group_epoch(numbered, sizes, "kind", 4, ranks=2, most=most).groupBy("kind", "rank", "batch").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("slot").alias("slots")).collect()
        assert all(r["n"] == r["slots"] == 4 for r in found)
        assert {k: sum(r["kind"] == k for r in found) for k in ("big", "small", None)} == {"big": 2 * (100 // 4), "small": 2 * (45 // 4), None: 2 * (5 // 4)}
    empty = rows.limit(0).withColumn("ordinal", F.lit(0).cast("long"))
    assert epochs.group_epoch(empty, sizes.limit(0), "kind", 4).count() == 0 == epochs.epoch_batches(empty, 0, 4).count()


def test_questions_of_links(spark):
    contexts = spark.createDataFrame([("a", 5), ("a", 2), ("b", 9), (None, 1)], "link string, at long")
    asked = spark.createDataFrame([("q1", "a", 4), ("q1", "a", 3), ("q2", "c", 1), ("q1", "b", 7), ("q3", None, 8), (None, "b", 9)], "q string, link string, at long")
    found = {(r["question_id"], r["q"], r["link"], r["context_id"]) for r in evaluation.link_questions(asked, contexts, "q", "link", "at").collect()}
    assert found == {(0, "q2", "c", None), (1, "q1", "a", 2), (2, "q1", "b", 9), (3, "q3", None, None), (4, None, "b", 9)}


def test_places_of_groups_are_computed_in_many_tasks(spark):
    rows = spark.range(4000).select("id", F.lit("one").alias("kind"))
    numbered = ordinals(rows, ["id"], by="kind")
    sizes = numbered.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    found = epochs.group_epoch(numbered, sizes, "kind", 32)
    held = found.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in held) == 4000 // 32 * 32
    assert len(held) == 4 and max(r["count"] for r in held) < 2000
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 3  # the walk, its first step and the next ones: the place is computed once a row
