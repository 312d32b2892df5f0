"""Scans that stop early, jobs side by side, shards that resume, counters of the same pass, and stable sums of exponentials."""

import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.functions import tables
from vectorloom.functions.jobs import side_by_side
from vectorloom.functions.text import item
from vectorloom.operators import evaluation, losses
from vectorloom.sources import readers, scan, teacher


@pytest.fixture
def small_blocks(spark):
    names = {"spark.sql.files.maxPartitionBytes": "60", "spark.sql.files.openCostInBytes": "1"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def lines_of(tmp_path, sizes):
    lines, k = [], 0
    for i, n in enumerate(sizes):
        own = [f"line {k + j}" if (k + j) % 5 else "" for j in range(n)]
        (tmp_path / f"part {i:02d}.txt").write_text("".join(f"{x}\n" for x in own))
        lines += own
        k += n
    return lines


def test_lines_come_from_the_front(spark, tmp_path, small_blocks):
    lines = lines_of(tmp_path, [30, 1, 0, 50, 20, 40, 40, 40])
    for most in (1, 7, 30, 31, 33, 100, 221, 1000):
        found = readers.raw_lines(spark, str(tmp_path), most)
        rows = found.orderBy("place").collect()
        assert [r.value for r in rows] == lines[:most] and [r.place for r in rows] == list(range(min(most, len(lines))))
    whole = readers.raw_lines(spark, str(tmp_path)).orderBy("place").collect()
    assert [r.value for r in whole] == lines


def test_a_capped_scan_reads_no_file_behind_the_cap_and_sorts_nothing(spark, tmp_path, small_blocks):
    lines_of(tmp_path, [30] * 40)
    found = readers.raw_lines(spark, str(tmp_path), 20)
    assert sum(f.endswith(".txt") for f in found.inputFiles()) == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "rangepartitioning" not in plan
    assert sum(f.endswith(".txt") for f in readers.raw_lines(spark, str(tmp_path), 100).inputFiles()) == 5


def test_a_cap_counts_the_rows_that_a_condition_keeps(spark, tmp_path, small_blocks):
    lines = lines_of(tmp_path, [30, 5, 50, 20])
    kept = [(i, x) for i, x in enumerate(lines) if x]
    for most in (1, 24, 25, 60, 500):
        found = scan.text_lines(spark, str(tmp_path), most, F.col("value") != "").orderBy("place").collect()
        assert [(r.place, r.value) for r in found] == kept[:most]
    assert scan.text_lines(spark, str(tmp_path), 5, F.col("value") == "none").count() == 0
    with pytest.raises(ValueError):
        scan.text_lines(spark, str(tmp_path), 0)


def test_files_of_other_kinds(spark, tmp_path):
    rows = spark.range(100).select("id", (F.col("id") % 3).alias("m")).repartitionByRange(5, "id").sortWithinPartitions("id")
    rows.write.parquet(f"{tmp_path}/p")
    rows.write.json(f"{tmp_path}/j")
    assert [(r.id, r.place) for r in readers.parquet_rows(spark, f"{tmp_path}/p", 10, F.col("m") == 1).orderBy("place").collect()] == [(i, i) for i in range(1, 30, 3)]
    assert sorted(r.id for r in readers.jsonl(spark, f"{tmp_path}/j", rows.schema, cap=33).collect()) == list(range(33))
    rows.limit(0).write.parquet(f"{tmp_path}/e")
    assert readers.parquet_rows(spark, f"{tmp_path}/e", 3).count() == 0


def test_tasks_run_at_once_and_fail_alone(spark):
    together = threading.Barrier(3, timeout=60)
    pools = {}

    def count(name):
        def run():
            together.wait()  # ends only if the three run at the same time
            pools[name] = spark.sparkContext.getLocalProperty("spark.scheduler.pool")
            return spark.range(1000).where("id % 2 = 0").count()

        return run

    def fails():
        together.wait()
        raise OSError("gone\nmore")

    found = side_by_side(spark, {"a": count("a"), "b": count("b"), "bad": fails}, most=3)
    assert list(found) == ["a", "b", "bad"] and found["a"].value == found["b"].value == 500
    assert found["bad"].message == "gone" and isinstance(found["bad"].error, OSError)
    assert len(set(pools.values())) == 2 and spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None
    assert side_by_side(spark, {}) == {}


def test_a_failure_can_stop_all(spark):
    """Jobs of the others are cancelled while they run, and those that haven't begun don't."""
    begun = threading.Event()

    def slow():
        begun.set()
        return spark.range(400).repartition(4).rdd.map(lambda r: time.sleep(0.5)).count()

    def fails():
        begun.wait(60)
        time.sleep(1)
        raise ValueError("no")

    start = time.time()
    found = side_by_side(spark, {"slow": slow, "bad": fails, "late": lambda: 1}, most=2, stop_at_error=True)
    assert time.time() - start < 45
    assert found["slow"].error is not None and found["late"].message == "cancelled" and found["bad"].message == "no"
    assert spark.range(3).count() == 3


def test_tables_of_tasks_go_with_the_callers_scope(spark):
    with tables.scratch(spark):
        found = side_by_side(spark, {k: lambda: tables.materialise(spark.range(3), "inner").inputFiles()[0] for k in "ab"})
        paths = [x.value.removeprefix("file://") for x in found.values()]
        assert all(map(_exists, paths))
    assert not any(map(_exists, paths))


def _exists(path):
    import os

    return os.path.exists(path)


def test_a_killed_job_computes_only_the_missing_shards(spark, tmp_path):
    rows = spark.range(103).select(F.col("id").alias("at"), item(F.concat(F.lit("q"), "id"), F.lit(None).cast("string")).alias("query"), item(F.lit("p"), F.lit(None).cast("string")).alias("positive"))
    log = str(tmp_path / "log")

    def load(broken):
        def make():
            def model(items):
                with open(log, "a") as f:
                    f.writelines(f"{x}\n" for x in items)
                if broken and any('"q57"' in x for x in items):
                    raise SystemExit("killed")
                return np.array([[len(x), 1.0] for x in items])

            return model

        return make

    def seen():
        with open(log) as f:
            return {int(x.split('"q')[1].split('"')[0]) for x in f if '"q' in x}

    folder = str(tmp_path / "out")
    with pytest.raises(Exception, match="killed|exited|failed"):
        teacher.store_shards(rows, "at", "s", folder, load(True), shards=10, together=2)
    # shards have ceil(103 / 10) = 11 rows: 0 to 3 were done in two jobs, the third job with row 57 failed
    assert sorted(teacher._marks(spark, f"{folder}/s")) == [0, 1, 2, 3] and teacher.shard_vectors(spark, folder, "s").count() == 44
    (tmp_path / "log").unlink()
    report = teacher.store_shards(rows, "at", "s", folder, load(False), shards=10, together=2).orderBy("shard").collect()
    assert [(r.shard, r.status, r.n_rows) for r in report] == [(k, "exists" if k < 4 else "stored", 11 if k < 9 else 4) for k in range(10)]
    assert seen() == set(range(44, 103))
    found = teacher.shard_vectors(spark, folder, "s").orderBy("row_idx").collect()
    assert [r.row_idx for r in found] == list(range(103)) and all(len(r.q) == len(r.p) == 2 for r in found)
    (tmp_path / "log").unlink()
    assert {r.status for r in teacher.store_shards(rows, "at", "s", folder, load(False), shards=10).collect()} == {"exists"} and not (tmp_path / "log").exists()
    with pytest.raises(ValueError):
        teacher.store_shards(rows.limit(50), "at", "s", folder, load(False), shards=10)


def test_counters_come_from_the_scan_that_writes(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    def touch(x):
        reads.add(1)
        return x

    rows = spark.range(50).select("id", F.when(F.col("id") % 7 > 0, F.array("id")).alias("frames")).withColumn("id", F.udf(touch, "long")("id"))
    kept, counts = evaluation.with_frames(rows)
    assert counts.collect() == [(42, 8)] and reads.value == 50
    assert kept.count() == 42 and kept.columns == ["id", "frames"]
    lists = spark.createDataFrame([(1, [1, 2], 1), (2, [1], None), (3, None, 2), (4, [1, 2, 3], 2)], "id int, candidates array<int>, n_positive int")
    kept, counts = evaluation.with_candidates(lists)
    assert counts.first().asDict() == {"n_kept": 2, "n_skipped": 2, "n_candidates": 5} and sorted(r.id for r in kept.collect()) == [1, 4]
    none = evaluation.with_candidates(lists.limit(0))
    assert none[0].count() == 0 and none[1].first().asDict() == {"n_kept": 0, "n_skipped": 0, "n_candidates": 0}


def test_losses_of_large_scores_by_numpy(spark):
    r = np.random.default_rng(4)
    q, d = r.normal(size=(2, 12, 4)) * 5
    rows = spark.createDataFrame([(i // 6, i % 6, q[i].tolist(), d[i].tolist()) for i in range(12)], "batch int, slot int, q array<double>, d array<double>")
    own = spark.createDataFrame([(i // 6, i % 6, (3 * q[i]).tolist()) for i in range(0, 12, 2)], "batch int, slot int, n array<double>")

    def expected(i, stage, hard, margin, alpha, t=0.02):
        b = [j for j in range(12) if j // 6 == i // 6 and j != i]
        pos = q[i] @ d[i]
        s = [q[i] @ d[j] for j in b] + ([q[i] @ q[j] for j in b] + [d[i] @ d[j] for j in b] if stage == 1 else []) + ([q[i] @ (3 * q[i])] if hard and i % 2 == 0 else [])
        x = [v / t + alpha * v for v in s] if alpha is not None else [v / t for v in s if v <= pos + margin]
        return np.logaddexp.reduce([pos / t, np.log(1e-12), *x]) - pos / t

    for stage, hard, margin, alpha in ((1, False, 0.1, None), (1, False, np.inf, None), (2, True, 0.1, None), (2, True, 0.1, 9.0), (2, True, 100.0, None)):
        found = {(x.batch, x.slot): x.loss for x in losses.infonce_rows(rows, stage, own if hard else None, margin=margin, alpha=alpha).collect()}
        for i in range(12):
            assert np.isfinite(found[i // 6, i % 6]) and found[i // 6, i % 6] == pytest.approx(expected(i, stage, hard, margin, alpha), rel=1e-9, abs=1e-9)
    scored = rows.select("batch", "slot", F.col("q").alias("a"), F.col("d").alias("b"), (F.col("slot") % 3).cast("double").alias("score"))
    for x in losses.cosent(scored).collect():
        c = [q[i] @ d[i] / 0.02 for i in range(12) if i // 6 == x.batch]
        assert x.loss == pytest.approx(np.logaddexp.reduce([0, *(c[i] - c[j] for i in range(6) for j in range(6) if j % 3 > i % 3)]))
