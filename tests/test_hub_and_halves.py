"""Sources by repository, configuration and split; vectors in half precision by row number."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.functions.vectors import from_half, to_half
from vectorloom.sources import halves, hub


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("hub"))
    rows = spark.range(20).select("id", (F.col("id") * 2).alias("x"))
    rows.write.parquet(f"{at}/a/one/train")
    rows.where("id < 5").write.parquet(f"{at}/a/one/test")
    rows.select("id", F.lit("t").alias("y")).write.json(f"{at}/a/two/train")
    rows.write.orc(f"{at}/b")
    return at


def catalogue(spark, *more):
    rows = [("a1", "a", "one", "train", "parquet", "x > 10"), ("a1", "a", "one", "test", "parquet", None), ("a2", "a", "two", "train", "json", None), ("b", "b", None, None, "orc", "id % 2 = 0")]
    return spark.createDataFrame([*rows, *more], hub.CATALOGUE)


def test_sources_are_one_table(spark, root):
    found = hub.scan(spark, catalogue(spark), root, schemas={"a2": "id long, y string"})
    assert set(found.columns) == {"name", "repo", "config", "split", "id", "x", "y"}
    got = {(r.name, r.config, r.split): (r.n, r.n_filled) for r in hub.inventory(found, "y").collect()}
    assert got == {("a1", "one", "train"): (14, 0), ("a1", "one", "test"): (5, 0), ("a2", "two", "train"): (20, 20), ("b", None, None): (10, 0)}
    assert hub.scan(spark, catalogue(spark), root, ["b"]).count() == 10
    assert hub.scan(spark, catalogue(spark), root, []).count() == 0 and hub.scan(spark, catalogue(spark).limit(0), root).columns == ["name", "repo", "config", "split"]


def test_filters_prune_sources_and_reach_the_scans(spark, root):
    found = hub.scan(spark, catalogue(spark), root, ["a1", "b"])
    plan = found.where("config = 'one' AND split = 'test' AND id > 3").select("name", "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "test" in plan and "Union" not in plan
    assert "GreaterThan(id,3)" in plan and "ReadSchema: struct<id:bigint>" in plan
    assert [r.id for r in found.where("split = 'test' AND id > 3").collect()] == [4]


@pytest.mark.parametrize("bad", [("c", "c", None, None, "sqlite", None), ("c", "b", None, None, "orc", None)])
def test_catalogue_faults(spark, root, bad):
    if bad[4] == "orc":  # a source with a column that has a name of the catalogue's
        spark.range(2).select("id", F.lit("s").alias("split")).write.mode("ignore").orc(f"{root}/odd")
        bad = ("c", "odd", None, None, "orc", None)
    with pytest.raises(ValueError):
        hub.scan(spark, catalogue(spark, bad), root, schemas={"a2": "id long, y string"})
    with pytest.raises(ValueError, match="aren't listed"):
        hub.scan(spark, catalogue(spark), root, ["zzz"])


def vectors_of(spark, n, sides=("query", "positive")):
    r = np.random.default_rng(n)
    x = r.normal(size=(len(sides), n, 5)).astype(np.float32)
    rows = [("s", side, i, x[k, i].tolist()) for k, side in enumerate(sides) for i in range(n)]
    r.shuffle(rows)
    return x, spark.createDataFrame([("s", b, int(c), [float(y) for y in d]) for _, b, c, d in rows], "subset string, side string, row_idx long, v array<float>")


def test_halves_come_back_by_ranges(spark, tmp_path):
    x, rows = vectors_of(spark, 37)
    path = str(tmp_path / "h")
    halves.write(rows, path, size=10)
    assert {(r.subset, r.side, r.n) for r in halves.counts(spark, path).collect()} == {("s", "query", 37), ("s", "positive", 37)}
    for start, end in ((0, None), (0, 10), (9, 11), (36, None), (12, 37), (30, 99), (40, None), (5, 5)):
        found = {(r.side, r.row_idx): r.v for r in halves.read(spark, path, "s", start, end, size=10).collect()}
        assert sorted(found) == sorted((s, i) for s in ("query", "positive") for i in range(start, min(37, 37 if end is None else end)))
        for (side, i), v in found.items():
            assert v == x[("query", "positive").index(side), i].astype(np.float16).astype(np.float32).tolist()
    plan = halves.read(spark, path, "s", 12, 20, size=10)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(block)" in plan and "PartitionFilters: [isnotnull(subset" in plan
    whole = spark.range(37).select(F.col("id").alias("row_idx"))
    assert sorted((r.row_idx, len(r.teacher_q), len(r.teacher_p)) for r in halves.aligned(whole, path, "s", size=10).collect()) == [(i, 5, 5) for i in range(37)]
    with pytest.raises(ValueError, match="38 rows of s"):
        halves.aligned(spark.range(38).select(F.col("id").alias("row_idx")), path, "s", size=10)
    assert halves.aligned(whole.limit(0), path, "s", size=10).count() == 0


@pytest.mark.parametrize(("change", "message"), [("row_idx <> 12", "without gaps"), ("row_idx NOT BETWEEN 10 AND 19", "missing or short"), ("row_idx <> 19", "missing or short")])
def test_halves_with_gaps_raise(spark, tmp_path, change, message):
    _, rows = vectors_of(spark, 25)
    with pytest.raises(Exception, match=message):
        halves.write(rows.where(change), str(tmp_path / "h"), size=10)


def test_halves_of_odd_vectors_raise(spark, tmp_path):
    _, rows = vectors_of(spark, 5)
    for k, bad in enumerate([rows.unionByName(rows.where("row_idx = 3")), rows.withColumn("v", F.when(F.col("row_idx") != 2, F.col("v"))), rows.withColumn("v", F.when(F.col("row_idx") != 2, F.col("v")).otherwise(F.array(F.lit(1.0)))), rows.withColumn("v", F.transform("v", lambda x: x * 1e6))]):
        with pytest.raises(Exception, match="gaps|null|several|too large"):
            halves.write(bad, str(tmp_path / str(k)))


def test_half_columns(spark):
    rows = spark.createDataFrame([(1, [1.0, -2.5]), (2, None), (3, []), (4, [0.1, 7.0, 1e9])], "k int, v array<double>").coalesce(1)
    found = {r.k: (r.raw, r.v) for r in rows.select("k", to_half("v").alias("raw")).select("k", "raw", from_half("raw").alias("v")).collect()}
    assert found[2] == (None, None) and found[3] == (b"", [])
    assert found[1][0] == np.array([1.0, -2.5], "<f2").tobytes() and found[1][1] == [1.0, -2.5]
    assert found[4][1][:2] == [pytest.approx(0.1, abs=1e-4), 7.0] and np.isinf(found[4][1][2])
