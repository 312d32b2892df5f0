"""Blocks of queries, scratch tables, faults of a model, and sources by registry."""

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from vectorloom.functions import tables
from vectorloom.operators import evaluation, instructions, knn, mixing, registry, reports
from vectorloom.sources import embedder, readers


@pytest.mark.parametrize(("query_bytes", "corpus_bytes", "parts"), [(16 << 20, 64 << 20, 20_000), (600, 400, 20_000), (600, 64 << 20, 3)])
def test_search_in_tiles_by_brute_force(spark, monkeypatch, query_bytes, corpus_bytes, parts):
    for name, value in (("QUERY_BYTES", query_bytes), ("CORPUS_BYTES", corpus_bytes), ("MOST_PARTS", parts), ("SCORES", 50)):
        monkeypatch.setattr(knn, name, value)
    r = np.random.default_rng(1)
    x = r.integers(-3, 4, (60, 4)).astype(float)
    big = 1 << 60
    rows = [(big + i, v.tolist(), i % 3) for i, v in enumerate(x)]
    c = spark.createDataFrame(rows, "cid long, v array<double>, g int").repartition(5)
    q = c.select(F.col("cid").alias("qid"), "v", "g")
    scores = x @ x.T
    live = [i for i in range(60) if x[i].any()]
    for within in (None, "g"):
        found = {}
        for row in knn.topk(q, c, 6, exclude_self=True, within=within).collect():
            found.setdefault(row.qid - big, []).append((row["rank"], row.cid - big, row.score))
        for i in live:
            other = [j for j in live if j != i and (within is None or i % 3 == j % 3)]
            best = sorted(other, key=lambda j: (-scores[i, j], j))[:6]
            assert sorted(found[i]) == [(k + 1, j, scores[i, j]) for k, j in enumerate(best)]


def test_a_search_is_one_job_and_sends_no_row_to_the_driver(spark, monkeypatch):
    """As many jobs for 1 cell as for many, and none of them collects vectors."""
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5) + 1]) for i in range(200)], "cid long, v array<double>")
    asked = rows.withColumnRenamed("cid", "qid")

    def jobs(query_bytes, corpus_bytes):
        monkeypatch.setattr(knn, "QUERY_BYTES", query_bytes)
        monkeypatch.setattr(knn, "CORPUS_BYTES", corpus_bytes)
        group = f"search-{query_bytes}-{corpus_bytes}"
        spark.sparkContext.setJobGroup(group, "a search")
        found = knn.topk(asked, rows, 3)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "FlatMapCoGroupsInArrow" in plan
        dealt = plan[plan.index("FlatMapCoGroupsInArrow") :]
        assert dealt.count("Exchange") == 2 == dealt.count("REPARTITION_BY_NUM")  # one for each side
        out = sorted(tuple(r) for r in found.collect())
        n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return out, n

    one, many = jobs(16 << 20, 64 << 20), jobs(500, 700)
    assert one[0] == many[0] and len(one[0]) == 600
    assert one[1] == many[1]


def test_a_vector_that_most_rows_share(spark, monkeypatch):
    """Ties go to the least ids, in a tile and between tiles; a query is left out where all competitors are of other groups."""
    monkeypatch.setattr(knn, "CORPUS_BYTES", 4000)
    rows = spark.createDataFrame([(i, [0.1, 0.2, 0.7] if i % 3 else [float(i), 1.0, 0.0], str(i) if i == 300 else None if i == 301 else "g") for i in range(900, 0, -1)], "cid long, v array<double>, g string")
    asked = spark.createDataFrame([(1, [0.0, 0.0, 3.0], "g"), (2, [0.0, 0.0, 1.0], "none"), (301, [1.0, 0.0, 0.0], None), (5, None, "g"), (6, [0.0, 0.0, 0.0], "g")], "qid long, v array<double>, g string")
    found = knn.topk(asked, rows, 5, exclude_self=True, within="g").orderBy("qid", "rank").collect()
    assert [(r.qid, r["rank"], r.cid) for r in found] == [(1, k + 1, c) for k, c in enumerate([2, 4, 5, 7, 8])]
    assert len({r.score for r in found}) == 1
    nothing = rows.limit(0)
    assert knn.topk(asked, nothing, 5).count() == 0 and knn.topk(asked.limit(0), rows, 5).count() == 0


def test_scratch_tables_go_and_kept_ones_stay(spark):
    with tables.scratch(spark):
        with tables.scratch(spark):
            inner = tables.materialise(spark.range(3), "inner")
            kept = tables.materialise(spark.range(4), "kept", keep=True)
            files = [x.inputFiles()[0].removeprefix("file://") for x in (inner, kept)]
        assert [os.path.exists(f) for f in files] == [False, True] and kept.count() == 4
    assert not os.path.exists(files[1])


def test_a_prefix_is_numbered_and_not_limited(spark):
    rows = spark.range(100).select((F.col("id") * 37 % 100).alias("k"))
    assert sorted(r.k for r in tables.prefix(rows, ["k"], 30).collect()) == list(range(30))
    assert "Limit" not in tables.prefix(rows, ["k"], 30)._jdf.queryExecution().optimizedPlan().toString()


def test_a_broken_model_raises(spark):
    def load():
        def model(items):
            raise KeyError("no weights")

        return model

    rows = spark.createDataFrame([(1, "a")], "k long, t string")
    with pytest.raises(Exception, match="no weights"):
        embedder.embed(rows, "k", "t", load).collect()
    with pytest.raises(ValueError):
        embedder.embed(rows, "k", "t", load, on_error="zero")


def test_sources_by_registry(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/a")
    known = spark.createDataFrame([("a", "parquet", f"{tmp_path}/a", "id < 3"), ("b", "parquet", f"{tmp_path}/a", None)], "name string, format string, path string, filter string")
    assert readers.by_registry(spark, known, "a").count() == 3 and readers.by_registry(spark, known, "b").count() == 5
    with pytest.raises(ValueError):
        readers.by_registry(spark, known, "c")


def test_caps_of_mixtures():
    caps = {name: cap for name, _, cap in mixing.caps_of(mixing.MIXES["stage1"])}
    assert caps["megapairs"] == 1_500_000 and caps["stsb"] is None
    assert sum(caps[s] for s in mixing.FAMILIES["retrieval"]) == 550_000 and caps["MSCOCO"] == 61_112 and caps["WebQA"] == 61_111
    assert all(caps[s] == 60_000 for s in mixing.FAMILIES["classification"])
    second = [c for c in mixing.caps_of(mixing.stage1_v2(("b", "a", mixing.MINED_CLASSES))) if c[0] in ("a", "b", mixing.MINED_CLASSES)]
    assert [(n, c) for n, _, c in second] == [("a", 90_000), ("b", 90_000), (mixing.MINED_CLASSES, 55_000)]
    assert [n for n, _, _ in mixing.caps_of(mixing.stage1_v2())] == [n for n, _, _ in mixing.caps_of(mixing.MIXES["stage1_v2"])]


def test_instructions_of_names(spark):
    rows = [("mmeb_CIRR", "retrieval", 0), ("ColPali", None, 1), ("quora", "", 2), ("VOC2007", None, 3), ("x", "classification", 4), ("DocVQA", "vqa", 5), ("x", "vqa", 6)]
    df = spark.createDataFrame(rows, "subset string, kind string, i int")
    found = [r.x for r in df.orderBy("i").select(instructions.mined_instruction(F.col("kind"), F.col("subset"), F.col("i")).alias("x")).collect()]
    assert found == [instructions.TEXT_TO_IMAGE, instructions.DOCUMENT_PAGE, instructions.SEMANTIC_TEXT, instructions.CLASSIFICATION[1], instructions.CLASSIFICATION[0], instructions.VQA, instructions.TEXT_RETRIEVAL]
    cats = spark.createDataFrame([(t,) for t in registry.DOCUMENT_TASKS], "t string").select(instructions.document_category(F.col("t")).alias("c")).groupBy("c").count()
    assert {r["c"]: r["count"] for r in cats.collect()} == {"vidore_v1": 10, "vidore_v2": 7, "visrag": 6, "vidoseek": 4}


def test_a_report_as_text(spark):
    df = spark.createDataFrame([("a", 1.5), ("bb", None)], "task string, score double")
    assert reports.table_text(df, "Run").split("\n") == ["Run", "===", "task  score", "a     1.50", "bb"]


def test_first_row_of_a_video(spark):
    rows = spark.createDataFrame([("v", 2, ["x"]), ("v", 1, []), ("w", 1, ["y"])], "k string, at int, frames array<string>")
    assert sorted((r.k, r.frames, r.text) for r in evaluation.first_rows(rows, "k", "at", "frames").collect()) == [("v", [], ""), ("w", ["y"], None)]


def test_rows_of_other_groups_share_no_cell(spark, monkeypatch):
    monkeypatch.setattr(knn, "QUERY_BYTES", 50 * 16)
    monkeypatch.setattr(knn, "CORPUS_BYTES", 50 * 16)
    rows = [(i, [float(i % 7), float(i % 11) + 1], f"group {i % 8}") for i in range(400)] + [(400, [9.0, 9.0], None)]
    e = spark.createDataFrame(rows, "id long, v array<double>, label string")
    found = knn.topk(e.selectExpr("id AS qid", "v", "label"), e.selectExpr("id AS cid", "v", "label"), 1, exclude_self=True, within="label")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    cells = {int(n) for n in re.findall(r"RepartitionByExpression \[.*\], (\d+)", plan)}
    assert cells and max(cells) <= 16  # 64 where every row met every other
    expected = {}
    for i, v, label in rows[:400]:
        rivals = [(-(v[0] * w[0] + v[1] * w[1]), j) for j, w, other in rows[:400] if other == label and j != i]
        expected[i] = min(rivals)[1]
    assert {r.qid: r.cid for r in found.collect()} == expected


@pytest.mark.parametrize("exclude_self", [False, True])
def test_few_scores_of_a_tile_are_ranked(monkeypatch, exclude_self):
    """Only the largest scores of groups of columns are ranked, and results stay those of brute force, whatever the size of the numbers."""
    seen, partition = [], np.partition
    monkeypatch.setattr(np, "partition", lambda x, *more: seen.append(x.size) or partition(x, *more))
    r = np.random.default_rng(5)
    for scale in (1.0, 1e-150, 1e100):
        q, x = r.normal(size=(30, 8)) * scale, r.normal(size=(5000, 8))
        x[1::2] = x[::2]  # ties
        listed = lambda v: pa.array(list(v), pa.list_(pa.float64()))
        found = knn.nearest(pa.table({"qid": pa.array(range(30)), "v": listed(q)}), pa.table({"cid": pa.array(range(5000)), "v": listed(x)}), 10, exclude_self)
        for i in range(30):
            score = (x * q[i]).sum(1)
            order = [c for c in np.lexsort((np.arange(5000), -score)).tolist() if not (exclude_self and c == i)][:10]
            own = found.filter(pc.equal(found["qid"], i))
            assert own["cid"].to_pylist() == order and own["score"].to_pylist() == score[order].tolist()
    assert sum(seen) < 3 * 30 * 5000 / 16


def test_an_infinite_vector_hides_no_other():
    listed = lambda v: pa.array(v, pa.list_(pa.float64()))
    q, x = pa.table({"qid": [0], "v": listed([[1.0, 1.0]])}), pa.table({"cid": [1, 2, 3], "v": listed([[2.0, 1.0], [float("inf"), 1.0], [1.0, 1.0]])})
    assert knn.nearest(q, x, 3)["cid"].to_pylist() == [2, 1, 3]
