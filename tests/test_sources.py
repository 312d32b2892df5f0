"""Readers, sinks, the embedder seam and streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectorloom.sources import embedder, readers, writers
from vectorloom.streaming import ingest


def test_mined_rows_survive_a_round_trip(spark, tmp_path):
    side = lambda t: {"text": t, "image_path": None}
    row = {"query": side("é"), "positive": side("p"), "hard_negatives": [side(str(i)) for i in range(20)], "task_type": None, "subset_name": None}
    rows = spark.createDataFrame([row], readers.MINED)
    writers.jsonl(rows, str(tmp_path / "mined"))
    line = "".join(p.read_text() for p in tmp_path.glob("mined/part*"))
    assert "é" in line and json.loads(line)["task_type"] is None
    found = readers.mined_rows(spark, str(tmp_path / "mined"), "stem").first()
    assert len(found.negatives) == 15 and found.subset_name == "stem" and found.task_type == "retrieval"


def test_jobs_run_once(spark, tmp_path):
    to = str(tmp_path / "t")
    assert writers.once(spark, to, lambda: spark.range(3), writers.jsonl)
    assert not writers.once(spark, to, lambda: pytest.fail("made again"), writers.jsonl)
    writers.manifest(spark.range(3), str(tmp_path / "m"), "n", "retrieval", "jsonl", cap="3")
    assert spark.read.json(str(tmp_path / "m")).first()["count"] == 3


def test_capped_lines(spark, tmp_path):
    spark.range(10).select(F.col("id")).write.json(str(tmp_path / "j"))
    schema = T.StructType([T.StructField("id", T.LongType())])
    assert [r.id for r in readers.jsonl(spark, str(tmp_path / "j"), schema, "id", 3).collect()] == [0, 1, 2]
    assert readers.jsonl(spark, str(tmp_path / "j"), schema, cap=3).count() == 3


def test_text_sources(spark):
    rows = spark.createDataFrame([("q", "p", None, "h"), ("", "p", "n", None), ("q", None, "n", None)], "anchor string, positive string, negative string, hard_negative string")
    found = readers.text_triplets(rows, "allnli", readers.TEXT_SOURCES["allnli"]).collect()
    assert len(found) == 1 and found[0].negatives == ["h"]
    images = spark.createDataFrame([("images/a.jpg", None, ["x", "y"])], "q_img string, t_img string, q_texts array<string>")
    pair = readers.image_pairs(images, "pairs", "/d").first()
    assert pair.query.text == "x" and pair.positive.image_path == "/d/a.jpg"
    pages = spark.createDataFrame([("q", None, 7), (None, "x", 8)], "query string, image_filename string, n long")
    assert [r.positive.image_path for r in readers.document_pages(pages, "pages", "n").collect()] == ["pages_7"]


def test_triple_and_summaries(spark, tmp_path):
    spark.createDataFrame([(1, "a", "en"), (2, "b", "fr")], "`query-id` long, query string, language string").write.parquet(str(tmp_path / "q"))
    spark.createDataFrame([(1, "x", 1)], "`query-id` long, `corpus-id` string, score int").write.parquet(str(tmp_path / "r"))
    q, c, r = readers.retrieval_triple(spark, str(tmp_path / "q"), None, str(tmp_path / "r"), "en")
    assert [x.qid for x in q.collect()] == ["1"] and c is None and r.first().cid == "x"
    assert readers.summaries(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "s.json").write_text(json.dumps({"per_task": {"t": {"type": "x", "score": 0.5, "num_subsets": 1}}}))
    assert readers.summaries(spark, str(tmp_path / "s.json")).first().score == 0.5
    (tmp_path / "p.json").write_text(json.dumps({"a": "one", "b": {"query": "q", "passage": "p"}}))
    assert {x.task: (x.query_prompt, x.passage_prompt, x.symmetric) for x in readers.prompts(spark, str(tmp_path / "p.json")).collect()} == {"a": ("one", "one", False), "b": ("q", "p", True)}


def test_embedder_halves_failing_batches(spark):
    def load():
        def model(items):
            if len(items) > 2 or "bad" in items:
                raise MemoryError("too much")
            return np.array([[3.0, 4.0] for _ in items])

        return model

    rows = spark.createDataFrame([(i, "bad" if i == 3 else "ok") for i in range(8)], "id long, item string").coalesce(1)
    found = {r.id: r for r in embedder.embed(rows, "id", "item", load).collect()}
    assert found[0].v == pytest.approx([0.6, 0.8]) and found[0].error is None
    assert found[3].v is None and "too much" in found[3].error


def test_streamed_rows_are_cleaned_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"text": " a ", "ts": "2024-01-01T00:00:00"}, {"text": "a", "ts": "2024-01-01T00:00:01"}, {"text": " ", "ts": "2024-01-01T00:00:02"}]
    (tmp_path / "in" / "1.json").write_text("\n".join(map(json.dumps, rows)))
    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("ts", T.TimestampType())])
    stream = ingest.ingest(spark, str(tmp_path / "in"), schema, "text", "ts", "1 hour")
    ingest.append(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert [r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["a"]
