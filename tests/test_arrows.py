"""Folders of Arrow streams: written by Spark or by pyarrow, read by record batches."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vectorloom.sources import arrows, readers


def saved(folder, files, schema=None):
    """Files of lists of batches, as a library of data sets would save them."""
    names = []
    for k, batches in enumerate(files):
        names.append(f"data-{k:05d}-of-{len(files):05d}.arrow")
        tables = [pa.table(b, schema=schema) for b in batches]
        with pa.OSFile(str(folder / names[-1]), "wb") as out, pa.ipc.new_stream(out, tables[0].schema) as writer:
            for t in tables:
                writer.write_table(t)
    (folder / "state.json").write_text(json.dumps({"_data_files": [{"filename": n} for n in names], "_split": "train"}))
    return str(folder)


SCHEMA = pa.schema([("query", pa.large_string()), ("image", pa.struct([("bytes", pa.binary()), ("path", pa.string())])), ("score", pa.float64())])


def rows_of(first, n):
    return {"query": [None if k % 4 == 3 else f"q{k}" for k in range(first, first + n)], "image": [{"bytes": bytes([k % 256]) * k, "path": None} for k in range(first, first + n)], "score": [k / 2 for k in range(first, first + n)]}


def test_batches_of_several_files(spark, tmp_path):
    folder = saved(tmp_path, [[rows_of(0, 3), rows_of(3, 5)], [rows_of(8, 0)], [rows_of(8, 1), rows_of(9, 11)]], SCHEMA)
    found = arrows.read(spark, folder).orderBy("place").collect()
    assert [(r["place"], r["query"], bytes(r["image"]["bytes"]), r["score"]) for r in found] == [(k, None if k % 4 == 3 else f"q{k}", bytes([k]) * k, k / 2) for k in range(20)]
    for most in (1, 3, 4, 8, 9, 20, 100):
        assert [r["place"] for r in arrows.read(spark, folder, ["score"], most).orderBy("place").collect()] == list(range(min(most, 20)))
    assert arrows.read(spark, f"file://{folder}", ["score"]).columns == ["score", "place"]
    pages = readers.page_images(arrows.read(spark, folder), "x").where("place = 0 OR place = 3 OR place = 5").collect()
    assert {(r["query"]["text"], r["positive"]["name"], r["positive"]["image"] and len(r["positive"]["image"])) for r in pages} == {("q0", "x_0", None), ("q5", "x_5", 5)}


def test_slices_of_large_batches(spark, tmp_path, monkeypatch):
    folder = saved(tmp_path, [[rows_of(0, 60)]], SCHEMA)
    monkeypatch.setattr(arrows, "SLICE", 100)
    assert arrows.read(spark, folder).agg(F.count_distinct("place"), F.sum(F.length("image.bytes"))).first()[:] == (60, sum(range(60)))


def test_nothing_behind_the_cap_is_read(spark, tmp_path):
    folder = saved(tmp_path, [[rows_of(0, 5)], [rows_of(5, 5)]], SCHEMA)
    capped = arrows.read(spark, folder, ["score"], 5)
    (tmp_path / "data-00001-of-00002.arrow").unlink()
    assert capped.count() == 5


def test_folders_that_raise(spark, tmp_path):
    a, b, c, d = (tmp_path / x for x in "abcd")
    for x in (a, b, c, d):
        x.mkdir()
    saved(a, [[{"v": [1]}], [{"v": ["x"]}]])
    with pytest.raises(ValueError, match="2 schemas"):
        arrows.read(spark, str(a))
    saved(b, [[{"v": [1], "place": [2]}]])
    with pytest.raises(ValueError, match="place"):
        arrows.read(spark, str(b))
    with pytest.raises(ValueError, match="no columns"):
        arrows.read(spark, str(b), ["w"])
    assert arrows.read(spark, str(b), ["v"]).count() == 1
    saved(c, [[{"v": pa.array(["x", "y"]).dictionary_encode()}]])
    with pytest.raises(Exception, match="dictionaries"):
        arrows.read(spark, str(c))
    with pytest.raises(Exception, match="state.json"):
        arrows.read(spark, str(d))


def test_written_folders(spark, tmp_path):
    rows = spark.range(50).select("id", F.when(F.col("id") % 5 > 0, F.encode(F.col("id").cast("string"), "UTF-8")).alias("data"))
    folder = str(tmp_path / "out")
    assert arrows.write(rows.repartitionByRange(6, "id").where("id < 20 OR id >= 30").sortWithinPartitions("id"), folder, size=4) == 40
    found = arrows.read(spark, folder).orderBy("place").collect()
    assert [r["id"] for r in found] == [*range(20), *range(30, 50)] and [r["place"] for r in found] == list(range(40))
    assert all(r["data"] is None if r["id"] % 5 == 0 else bytes(r["data"]) == str(r["id"]).encode() for r in found)
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_draft")]
    assert arrows.write(rows.where("id < 0"), str(tmp_path / "none")) == 0
    with pytest.raises(ValueError, match="no files"):
        arrows.read(spark, str(tmp_path / "none"))
