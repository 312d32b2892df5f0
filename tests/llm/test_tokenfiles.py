"""Token files: exact round trips, order, and what their metadata lets readers skip."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.conftest import DATA
from tests.llm.fixtures import documents, empty
from vectorloom.llm import queries, tokenfiles
from vectorloom.llm.queries import tokenizer_file

BYTES = tokenizer_file("byte_bpe_50k.json")


def expected_rows(rows):
    """In the order of doc_id, nulls first; rows of one doc_id in any order."""
    t, start, out = Tokenizer.from_file(BYTES), 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_query_by_the_library(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    found = queries.op12_orc_token_files(spark, DATA)
    assert found.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, found.collect())) == expected_rows(rows)


def test_odd_documents(spark, tmp_path):
    tokenfiles.write(documents(spark), f"{tmp_path}/t", BYTES)
    found = tokenfiles.digests(tokenfiles.read(spark, f"{tmp_path}/t")).orderBy("start").collect()
    expected = expected_rows(documents(spark, plain=True))
    key = lambda r: (r[0] is not None, r[0] or 0, *r[2:])
    assert sorted(((r.doc_id, None, r.n_tokens, r.ids_crc32) for r in found), key=key) == sorted(((i, None, n, c) for i, _, n, c in expected), key=key)
    # gapless from 0 in the order of doc_id, and the same each time
    assert [r.start for r in found] == np.cumsum([0, *(r.n_tokens for r in found[:-1])]).tolist()
    ids = [r.doc_id for r in found]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    tokenfiles.write(documents(spark), f"{tmp_path}/u", BYTES)
    assert [tuple(r) for r in tokenfiles.digests(tokenfiles.read(spark, f"{tmp_path}/u")).orderBy("start").collect()] == [tuple(r) for r in found]


def test_empty_table(spark, tmp_path):
    tokenfiles.write(empty(spark), f"{tmp_path}/t", BYTES)
    assert tokenfiles.read(spark, f"{tmp_path}/t").count() == 0 and tokenfiles.manifest(spark, f"{tmp_path}/t").count() == 0
    assert tokenfiles.lookup(spark, f"{tmp_path}/t", [1]).count() == 0


def test_fuzz():
    r = random.Random(5)
    letters = list("ab éß ñ'\n\t\x1c\x85\xa0​漢🙂012 ") + ["<|endoftext|>", "  ", " a", "word "]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(600)] + ["", " ", "a", " a", "a ", "x" * 5000, "it's we'll I'd", "one two\n\n three", None]
    t, own = Tokenizer.from_file(BYTES), tokenfiles.ByteTokens(BYTES)
    for _ in range(2):  # from the library, then from what is kept
        ids, total = own.encode(pa.array([x or "" for x in texts]), 0)
        got = [x.tolist() for x in np.split(ids, np.cumsum(total)[:-1])]
        assert got == [[*e.ids, 0] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def stripes(spark, folder):
    """(rows, kinds of streams) of each stripe, and whether there is a Bloom filter of doc_id, by ORC's own reader."""
    jvm, out = spark._jvm, []
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for status in jvm.org.apache.hadoop.fs.FileSystem.getLocal(hadoop).listStatus(jvm.org.apache.hadoop.fs.Path(folder)):
        if status.getPath().getName().endswith(".orc"):
            reader = jvm.org.apache.orc.OrcFile.createReader(status.getPath(), jvm.org.apache.orc.OrcFile.readerOptions(hadoop))
            rows = reader.rows()
            for k, s in enumerate(reader.getStripes()):
                footer = rows.readStripeFooter(s)
                out.append((s.getNumberOfRows(), {(x.getColumn(), x.getKind().toString()) for x in footer.getStreamsList()}, {x.getKind().toString() for x in footer.getColumnsList()}))
            rows.close()
    return out


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    to = str(tmp_path_factory.mktemp("files") / "t")
    docs = spark.range(0, 40_000, 2).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("some words of"), "id", F.sha2(F.col("id").cast("string"), 512)).alias("text"))
    tokenfiles.write(docs, to, BYTES, layout=tokenfiles.Layout(stripe_bytes=100_000, index_rows=1000))
    return to


def test_stripes_have_indexes_and_filters(spark, written):
    found = stripes(spark, f"{written}/ids")
    assert len(found) > 2 * tokenfiles.manifest(spark, written).count() and sum(n for n, _, _ in found) == 20_000
    for _, streams, encodings in found:
        assert (1, "ROW_INDEX") in streams and (1, "BLOOM_FILTER_UTF8") in streams
        assert "DIRECT_V2" in encodings  # run lengths of integers


def test_stripes_are_read_side_by_side(spark, written):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "120000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1000")
        rows = tokenfiles.read(spark, written)
        tasks = rows.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
        assert len(tasks) > 2 * tokenfiles.manifest(spark, written).count() and sum(r["count"] for r in tasks) == 20_000
        assert rows.agg(F.sum("n_tokens"), F.max(F.col("start") + F.col("n_tokens"))).first()[0] == rows.agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_metadata_prunes(spark, written):
    assert sorted(r.doc_id for r in tokenfiles.lookup(spark, written, [17, 4, 20_000, 39_998, 50_000]).collect()) == [4, 20_000, 39_998]
    assert tokenfiles.lookup(spark, written, [-5]).count() == 0
    one = tokenfiles.lookup(spark, written, [4])
    assert sum(x.endswith(".orc") for x in one.inputFiles()) == 1 < tokenfiles.manifest(spark, written).count()
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "doc_id" in plan.split("PushedFilters: [")[1].split("]")[0]
    known = tokenfiles.manifest(spark, written).orderBy("start").collect()
    assert all(a.start + a.tokens == b.start and a.last_doc < b.first_doc for a, b in zip(known, known[1:], strict=False))
    # an even id is there and an odd one isn't, though it lies in a range: the filter of its row group says so
    assert tokenfiles.lookup(spark, written, [5]).count() == 0
