"""Segment-tree BPE and language identification."""

import random

import numpy as np
from tokenizers import Tokenizer

from tests.conftest import DATA
from tests.llm.fixtures import documents, empty
from vectorloom.llm import bpe, langid
from vectorloom.llm.queries import tokenizer_file

BYTES, PIECES = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")


def test_encodes_as_the_library(spark):
    t = Tokenizer.from_file(BYTES)
    found = bpe.encode_decode(documents(spark), BYTES).collect()
    got = [(r.doc_id, np.frombuffer(bytes(r.ids), "<u4").tolist(), r.decoded) for r in found]
    expected = []
    for i, text in documents(spark, plain=True):
        ids = t.encode(text or "", add_special_tokens=False).ids
        expected.append((i, ids, t.decode(ids, skip_special_tokens=False)))
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert bpe.encode_decode(empty(spark), BYTES).count() == 0


def test_fuzz():
    r = random.Random(1)
    letters = list("abc éß ñ'\n\t\x1c\x85\xa0​𝔘漢字🙂0123٣²½_-|$s") + ["<|endoftext|>", "  "]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 90))) for _ in range(800)] + ["a" * 5000, " " * 300 + "x", "ab" * 900]
    t, c = Tokenizer.from_file(BYTES), bpe.Codec(BYTES)
    assert [np.frombuffer(x, "<u4").tolist() for x in c.encode_batch(texts)] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = langid.predict(docs, langid.train(docs, PIECES)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(found) > 30
    assert sum(r.lang == r.lang_pred for r in found) / len(found) >= 0.95
    assert all(0 <= r.score <= 1 for r in found)


def test_odd_rows_of_languages(spark):
    docs = documents(spark)
    model = langid.train(docs, PIECES)
    found = langid.predict(docs, model).collect()
    assert len(found) == docs.count() and model[1] == ["en"]
    assert all(r.lang_pred == "und" and r.score == 0 for r in found if r.doc_id in (5, 6, 7))
    nothing = langid.train(empty(spark), PIECES)
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}
    assert langid.predict(empty(spark), model).count() == 0


def test_forward_sums_all_segmentations():
    fit = langid.Fit()
    model = langid.Model(["a", "b", "ab", "▁a"], ["x"], np.array([[0.1], [0.2], [0.3], [0.4]]), fit)
    # ▁ab: ▁a b, or an unknown mark with a b, or with ab
    expected = 0.4 * 0.2 + fit.unknown * (0.1 * 0.2 + 0.3)
    assert np.isclose(np.exp(model.word_scores(["▁ab"])[0, 0]), expected)


def test_ids_beside_a_null(spark):
    big = 1 << 60
    rows = [(big + 1, "one"), (big + 2, "two"), (None, "three"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = bpe.encode_decode(docs, tokenizer_file("byte_bpe_50k.json")).collect()
    assert sorted(((r.doc_id, r.decoded) for r in found), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)
