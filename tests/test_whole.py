"""Queries against brute force over whole tables, where their SQL sees less."""

import hashlib
import re

import duckdb
import numpy as np
import pytest

from tests.conftest import DATA
from vectorloom.operators import metrics, mining
from vectorloom.plans import catalogue, retrieval
from vectorloom.plans.fixtures import relevance, vectors

catalogue.load_all()


def table():
    """ids, labels and vectors by id."""
    rows = duckdb.sql(f"SELECT vec_id, label, embedding FROM read_parquet('{DATA}/embeddings.parquet') ORDER BY vec_id").fetchall()
    ids, labels, v = zip(*rows, strict=True)
    return np.array(ids), np.array(labels), np.array(v, dtype=np.float64)


def positives(ids, labels, scores):
    """Place of each row's positive: even ids the nearest of their label, odd ones the next of it, the last the first."""
    out = []
    for i, own in enumerate(ids):
        same = [j for j in np.flatnonzero(labels == labels[i]) if j != i]
        later = [j for j in same if ids[j] > own]
        out.append(min(same, key=lambda j: (-scores[i, j], ids[j])) if own % 2 == 0 else later[0] if later else min(same, default=i))
    return out


def test_bands_are_of_all_candidates_without_the_positive(spark):
    ids, labels, v = table()
    scores = v @ v.T
    positive = positives(ids, labels, scores)
    place = {x: i for i, x in enumerate(ids.tolist())}
    found = catalogue.QUERIES["similarity_bands"](spark, DATA).collect()
    assert sorted(r.qid for r in found) == ids.tolist()
    for r in found:
        i = place[r.qid]
        rest = np.sort(np.delete(scores[i], [i, positive[i]]))
        assert (r.hard, r.easy) == pytest.approx((rest[-5:].mean(), rest[:5].mean()), abs=2e-6), r.qid


def test_bands_of_a_query_without_positive(spark):
    corpus = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(-4, 5)], "cid long, v array<double>")
    pair = spark.createDataFrame([(1, [1.0, 0.0], None), (2, [1.0, 0.0], 4)], "qid long, v array<double>, positive_id long")
    found = {r.qid: (r.hard, r.easy) for r in mining.similarity_bands(pair, corpus, 2).collect()}
    assert found == {1: (3.5, -3.5), 2: (2.0, -3.5)}


def nearest(ids, v, k):
    """Ids of the k nearest other rows of each row, in order."""
    scores = v @ v.T
    np.fill_diagonal(scores, -np.inf)
    return {int(own): ids[np.lexsort((ids, -row))[:k]].tolist() for own, row in zip(ids, scores, strict=True)}


def unit(v):
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def judged(ids, labels):
    return {int(q): {int(c): 1 + int(q + c) % 2 for c in ids[labels == label] if c != q} for q, label in zip(ids, labels, strict=True)}


def rows_of(spark, name):
    return catalogue.QUERIES[name](spark, DATA).collect()


def test_relevance_is_of_every_query(spark):
    ids, labels, _ = table()
    expected = {(q, c, s) for q, found in judged(ids, labels).items() for c, s in found.items()}
    assert {tuple(r) for r in rows_of(spark, "qrels_max")} == expected


def test_metrics_are_of_every_query(spark):
    ids, labels, v = table()
    rel = {q: x for q, x in judged(ids, labels).items() if x}
    near = nearest(ids, v, 10)
    gain = lambda values: sum(x / np.log2(i + 2) for i, x in enumerate(values))
    hits = {q: [x.get(c, 0) for c in near[q]] for q, x in rel.items()}
    mean = lambda f: np.mean([f(q) for q in rel])
    share = lambda k: mean(lambda q: sum(x > 0 for x in hits[q][:k]) / len(rel[q]))
    hit = lambda k: mean(lambda q: any(hits[q][:k]))
    ndcg = mean(lambda q: gain(hits[q][:5]) / gain(sorted(rel[q].values(), reverse=True)[:5]))
    assert tuple(rows_of(spark, "beir_eval")[0]) == pytest.approx((len(ids), hit(1), ndcg, share(5)), abs=2e-6)
    assert tuple(rows_of(spark, "recall_at_k")[0]) == pytest.approx((len(ids), hit(1), hit(5), hit(10), share(1), share(5), share(10)), abs=2e-6)
    first = {q: next((1 / (i + 1) for i, x in enumerate(found) if x), 0) for q, found in hits.items()}
    assert {r.qid: r.mrr_at_10 for r in rows_of(spark, "mrr_at_10")} == pytest.approx(first, abs=2e-6)


def test_recall_of_shorter_vectors_is_of_every_query(spark):
    ids, _, v = table()
    full = nearest(ids, v, 10)
    shared = lambda other: {q: len(set(full[q]) & set(other[q])) / 10 for q in full}
    expected = {(q, k): x for k in (32, 16) for q, x in shared(nearest(ids, unit(v[:, :k]), 10)).items()}
    assert {(r.qid, r.dims): r.overlap for r in rows_of(spark, "mrl_recall")} == pytest.approx(expected)
    coarse = np.sign(v) * np.floor(np.abs(v) * 127 + 0.5)
    assert {r.qid: r.overlap for r in rows_of(spark, "quantized_recall")} == pytest.approx(shared(nearest(ids, coarse, 10)))


def test_reranking_is_of_every_query(spark):
    ids, _, v = table()
    place = {x: i for i, x in enumerate(ids.tolist())}
    expected = {}
    for q, near in nearest(ids, unit(v[:, :16]), 20).items():
        scored = sorted((-float(v[place[q]] @ v[place[c]]), c) for c in near)[:5]
        expected |= {(q, i + 1, c): 1 / (1 + np.exp(10 * s)) for i, (s, c) in enumerate(scored)}
    assert {(r.qid, r.rank, r.cid): r.score for r in rows_of(spark, "rerank_two_stage")} == pytest.approx(expected, abs=2e-6)


OPENING = "The first forty characters and some more are one and the same in all of these texts"


def test_items_and_instructions_of_whole_texts(spark, tmp_path):
    ends = [" one", " two?", ": three ", " four!\n", " five", " six."]
    texts = {i: OPENING + end for i, end in zip((2, 4, 6, 8, 11, 14), ends, strict=True)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    items = {r.doc_id: r for r in catalogue.QUERIES["build_item"](spark, str(tmp_path)).collect()}
    assert {i: items[i].text for i in texts} == {i: x if i % 2 == 0 else "NULL" for i, x in texts.items()}
    assert {i: items[i].key for i in texts if i != 6} == {i: "TXT::" + (x.strip() if i % 2 == 0 else "") for i, x in texts.items() if i != 6}
    assert len({items[i].key for i in texts}) == len(texts)
    found = {r.doc_id: (r.instruction, r.stopped) for r in catalogue.QUERIES["instruction_punct"](spark, str(tmp_path)).collect()}
    assert found == {i: (x.strip() if x.strip()[-1] in "?!." else x.strip() + ".", x + ".") for i, x in texts.items()}


def test_options_of_whole_turns(spark, tmp_path):
    turns = [OPENING + ". Yes. ", OPENING + ", no", "A. " + OPENING]
    rows = [(1, i, x) for i, x in enumerate(turns)]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    cleaned = {r.i: r.cleaned for r in catalogue.QUERIES["option_clean"](spark, str(tmp_path)).collect()}
    assert cleaned == {0: "Yes", 1: OPENING + ", no", 2: OPENING}
    options = [f"({chr(65 + i)}) {x}" for i, x in enumerate([*turns, turns[0]])]
    expected = hashlib.md5("\n".join(["Which?", *options]).encode()).hexdigest()
    assert [tuple(r) for r in catalogue.QUERIES["qa_template"](spark, str(tmp_path)).collect()] == [(1, expected, 3, options[3])]


def test_long_conversations_are_kept(spark, tmp_path):
    sizes = {1: 26, 2: 27, 3: 300}
    rows = [(c, i, f"turn {i}") for c, n in sizes.items() for i in range(n)]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r.conv_id: (r.prompt_md5, r.answer_index, r.answer) for r in catalogue.QUERIES["qa_template"](spark, str(tmp_path)).collect()}
    expected = {}
    for c, n in sizes.items():
        options = [f"({chr(65 + i)}) {x}" for i, x in enumerate([*(f"turn {i}" for i in range(n)), "turn 0"])]
        expected[c] = (hashlib.md5("\n".join(["Which?", *options]).encode()).hexdigest(), n, options[n])
    assert found == expected


def test_relevance_is_made_and_grouped_in_one_place(spark):
    e = vectors(spark, DATA)
    plan = metrics.max_relevance(relevance(e))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(qid#\d+L?, \d+\)", plan)
    assert not re.search(r"hashpartitioning\(qid#\d+L?, cid#", plan)  # no shuffle of pairs


def odd_ids(spark, folder):
    rows = [(i, [float(i % 3), 1.0], i % 2 if i % 5 else 3) for i in range(-7, 9)] + [(20, [1.0, 1.0], None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")


def test_relevance_of_negative_ids(spark, tmp_path):
    odd_ids(spark, tmp_path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    for name in ("qrels_max", "mrr_at_10"):
        assert sorted(map(tuple, catalogue.QUERIES[name](spark, str(tmp_path)).collect())) == sorted(con.execute(catalogue.ORACLES[name]).fetchall()), name


def test_metrics_take_no_row_for_each_relevant_pair(spark, monkeypatch):
    def pairwise(*_):
        raise AssertionError("relevance was made pair by pair")

    monkeypatch.setattr(retrieval, "relevance", pairwise)
    for name in ("beir_eval", "recall_at_k", "mrr_at_10"):
        assert rows_of(spark, name)


def test_ideal_of_grades(spark):
    qrels = spark.createDataFrame([(1, c, r) for c, r in enumerate([3, 3, 1, 2, 1, 1])] + [(2, 0, 1)], "qid long, cid long, rel long")
    ranked = spark.createDataFrame([(1, 1, 2), (1, 2, 9), (1, 3, 0), (2, 1, 5)], "qid long, rank int, cid long")
    degrees = qrels.groupBy("qid", "rel").count().withColumnRenamed("count", "n")
    own = ranked.join(qrels, ["qid", "cid"]).select("qid", "rank", "rel")
    one, two = (sorted(map(tuple, x.collect())) for x in (metrics.at_k(ranked, qrels, (1, 4, 9)), metrics.at_k_of_grades(own, degrees, (1, 4, 9))))
    assert len(one) == len(two) == 2
    for a, b in zip(one, two, strict=True):
        assert a == pytest.approx(b)
