"""Small cases, one for each rule that is easily got wrong."""

import math

import pytest
from pyspark.sql import functions as F

from vectorloom.functions import media, text, vectors
from vectorloom.functions.tables import ordinals, prefix
from vectorloom.operators import batching, losses, metrics, mining, mixing, reports
from vectorloom.operators.knn import topk


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in TYPES.items() if k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


TYPES = {"t": "string", "a": "array<string>", "v": "array<double>", "w": "array<double>"}


def ranked(spark, scores, positive):
    rows = [(1, i + 1, 100 + i, float(s), float(positive)) for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, "qid long, rank int, cid long, score double, positive_score double")


def test_margin_is_inclusive(spark):
    found = mining.select_negatives(ranked(spark, [0.5 + 0.1], 0.5), pad=False).collect()
    assert [r.cid for r in found] == [100]


def test_padding_takes_those_over_the_margin_in_rank_order(spark):
    found = mining.select_negatives(ranked(spark, [0.9, 0.8, 0.3, 0.2, 0.1], 0.3)).orderBy("pos_in_list").collect()
    assert [(r.cid, r.was_padded) for r in found] == [(102, False), (103, False), (104, False), (100, True), (101, True)]


def test_small_corpus_gives_fewer(spark):
    v = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(4)], "cid long, v array<double>")
    pairs = v.where("cid = 0").select(F.col("cid").alias("qid"), "v", F.lit(1).cast("long").alias("positive_id"))
    assert sorted(r.cid for r in mining.mine(pairs, v).collect()) == [2, 3]


def test_search_ties_zero_and_null(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, [2.0, 0.0]), (5, None)]
    c = spark.createDataFrame(rows, "cid long, v array<double>")
    q = spark.createDataFrame([(2, [1.0, 0.0])], "qid long, v array<double>")
    found = [r.cid for r in topk(q, c, 2, exclude_self=True).orderBy("rank").collect()]
    assert found == [4, 1]
    assert topk(q.limit(0), c, 2).count() == 0


def test_budget_split():
    assert mixing.split_budget(10, 3) == [4, 3, 3]
    assert mixing.split_budget(0, 2) == [0, 0]


def test_cap_zero_is_no_cap(spark):
    rows = spark.range(5)
    assert prefix(rows, ["id"], 0).count() == 5
    caps = spark.createDataFrame([("x", 0), ("y", 1)], "name string, cap long")
    both = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1), ("y", 2), ("z", 1)], "name string, k long")
    assert sorted(map(tuple, mixing.cap_rows(both, "name", "k", caps).collect())) == [("x", 1), ("x", 2), ("y", 1)]


def test_mix_skips_what_fails(spark):
    def bad():
        raise OSError("gone")

    seen = []
    got = mixing.mix([("a", lambda: spark.range(2)), ("b", bad)], lambda n, e: seen.append(n))
    assert got.count() == 2 and seen == ["b"]
    with pytest.raises(ValueError):
        mixing.mix([("b", bad)])


def test_cleaning(spark):
    assert one(spark, text.clean_placeholder(F.col("t")), t=" a ") == " a "
    assert one(spark, text.clean_always(F.col("t")), t=" a ") == "a"
    assert one(spark, text.clean_always(F.lit(None).cast("string"))) == ""


@pytest.mark.parametrize(("given", "expected"), [("Find it", "Find it."), ("Find it?", "Find it?"), (" ", text.DEFAULT_INSTRUCTION)])
def test_punctuation(spark, given, expected):
    assert one(spark, text.punctuate(F.col("t")), t=given) == expected


def test_padding_of_lists(spark):
    rows = spark.createDataFrame([(1, ["a", "b"]), (1, []), (1, ["c", "d", "e"])], "b int, x array<string>")
    found = batching.pad_negatives(rows, "b", "x", F.lit("NULL")).select("padded").collect()
    assert sorted(r.padded for r in found) == [["NULL"] * 3, ["a", "b", "b"], ["c", "d", "e"]]


def test_frames(spark):
    frames = [str(i) for i in range(6)]
    assert one(spark, media.sample_frames(F.col("a"), 3), a=frames) == ["0", "2", "5"]
    assert one(spark, media.sample_frames(F.col("a"), 3), a=["x"]) == ["x"] * 3
    assert one(spark, media.sample_frames(F.col("a"), 3, pad=False), a=["x"]) == ["x"]
    assert one(spark, media.sample_frames(F.col("a"), 3), a=[]) == []


def test_last_matching_option(spark):
    assert one(spark, text.last_match(F.col("a"), F.lit("x")), a=["x", "y", "x"]) == 2
    assert one(spark, F.get(text.lettered(F.col("a")), F.lit(2)), a=["x", "y", "x"]) == "(C) x"
    assert one(spark, text.last_match(F.col("a"), F.lit("q")), a=["x"]) == -1


def test_metrics_count_rows_outside_of_the_corpus(spark):
    ranking = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (1, 3, 12)], "qid long, rank int, cid long")
    qrels = spark.createDataFrame([(1, 11, 2), (1, 12, 1), (1, 99, 0)], "qid long, cid long, score long")
    found = metrics.at_k(ranking, metrics.max_relevance(qrels), (5,)).first()
    expected = (2 / math.log2(3) + 1 / 2) / (2 / 1 + 1 / math.log2(3))
    assert found.ndcg_at_5 == pytest.approx(expected)
    more = qrels.union(spark.createDataFrame([(1, 50, 1)], qrels.schema))
    assert metrics.at_k(ranking, metrics.max_relevance(more), (5,)).first().recall_at_5 == pytest.approx(2 / 3)


def test_relevance_takes_the_largest_positive(spark):
    qrels = spark.createDataFrame([(1, 5, 1), (1, 5, 2), (1, 6, 0)], "qid long, cid long, score long")
    assert [tuple(r) for r in metrics.max_relevance(qrels).collect()] == [(1, 5, 2)]


def test_hits_at_ties_and_unknown_labels(spark):
    scores = spark.createDataFrame([(1, 0, 0.7), (1, 1, 0.7), (2, 0, 0.1)], "qid long, cid long, score double")
    truth = spark.createDataFrame([(1, 0), (2, -1), (3, 0)], "qid long, gt long")
    assert {r.qid: r.hit for r in metrics.hit_at_1(scores, truth).collect()} == {1: 1, 2: 0, 3: 0}


def test_losses_without_pairs_or_negatives(spark):
    b = spark.createDataFrame([(0, 0, [1.0, 0.0], [0.0, 1.0], 1.0), (0, 1, [0.0, 1.0], [1.0, 0.0], 1.0)], "batch long, slot long, a array<double>, b array<double>, score double")
    assert losses.cosent(b).first().loss == 0
    rows = b.select("batch", "slot", F.col("a").alias("q"), F.col("b").alias("d"))
    none = spark.createDataFrame([], "batch long, slot long, n array<double>")
    assert losses.classification_rows(rows, none).first().loss == pytest.approx(math.log(2))


def test_comparison_of_a_missing_task(spark):
    a = spark.createDataFrame([("t1", 50.0)], "task string, score double")
    found = reports.compare(a, a.limit(0)).first()
    assert found.delta == -50 and found.missing_b and not found.missing_a


def test_hierarchy(spark):
    rows = spark.createDataFrame([("X", "a", "1", 0.2), ("X", "a", "2", 0.4), ("Y", "b", "1", 0.9)], "type string, task string, subset string, score double")
    found = {(r.level, r.name): r.score for r in reports.hierarchy_means(rows).collect()}
    assert found == {("task", "a"): 0.3, ("task", "b"): 0.9, ("type", "X"): 0.3, ("type", "Y"): 0.9, ("mean_subset", "all"): 0.5, ("mean_type", "all"): 0.6}


@pytest.mark.parametrize(("n", "expected"), [(10, [3, 3, 3, 1]), (5, [2, 2, 1])])
def test_shards(spark, n, expected):
    found = batching.shard_ranges(spark.range(n), "id", 4).groupBy("shard").count().orderBy("shard").collect()
    assert [r["count"] for r in found] == expected


def test_stratified_batches(spark):
    rows = spark.range(103).select("id", F.when(F.col("id") < 70, "A").otherwise("B").alias("g"))
    found = batching.stratified_batches(rows, "g", "id", 32)
    assert {(r.g, r.batch): r["count"] for r in found.groupBy("g", "batch").count().collect()} == {("A", 0): 32, ("A", 1): 32, ("B", 0): 32}


def test_ordinals_with_one_large_group_and_nulls(spark):
    rows = spark.range(50).select("id", F.when(F.col("id") % 10 == 0, F.lit(None).cast("string")).otherwise("x").alias("g"))
    found = ordinals(rows, ["id"], by="g").collect()
    assert sorted(r.ordinal for r in found if r.g == "x") == list(range(45))
    assert sorted(r.ordinal for r in found if r.g is None) == list(range(5))
    assert ordinals(rows.limit(0), ["id"]).count() == 0


def test_vectors(spark):
    assert one(spark, vectors.l2_normalize(F.col("v")), v=[0.0, 0.0]) == [0.0, 0.0]
    assert one(spark, vectors.prefix(F.col("v"), 2), v=[3.0, 4.0, 9.0]) == pytest.approx([0.6, 0.8])
    assert one(spark, vectors.cosine(F.col("v"), F.col("w")), v=[1.0, 0.0], w=[2.0, 2.0]) == pytest.approx(math.sqrt(0.5))


def test_losses_share_scores_of_pairs(spark):
    rows = spark.createDataFrame([(0, i, [0.1 * i, 1.0], [1.0, 0.2 * i]) for i in range(5)] + [(1, 0, [1.0, 0.0], [1.0, 0.0])], "batch long, slot long, q array<double>, d array<double>")
    scores = losses.pair_scores(rows)
    assert scores.count() == 20
    for stage, alpha in ((1, None), (2, 9.0)):
        one, two = (sorted(map(tuple, losses.infonce_rows(rows, stage, alpha=alpha, scores=x).collect())) for x in (None, scores.drop("qq", "dd") if stage == 2 else scores))
        assert one == two and len(one) == 6
