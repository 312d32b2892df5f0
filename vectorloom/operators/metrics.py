"""Retrieval metrics as aggregates over ranked rows and relevance tables."""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vectorloom.functions.tables import materialise, ordinals


def max_relevance(qrels: DataFrame) -> DataFrame:
    """qid, cid, rel: the largest positive score of each pair."""
    return qrels.where("score > 0").groupBy("qid", "cid").agg(F.max("score").alias("rel"))


def without_relevance(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """Queries that no positive score names."""
    return queries.join(qrels.where("score > 0").select("qid").distinct(), "qid", "left_anti")


def at_k(ranked: DataFrame, qrels: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """qid and hit, ndcg, recall and mrr at each of ``ks`` for every query with relevance.

    ``ranked``: qid, rank, cid; ``qrels``: qid, cid, rel (see ``max_relevance``). Gains are linear. The ideal and
    the number of relevant rows count all of them, also such as are not in the corpus.
    """
    gain = _gain
    ideal = qrels.withColumn("_at", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rel"), "cid")))
    best = ideal.groupBy("qid").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(F.when(F.col("_at") <= k, gain(F.col("_at"))).otherwise(0.0)).alias(f"_ideal{k}") for k in ks]
    )
    return _measures(best, ranked.where(F.col("rank") <= max(ks)).join(qrels, ["qid", "cid"]), ks)


def at_k_of_grades(judged: DataFrame, grades: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """What ``at_k`` gives, where relevance is told by a rule: it needs no row for each relevant pair.

    ``judged``: qid, rank, rel of the ranked rows that are relevant; ``grades``: qid, rel, n, how many rows are relevant to
    a query by each degree, each degree once.
    """
    before = F.coalesce(F.sum("n").over(Window.partitionBy("qid").orderBy(F.desc("rel")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = grades.where("n > 0").withColumn("_before", before)
    discounts = list(accumulate((1 / math.log2(i + 2) for i in range(max(ks))), initial=0.0))
    upto = lambda at, k: F.get(F.lit(discounts), F.least(at, F.lit(k)).cast("int"))
    best = placed.groupBy("qid").agg(
        F.sum("n").alias("_n"), *[F.sum(F.col("rel") * (upto(F.col("_before") + F.col("n"), k) - upto(F.col("_before"), k))).alias(f"_ideal{k}") for k in ks]
    )
    return _measures(best, judged.where(F.col("rank") <= max(ks)), ks)


def _gain(rank: Column) -> Column:
    return F.col("rel") / F.log2(rank + F.lit(1.0))


def _measures(best: DataFrame, found: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """The measures from the ideal of each query and the relevant rows that were found (qid, rank, rel)."""
    gain = _gain
    sums = [
        c
        for k in ks
        for c in (
            F.count_if(F.col("rank") <= k).alias(f"_found{k}"),
            F.sum(F.when(F.col("rank") <= k, gain(F.col("rank"))).otherwise(0.0)).alias(f"_gain{k}"),
            F.min(F.when(F.col("rank") <= k, F.col("rank"))).alias(f"_first{k}"),
        )
    ]
    both = best.join(found.groupBy("qid").agg(*sums), "qid", "left")
    return both.select(
        "qid",
        *[
            c
            for k in ks
            for c in (
                (F.coalesce(F.col(f"_found{k}"), F.lit(0)) > 0).cast("int").alias(f"hit_at_{k}"),
                F.coalesce(F.col(f"_gain{k}") / F.nullif(F.col(f"_ideal{k}"), F.lit(0.0)), F.lit(0.0)).alias(f"ndcg_at_{k}"),
                (F.coalesce(F.col(f"_found{k}"), F.lit(0)) / F.col("_n")).alias(f"recall_at_{k}"),
                F.coalesce(1.0 / F.col(f"_first{k}"), F.lit(0.0)).alias(f"mrr_at_{k}"),
            )
        ],
    )


def mean_of(metrics: DataFrame, digits: int = 6) -> DataFrame:
    """One row: the mean of every metric and the number of queries."""
    names = [c for c in metrics.columns if c != "qid"]
    return metrics.agg(F.count(F.lit(1)).alias("n_queries"), *[F.round(F.avg(c), digits).alias(c) for c in names])


def argmax(scores: DataFrame, key: str, choice: str, score: str) -> DataFrame:
    """``key`` and the ``choice`` of the largest score; the least choice at a tie."""
    return scores.groupBy(key).agg(F.max_by(choice, F.struct(F.col(score), (-F.col(choice)).alias("_low"))).alias(choice))


def hit_at_1(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """qid, predicted, hit for every query of ``truth`` (qid, gt); a gt that is null or -1 can't be hit but counts."""
    best = argmax(scores, "qid", "cid", "score").withColumnRenamed("cid", "predicted")
    return truth.join(best, "qid", "left").select("qid", "predicted", F.coalesce((F.col("predicted") == F.col("gt")) & (F.col("gt") >= 0), F.lit(False)).cast("int").alias("hit"))


def overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """qid, overlap: the share of the ``k`` rows that two rankings have in common for each query."""
    both = a.select("qid", "cid").join(b.select("qid", "cid"), ["qid", "cid"]).groupBy("qid").count()
    return a.select("qid").distinct().join(both, "qid", "left").select("qid", (F.coalesce(F.col("count"), F.lit(0)) / k).alias("overlap"))


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the rank correlation of two columns, with mean ranks at ties.

    Values are numbered by a range sort, so no task sees them all; a value's mean rank follows from the first and
    last of its numbers.
    """

    def ranks(c: str) -> DataFrame:
        placed = ordinals(both.select(F.col(c).alias(f"_v_{c}")), [f"_v_{c}"], name="_at")
        return placed.groupBy(f"_v_{c}").agg(((F.min("_at") + F.max("_at")) / 2 + 1).alias(f"_r_{c}"))

    both = materialise(rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b), "pairs")
    ranked = both.join(ranks(a), F.col(a) == F.col(f"_v_{a}")).join(ranks(b), F.col(b) == F.col(f"_v_{b}"))
    return ranked.agg(F.round(F.corr(f"_r_{a}", f"_r_{b}"), 6).alias("spearman"), F.count(F.lit(1)).alias("n"))
