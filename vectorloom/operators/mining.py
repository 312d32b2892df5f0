"""Hard negatives: near corpus rows that are not too near to be unlabelled positives."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vectorloom.functions.jobs import side_by_side
from vectorloom.functions.text import positive_key
from vectorloom.functions.tables import ordinals
from vectorloom.functions.vectors import dot
from vectorloom.operators.knn import topk

TOP_K, NEGATIVES, MARGIN = 50, 15, 0.1


def dedup_corpus(rows: DataFrame, text: str, image: str | None, order: str) -> DataFrame:
    """corpus_id, key, first: different items, numbered from 0 as they are first seen by ``order``."""
    named = rows.select(order, item_key(text, image).alias("key")).withColumn("_h", key_hash(F.col("key")))
    first = named.groupBy("_h").agg(F.min(order).alias("first"), F.min("key").alias("key"))
    return ordinals(first, ["first"], name="corpus_id").select("corpus_id", "key", "first")


def item_key(text: str, image: str | None) -> Column:
    return positive_key(F.col(text), F.col(image) if image else F.lit(None).cast("string"))


def key_hash(key: Column) -> Column:
    """128 bits that stand for a key, so that no whole text is a key of a shuffle."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b"))


def link_corpus(rows: DataFrame, corpus: DataFrame, text: str, image: str | None) -> DataFrame:
    """``rows`` with the corpus_id of their item in ``corpus`` (see ``dedup_corpus``)."""
    hashed = corpus.select(key_hash(F.col("key")).alias("_h"), "corpus_id")
    return rows.withColumn("_h", key_hash(item_key(text, image))).join(hashed, "_h").drop("_h")


def mine_sources(
    spark: SparkSession,
    sources: dict[str, Callable[[], tuple[DataFrame, DataFrame]]],
    wanted: Iterable[str],
    folder: str,
    done: Callable[[str], bool],
    write: Callable[[DataFrame, str], None],
    count: int = 15,
    most: int = 4,
) -> DataFrame:
    """source, status, n_rows, avg_negatives, error: mines every wanted source into a table of its own in ``folder``.

    A source gives pairs (qid, v, positive_id) and a corpus (cid, v). One whose table is there is skipped, one without rows is
    empty, and one that fails doesn't stop the others, of which ``most`` run side by side. ``avg_negatives`` counts those
    under the margin.
    """

    def one(name: str) -> tuple:
        path = f"{folder}/{name}"
        if name not in sources:
            return name, "unknown", None, None, None
        if done(path):
            return name, "exists", None, None, None
        pairs, corpus = sources[name]()
        if pairs.isEmpty():
            return name, "empty", 0, None, None
        write(mine(pairs, corpus, count=count), path)
        whole = statistics(spark.read.parquet(path), pairs, count).first()
        own = spark.read.parquet(path).where(~F.col("was_padded")).count()
        return name, "mined", whole["n_queries"], round(own / whole["n_queries"], 6), None

    ran = side_by_side(spark, {name: partial(one, name) for name in dict.fromkeys(wanted)}, most)
    out = [x.value or (name, "failed", None, None, x.message[:200]) for name, x in ran.items()]
    return spark.createDataFrame(out, "source string, status string, n_rows long, avg_negatives double, error string")


def mining_totals(summary: DataFrame) -> DataFrame:
    """One row: sources that were mined, their rows, and the mean length of their lists."""
    mined = F.col("status") == "mined"
    return summary.agg(
        F.count_if(mined).alias("n_sources"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.round(F.sum(F.col("avg_negatives") * F.col("n_rows")) / F.sum(F.when(mined, F.col("n_rows"))), 6).alias("avg_negatives")
    )


def select_negatives(ranked: DataFrame, count: int = NEGATIVES, margin: float = MARGIN, pad: bool = True) -> DataFrame:
    """qid, pos_in_list, cid, score, was_padded from qid, rank, cid, score, positive_score.

    In the order of ranks, candidates of at most positive_score + margin are chosen until there are ``count``.
    If there are fewer, the others are added in the order of ranks, also those over the margin.
    """
    ok = F.col("score") <= F.col("positive_score") + margin
    by_rank = Window.partitionBy("qid").orderBy("rank")
    chosen = ranked.withColumn("_ok", ok).withColumn(
        "_chosen", F.col("_ok") & (F.sum(F.col("_ok").cast("int")).over(by_rank.rowsBetween(Window.unboundedPreceding, 0)) <= count)
    )
    order = Window.partitionBy("qid").orderBy(F.desc("_chosen"), "rank")
    listed = (chosen if pad else chosen.where("_chosen")).withColumn("pos_in_list", F.row_number().over(order))
    return listed.where(F.col("pos_in_list") <= count).select("qid", "pos_in_list", "cid", "score", (~F.col("_chosen")).alias("was_padded"))


def mine(pairs: DataFrame, corpus: DataFrame, k: int = TOP_K, count: int = NEGATIVES, margin: float = MARGIN, pad: bool = True, exclude_self: bool = True) -> DataFrame:
    """Negatives of each pair (qid, v, positive_id) from ``corpus`` (cid, v).

    The positive takes a place among the ``k`` nearest, as it is in the corpus, and is then left out.
    """
    near = topk(pairs.select("qid", "v"), corpus, k, exclude_self)
    return select_negatives(candidates(near, pairs, corpus), count, margin, pad)


def candidates(near: DataFrame, pairs: DataFrame, corpus: DataFrame) -> DataFrame:
    """``near`` without the positives, with positive_score added."""
    scored = pairs.join(corpus.select(F.col("cid").alias("positive_id"), F.col("v").alias("_p")), "positive_id")
    scored = scored.select("qid", "positive_id", dot(F.col("v"), F.col("_p")).alias("positive_score"))
    return near.join(scored, "qid").where(F.col("cid") != F.col("positive_id"))


def statistics(negatives: DataFrame, queries: DataFrame, count: int = NEGATIVES) -> DataFrame:
    """One row: queries with a full, partial or empty list of unpadded negatives, padded ones, and the mean length."""
    own = negatives.groupBy("qid").agg(F.sum(F.when(F.col("was_padded"), 0).otherwise(1)).alias("passed"), F.count(F.lit(1)).alias("listed"))
    each = queries.select("qid").join(own, "qid", "left").fillna(0, ["passed", "listed"])
    return each.agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.count_if(F.col("passed") >= count).alias("n_full"),
        F.count_if((F.col("passed") > 0) & (F.col("passed") < count)).alias("n_partial"),
        F.count_if(F.col("passed") == 0).alias("n_zero"),
        F.count_if(F.col("listed") > F.col("passed")).alias("n_padded"),
        F.coalesce(F.sum("listed"), F.lit(0)).alias("total_negatives"),
        F.round(F.coalesce(F.sum("listed"), F.lit(0)) / F.greatest(F.count(F.lit(1)), F.lit(1)), 6).alias("avg_negatives"),
    )


def class_label_negatives(queries: DataFrame, labels: DataFrame, k: int, count: int) -> DataFrame:
    """qid, pos_in_list, label: the nearest labels that aren't the query's own.

    ``queries``: qid, v, label; ``labels``: cid, v, label, one row a label. The cut at ``k`` is before the own
    label goes.
    """
    near = topk(queries.select("qid", "v"), labels.select("cid", "v"), k)
    named = near.join(labels.select("cid", F.col("label").alias("other")), "cid").join(queries.select("qid", "label"), "qid").where("other <> label")
    by = Window.partitionBy("qid").orderBy("rank")
    return named.withColumn("pos_in_list", F.row_number().over(by)).where(F.col("pos_in_list") <= count).select("qid", "pos_in_list", F.col("other").alias("label"))


def refine_positives(candidates_: DataFrame, least_positive: float, delta: float) -> DataFrame:
    """Of qid, cid, score, is_positive: the negatives of queries that have a positive over ``least_positive``.

    A negative is below the mean score of the query's positives plus ``delta``.
    """
    by = Window.partitionBy("qid")
    positive = F.when(F.col("is_positive"), F.col("score"))
    seen = candidates_.withColumn("_max", F.max(positive).over(by)).withColumn("_mean", F.avg(positive).over(by))
    return seen.where((F.col("_max") > least_positive) & ~F.col("is_positive") & (F.col("score") < F.col("_mean") + delta)).select("qid", "cid", "score")


def similarity_bands(pairs: DataFrame, corpus: DataFrame, width: int = 5, exclude_self: bool = True) -> DataFrame:
    """qid, hard, easy: mean score of the ``width`` nearest and of the ``width`` farthest corpus rows of each pair (qid, v, positive_id).

    Each band is searched in all of ``corpus`` (cid, v), the far one by the negated vector; the positive is in neither.
    """
    own = pairs.select("qid", "positive_id")
    by = Window.partitionBy("qid").orderBy("rank")

    def band(queries: DataFrame, name: str) -> DataFrame:
        near = topk(queries, corpus, width + 1, exclude_self).join(own, "qid").where(~F.col("cid").eqNullSafe(F.col("positive_id")))
        return near.withColumn("_at", F.row_number().over(by)).where(F.col("_at") <= width).groupBy("qid").agg(F.avg("score").alias(name))

    hard = band(pairs.select("qid", "v"), "hard")
    easy = band(pairs.select("qid", F.transform("v", lambda x: -x).alias("v")), "easy")
    return hard.join(easy, "qid").select("qid", "hard", (-F.col("easy")).alias("easy"))
