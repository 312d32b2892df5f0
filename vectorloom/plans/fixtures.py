"""Roles that the test tables play in the queries: who is a query, a positive, a batch, a task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.functions.tables import materialise, ordinals
from vectorloom.operators.knn import topk

BATCH = 32
#: Pairs of ids in a part of ``relevance``, parts at most, and rows of ids and labels that are broadcast at most.
PART_PAIRS, MOST_PARTS, MOST_HELD = 1_000_000, 20_000, 3_000_000

#: SQL of the same roles: e (vectors), near (pairs of rows with their score), pairs (qid, pid).
SQL_VECTORS = "e AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings)"
SQL_SCORES = "s AS (SELECT a.id AS qid, b.id AS cid, a.label AS ql, b.label AS cl, list_inner_product(a.v, b.v) AS score FROM e a JOIN e b ON a.id <> b.id)"
SQL_PAIRS = """
    pairs AS (
        SELECT id AS qid, CASE WHEN id % 2 = 0 THEN near ELSE coalesce(following, least_id) END AS pid
        FROM (SELECT id, label, lead(id) OVER (PARTITION BY label ORDER BY id) AS following, min(id) OVER (PARTITION BY label) AS least_id FROM e)
        LEFT JOIN (SELECT qid, cid AS near FROM s WHERE ql = cl QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, cid) = 1) ON qid = id)
"""
SQL_TOP = "top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, cid) AS rk FROM s)"
SQL_BATCHES = """
    b AS (
        SELECT id // 32 AS batch, id % 32 AS slot, e.v AS q, p.v AS d, label
        FROM e JOIN pairs ON qid = id JOIN (SELECT id AS pid, v FROM e) p USING (pid)
        WHERE id // 32 < (SELECT count(*) // 32 FROM e))
"""


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, v."""
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("v"))


def as_queries(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(F.col("id").alias("qid"), "v", *more)


def as_corpus(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(F.col("id").alias("cid"), "v", *more)


def pairs(rows: DataFrame) -> DataFrame:
    """qid, v, positive_id: even ids have the nearest other row of their label, odd ones the next id of it, the last the first."""
    near = topk(as_queries(rows.where("id % 2 = 0"), "label"), as_corpus(rows, "label"), 1, exclude_self=True, within="label")
    # rows of a label are numbered by a range sort, so that a common label isn't one task's
    placed = ordinals(rows.select("id", "label"), ["id"], by="label", name="at")
    later = placed.select("label", (F.col("at") - 1).alias("at"), F.col("id").alias("_next"))
    first = placed.where("at = 0").select("label", F.col("id").alias("_first"))  # a row for each label
    following = placed.join(later, ["label", "at"], "left").join(first, "label").select("id", F.coalesce("_next", "_first").alias("_next"))
    chosen = rows.join(following, "id").join(near.select(F.col("qid").alias("id"), F.col("cid").alias("_near")), "id", "left")
    named = chosen.select(F.col("id").alias("qid"), "v", F.when(F.col("id") % 2 == 0, F.col("_near")).otherwise(F.col("_next")).alias("positive_id"))
    return materialise(named, "pairs")  # read several times, and dear to make


def batches(rows: DataFrame) -> DataFrame:
    """batch, slot, q, d, label: pairs in batches of 32 by id; the last one goes unless it is full."""
    full = rows.count() // BATCH
    own = pairs(rows).join(rows.select(F.col("id").alias("positive_id"), F.col("v").alias("d")), "positive_id").join(rows.select(F.col("id").alias("qid"), "label"), "qid")
    batch = F.floor(F.col("qid") / BATCH)
    return own.where(batch < full).select(batch.cast("long").alias("batch"), (F.col("qid") % BATCH).cast("long").alias("slot"), F.col("v").alias("q"), "d", "label")


def relevance(rows: DataFrame) -> DataFrame:
    """qid, cid, score: rows of the same label by 1 or 2; a few others by 0, and each relevant pair once more by 1.

    There are as many rows of the same label as the squares of the labels' sizes. Queries are dealt by their id to so many parts that
    each has about ``PART_PAIRS`` pairs, and all rows of a pair are made in one part: what groups by query or pair
    shuffles none of them.
    """
    pairs_ = rows.groupBy("label").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0] or 0
    parts = min(MOST_PARTS, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs_ // PART_PAIRS)))
    q = rows.select(F.col("id").alias("qid"), F.col("label").alias("ql"))
    c = rows.select(F.col("id").alias("cid"), F.col("label").alias("cl"))
    score = F.lit(1) + (F.col("qid") + F.col("cid")) % 2
    scores = F.when(score > 0, F.array(score, F.lit(1).cast("long"))).otherwise(F.array(score))
    # ids and labels alone are broadcast, up to some tens of MB
    dealt, held = q.repartition(parts, "qid"), F.broadcast(c) if c.limit(MOST_HELD + 1).count() <= MOST_HELD else c
    same = dealt.join(held, F.col("ql") == F.col("cl")).where("qid <> cid").select("qid", "cid", F.explode(scores).alias("score"))
    # the sum of two ids is a multiple of 97: an equality of one column of each side, which a hash join can take
    fits = F.pmod("qid", F.lit(97)) == F.pmod(-F.col("cid"), F.lit(97))
    zero = q.join(c, fits).where("ql <> cl").select("qid", "cid", F.lit(0).cast("long").alias("score"))
    return same.unionByName(zero)


def judged(ranked: DataFrame, rows: DataFrame) -> DataFrame:
    """qid, rank, rel: the rows of ``ranked`` that are relevant by the rule of ``relevance``; ids are not negative."""
    named = ranked.join(rows.select(F.col("id").alias("qid"), F.col("label").alias("ql")), "qid").join(rows.select(F.col("id").alias("cid"), F.col("label").alias("cl")), "cid")
    return named.where("ql = cl AND qid <> cid").select("qid", "rank", (F.lit(1) + (F.col("qid") + F.col("cid")) % 2).alias("rel"))


def grades(rows: DataFrame) -> DataFrame:
    """qid, rel, n: how many rows are relevant to each query by each degree, counted by label and parity; ids are not negative."""
    parity = F.col("id") % 2
    sizes = rows.groupBy("label").agg(F.count_if(parity == 0).alias("even"), F.count_if(parity == 1).alias("odd"))
    own, other = F.when(parity == 0, F.col("even")).otherwise(F.col("odd")), F.when(parity == 0, F.col("odd")).otherwise(F.col("even"))
    listed = F.array(F.struct(F.lit(1).cast("long").alias("rel"), (own - 1).alias("n")), F.struct(F.lit(2).cast("long").alias("rel"), other.alias("n")))
    return rows.select("id", "label").join(sizes, "label").select(F.col("id").alias("qid"), F.inline(listed)).where("n > 0")


SQL_RELEVANCE = """
    r0 AS (
        SELECT a.id AS qid, b.id AS cid, CASE WHEN a.label = b.label THEN 1 + (a.id + b.id) % 2 ELSE 0 END AS score
        FROM e a JOIN e b ON a.id <> b.id AND (a.label = b.label OR (a.id + b.id) % 97 = 0)),
    qrels AS (SELECT * FROM r0 UNION ALL SELECT qid, cid, 1 FROM r0 WHERE score > 0),
    rel AS (SELECT qid, cid, max(score) AS rel FROM qrels WHERE score > 0 GROUP BY qid, cid)
"""
