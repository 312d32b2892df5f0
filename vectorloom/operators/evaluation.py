"""Items of an evaluation: their keys, their candidates, and rows that are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from vectorloom.functions.tables import new_path, ordinals
from vectorloom.functions.text import filled, short_name
from vectorloom.operators.instructions import has_media


def item_key(text: Column, video: Column, image: Column) -> Column:
    """What makes two candidates the same: the modalities that are there, and their values. ``video`` is a list of frames."""
    frames = F.when(F.size(video) > 0, F.array_join(video, "\x1f"))
    return F.struct(filled(text).alias("text"), frames.alias("video"), filled(image).alias("image"))


def modalities(text: Column, image: Column, video: Column) -> Column:
    """Which of text, image and video an item has, and whether it needs the vision part of a model."""
    t, i, v = has_media(text), has_media(image), F.coalesce(F.size(video) > 0, F.lit(False))
    return F.struct(t.alias("has_text"), i.alias("has_image"), v.alias("has_video"), (i | v).alias("has_vision"))


def distinct_candidates(lists: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """Different candidates and where each query has them, from qid, pos, ``key``.

    First: candidate_id (from 0 as first seen by (qid, pos)), ``key``. Second: qid, pos, candidate_id. The join is on a
    hash of the key, so long texts are shuffled once.
    """
    hashed = lists.withColumn("_h", F.md5(F.to_json(F.struct(key))))
    first = hashed.groupBy("_h").agg(F.min(F.struct("qid", "pos")).alias("_first"), F.first(key).alias(key))
    items = ordinals(first, [F.col("_first")["qid"], F.col("_first")["pos"]], name="candidate_id").select("candidate_id", key, "_h")
    return items.select("candidate_id", key), hashed.select("qid", "pos", "_h").join(items.select("_h", "candidate_id"), "_h").select("qid", "pos", "candidate_id")


def candidate_totals(lists: DataFrame, key: str = "key") -> DataFrame:
    """One row: queries, all candidates, different ones, and candidates a query to one place."""
    return lists.agg(
        F.count_distinct("qid").alias("n_queries"),
        F.count(F.lit(1)).alias("n_total"),
        F.count_distinct(F.md5(F.to_json(F.struct(key)))).alias("n_unique"),
        F.round(F.count(F.lit(1)) / F.count_distinct("qid"), 1).alias("avg_candidates"),
    )


def first_rows(rows: DataFrame, key: str, order: str, frames: str) -> DataFrame:
    """A row for each ``key``, its first by ``order``; without frames it is the placeholder of an empty text."""
    best = rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("_row"))
    return best.select(key, F.col("_row")[frames].alias(frames), F.when(F.coalesce(F.size(F.col("_row")[frames]), F.lit(0)) <= 0, F.lit("")).alias("text"))


def with_candidates(rows: DataFrame, candidates: str = "candidates", positives: str = "n_positive") -> tuple[DataFrame, DataFrame]:
    """Rows that have candidates and a positive among them, and one row with how many don't and how many candidates are left."""
    size = F.coalesce(F.size(candidates), F.lit(0))
    return counted(rows, (size > 0) & (F.coalesce(F.col(positives), F.lit(0)) > 0), n_candidates=size)


def with_frames(rows: DataFrame, frames: str = "frames") -> tuple[DataFrame, DataFrame]:
    """Rows with frames, and one row with how many have none."""
    return counted(rows, F.coalesce(F.size(frames), F.lit(0)) > 0)


def counted(rows: DataFrame, good: Column, **sums: Column) -> tuple[DataFrame, DataFrame]:
    """The good rows, and one row: n_kept, n_skipped, and the sum of each of ``sums`` over the good rows.

    ``rows`` are scanned once: the good ones are written, and the same pass observes the counters. Tasks that run again
    when executors are lost may be observed twice, so the counters are held against the rows that were
    written, and counted anew if they differ.
    """
    good = F.coalesce(good, F.lit(False))
    each = {"n_kept": F.count_if(good), "n_skipped": F.count_if(~good)} | {n: F.coalesce(F.sum(F.when(good, c)), F.lit(0)).cast("long") for n, c in sums.items()}
    named = [c.alias(n) for n, c in each.items()]
    seen, path = Observation(), new_path(rows.sparkSession, "kept")
    rows.observe(seen, *named).where(good).write.parquet(path)
    kept = rows.sparkSession.read.schema(rows.schema).parquet(path)
    counts = seen.get
    if kept.count() != counts["n_kept"]:
        counts = rows.agg(*named).first().asDict()
    schema = ", ".join(f"{n} long" for n in each)
    return kept, rows.sparkSession.createDataFrame([tuple(counts[n] for n in each)], schema)


def with_media(rows: DataFrame, path: str, listing: DataFrame) -> DataFrame:
    """Rows whose file is in ``listing`` (path)."""
    return rows.join(listing.select(F.col("path").alias(path)).distinct(), path, "left_semi")


def known_path(rows: DataFrame, path: str, listing: DataFrame) -> DataFrame:
    """``rows`` with null for a path that isn't in ``listing`` (path)."""
    known = listing.select(F.col("path").alias("_known")).distinct()
    return rows.join(known, F.col(path) == F.col("_known"), "left").withColumn(path, F.col("_known")).drop("_known")


def corpus_image(root: str, parser: Column, name: Column) -> Column:
    """Path of a page's image: by the page's id, or by the short form of its name."""
    return F.concat(F.lit(root.rstrip("/") + "/"), F.when(parser == "visrag", short_name(name)).otherwise(F.concat(name, F.lit(".png"))))


def video_caption(task: Column, row: Column) -> Column:
    """video_id, file, caption of a row of a video retrieval task, whose columns differ.

    ``row``: struct of video_id, video, caption, captions, id, video_path, sentence; null where a task has none.
    """
    base = lambda path: F.regexp_extract(path, r"([^/]*)$", 1)
    stem = lambda path: F.regexp_replace(base(path), r"(?<=.)\.[^.]*$", "")
    first = F.try_element_at(row["captions"], F.lit(1))
    shape = lambda i, f, c: F.struct(i.alias("video_id"), f.alias("file"), c.alias("caption"))
    return (
        F.when(task == "MSR-VTT", shape(row["video_id"], row["video"], row["caption"]))
        .when(task == "MSVD", shape(row["video_id"], row["video"], first))
        .when(task == "DiDeMo", shape(stem(row["video"]), base(row["video"]), row["caption"]))
        .when(task == "YouCook2", shape(row["id"], base(row["video_path"]), row["sentence"]))
        .when(task == "VATEX", shape(row["id"], F.concat(row["id"], F.lit(".mp4")), first))
    )


def full_ranking(scores: DataFrame) -> DataFrame:
    """qid, rank, cid, score: all candidates of each query, best first, ties by the smaller cid."""
    from pyspark.sql.window import Window

    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "cid"))).select("qid", "rank", "cid", "score")


def consensus(steps: DataFrame) -> DataFrame:
    """step, ok (on all workers), oom (on any), has_score (on any) of rows step, worker, ok, oom, has_score."""
    return steps.groupBy("step").agg(F.bool_and("ok").alias("ok"), F.bool_or("oom").alias("oom"), F.bool_or("has_score").alias("has_score"))


def running_mean(steps: DataFrame, epoch: str = "epoch", step: str = "step", value: str = "loss") -> DataFrame:
    """``steps`` with mean: of the values of the epoch up to each step."""
    from pyspark.sql.window import Window

    upto = Window.partitionBy(epoch).orderBy(step).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return steps.withColumn("mean", F.avg(value).over(upto))


def link_questions(questions: DataFrame, contexts: DataFrame, question: str, link: str, order: str) -> DataFrame:
    """question_id, ``question``, ``link``, first, context_id: different questions, numbered as first seen, each with the first context of its link.

    ``questions``: ``question``, ``link``, ``order``; ``contexts``: ``link``, ``order``. A question that comes with several links
    is one for each; one whose link is null or has no context keeps its number and has none. A link's contexts are cut to one
    row before the join, so a common link copies nothing; equal questions are found by 128-bit hashes.
    """
    first_context = contexts.where(F.col(link).isNotNull()).groupBy(link).agg(F.min(order).alias("context_id"))
    hashed = questions.select(link, order, F.struct(F.xxhash64(question).alias("a"), F.xxhash64(F.lit(1), question).alias("b")).alias("_h"), question)
    # the row that is first seen carries its text; the others go in the partial aggregates
    different = hashed.groupBy("_h", link).agg(F.min(order).alias("first"), F.first(question).alias(question))
    return ordinals(different, ["first"], name="question_id").join(first_context, link, "left").select("question_id", question, link, "first", "context_id")
