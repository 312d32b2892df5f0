"""Queries on items, candidates, registries, sources and summaries of evaluations, and on the mining driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.functions import media, text
from vectorloom.functions.tables import new_path
from vectorloom.operators import batching, evaluation, instructions, metrics, mining, registry, reports
from vectorloom.operators.knn import topk
from vectorloom.plans.catalogue import register
from vectorloom.plans.fixtures import SQL_VECTORS, as_corpus, as_queries, load, pairs, vectors
from vectorloom.plans.retrieval import SQL_HITS, _task_scores
from vectorloom.sources import readers, writers


def _none() -> Column:
    return F.lit(None).cast("string")


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """qid, pos, text, image, video: the turns of a conversation are its candidates, every third with an image and every fifth with frames."""
    turns = load(spark, d, "conversations").select(F.col("conv_id").alias("qid"), F.col("turn").cast("long").alias("pos"), "text")
    image = F.when(F.col("pos") % 3 == 0, F.concat(F.lit("i"), (F.col("qid") % 7).cast("string")))
    frames = F.when(F.col("pos") % 5 == 0, F.array(F.lit("f0"), F.concat(F.lit("f"), (F.col("qid") % 3).cast("string")))).otherwise(F.array().cast("array<string>"))
    return turns.select("qid", "pos", F.when(F.col("pos") % 2 == 0, "").otherwise(F.md5(F.coalesce("text", F.lit("")))).alias("text"), image.alias("image"), frames.alias("video"))


SQL_CANDIDATES = """
    k AS (
        SELECT conv_id AS qid, turn::BIGINT AS pos, CASE WHEN turn % 2 = 0 THEN '' ELSE md5(coalesce(text, '')) END AS text,
               CASE WHEN turn % 3 = 0 THEN 'i' || conv_id % 7 END AS image, CASE WHEN turn % 5 = 0 THEN 'f0,f' || conv_id % 3 END AS video FROM conversations)
"""


def candidate_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Candidates by their present modalities, numbered as first seen, and where each query has them."""
    lists = _candidates(spark, d).withColumn("key", evaluation.item_key(F.col("text"), F.col("video"), F.col("image")))
    return evaluation.distinct_candidates(lists)[1]


register(
    "candidate_dedup",
    candidate_dedup,
    f"""WITH {SQL_CANDIDATES}, f AS (SELECT text, image, video, min((qid, pos)) AS first FROM k GROUP BY ALL),
        n AS (SELECT *, row_number() OVER (ORDER BY first) - 1 AS candidate_id FROM f)
        SELECT qid, pos, candidate_id FROM k JOIN n ON n.text = k.text AND n.image IS NOT DISTINCT FROM k.image AND n.video IS NOT DISTINCT FROM k.video""",
)


def candidate_totals(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.candidate_totals(_candidates(spark, d).withColumn("key", evaluation.item_key(F.col("text"), F.col("video"), F.col("image"))))


register(
    "candidate_totals",
    candidate_totals,
    f"""WITH {SQL_CANDIDATES} SELECT count(DISTINCT qid) AS n_queries, count(*) AS n_total, count(DISTINCT (text, image, video)) AS n_unique, round(count(*) / count(DISTINCT qid), 1) AS avg_candidates FROM k""",
)


def modality_flags(spark: SparkSession, d: str) -> DataFrame:
    found = evaluation.modalities(F.col("text"), F.col("image"), F.col("video"))
    return _candidates(spark, d).select(found.alias("m")).select("m.*").groupBy("has_text", "has_image", "has_video", "has_vision").agg(F.count(F.lit(1)).alias("n"))


register(
    "modality_flags",
    modality_flags,
    f"WITH {SQL_CANDIDATES} SELECT text <> '' AS has_text, image IS NOT NULL AS has_image, video IS NOT NULL AS has_video, image IS NOT NULL OR video IS NOT NULL AS has_vision, count(*) AS n FROM k GROUP BY ALL",
)


def first_videos(spark: SparkSession, d: str) -> DataFrame:
    """Videos (conversation modulo 50) by their first row; without frames, the placeholder."""
    rows = _candidates(spark, d).withColumn("video_id", F.col("qid") % 50).withColumn("at", F.col("qid") * 1000 + F.col("pos")).where("pos > 0")
    found = evaluation.first_rows(rows.select("video_id", "at", "video"), "video_id", "at", "video")
    return found.select("video_id", F.array_join("video", ",").alias("frames"), "text")


register(
    "first_videos",
    first_videos,
    f"WITH {SQL_CANDIDATES} SELECT qid % 50 AS video_id, coalesce(arg_min(coalesce(video, ''), qid * 1000 + pos), '') AS frames, CASE WHEN arg_min(coalesce(video, ''), qid * 1000 + pos) = '' THEN '' END AS text FROM k WHERE pos > 0 GROUP BY 1",
)


def skipped_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows without frames; conversations without an answer or with nothing but answers; documents whose page isn't listed."""
    c = _candidates(spark, d)
    lists = load(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list("turn").alias("candidates"), F.count_if(F.col("role") == "assistant").alias("n_positive"))
    docs = load(spark, d, "documents").select((F.col("doc_id") % 400).alias("page_id"))
    pages = load(spark, d, "pages").select(F.col("page_id").alias("path"))
    listed = evaluation.with_media(docs, "page_id", pages).count()
    media_ = docs.agg((F.lit(listed)).cast("long").alias("n_kept"), (F.count(F.lit(1)) - listed).alias("n_skipped"))
    parts = (("frames", evaluation.with_frames(c, "video")[1]), ("candidates", evaluation.with_candidates(lists)[1]), ("media", media_))
    found = [df.select(F.lit(n).alias("kind"), "n_kept", "n_skipped") for n, df in parts]
    return found[0].unionByName(found[1]).unionByName(found[2])


register(
    "skipped_counts",
    skipped_counts,
    f"""WITH {SQL_CANDIDATES}, c AS (SELECT conv_id, count(*) FILTER (WHERE role = 'assistant') AS p FROM conversations GROUP BY conv_id)
        SELECT 'frames' AS kind, count(video) AS n_kept, count(*) - count(video) AS n_skipped FROM k
        UNION ALL SELECT 'candidates', count(*) FILTER (WHERE p > 0), count(*) FILTER (WHERE p = 0) FROM c
        UNION ALL SELECT 'media', count(*) FILTER (WHERE doc_id % 400 IN (SELECT page_id FROM pages)), count(*) FILTER (WHERE doc_id % 400 NOT IN (SELECT page_id FROM pages)) FROM documents""",
)


def observed_counts(spark: SparkSession, d: str) -> DataFrame:
    """Conversations by the number of their answers, those without any left out, and the counters of the same scan."""
    lists = load(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list("turn").alias("candidates"), F.count_if(F.col("role") == "assistant").alias("n_positive"))
    kept, counters = evaluation.with_candidates(lists)
    total = counters.first()  # one row
    average = F.round(F.lit(total["n_candidates"]) / F.lit(total["n_kept"]), 1)
    return kept.groupBy("n_positive").agg(F.count(F.lit(1)).alias("n")).withColumns({"n_kept": F.lit(total["n_kept"]).cast("long"), "n_skipped": F.lit(total["n_skipped"]).cast("long"), "avg_candidates": average})


register(
    "observed_counts",
    observed_counts,
    """WITH c AS (SELECT conv_id, count(turn) AS size, count(*) FILTER (WHERE role = 'assistant') AS n_positive FROM conversations GROUP BY conv_id),
        t AS (SELECT count(*) FILTER (WHERE n_positive > 0) AS n_kept, count(*) FILTER (WHERE n_positive = 0) AS n_skipped, round(sum(size) FILTER (WHERE n_positive > 0) / count(*) FILTER (WHERE n_positive > 0), 1) AS avg_candidates FROM c)
        SELECT n_positive, count(*) AS n, any_value(n_kept) AS n_kept, any_value(n_skipped) AS n_skipped, any_value(avg_candidates) AS avg_candidates FROM c, t WHERE n_positive > 0 GROUP BY n_positive""",
)


def missing_images(spark: SparkSession, d: str) -> DataFrame:
    """Paths under a root that are null where no such file is listed."""
    rows = load(spark, d, "documents").select("doc_id", text.image_path("/data", F.concat(F.lit("images/"), (F.col("doc_id") % 300).cast("string"), F.lit(".jpg"))).alias("path"))
    listing = load(spark, d, "pages").select(F.concat(F.lit("/data/"), F.col("page_id").cast("string"), F.lit(".jpg")).alias("path"))
    return evaluation.known_path(rows, "path", listing).select("doc_id", "path")


register(
    "missing_images",
    missing_images,
    "SELECT doc_id, CASE WHEN doc_id % 300 IN (SELECT page_id FROM pages) THEN '/data/' || doc_id % 300 || '.jpg' END AS path FROM documents",
)


def corpus_images(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 2 == 0, "visrag").otherwise("vidore").alias("parser"), F.concat("url", F.lit(".png")).alias("name"))
    return rows.select("page_id", evaluation.corpus_image("/pages/", F.col("parser"), F.col("name")).alias("path"))


register(
    "corpus_images",
    corpus_images,
    "SELECT page_id, '/pages/' || CASE WHEN page_id % 2 = 0 THEN substring(url, 1, 50) || '_' || substring(md5(url || '.png'), 1, 8) || '.png' ELSE url || '.png.png' END AS path FROM pages",
)


def video_captions(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the five video retrieval tasks, whose columns differ, in one shape."""
    names = F.array(*map(F.lit, registry.VIDEO_TASKS["video_ret"]))
    c = load(spark, d, "conversations").select("conv_id", "turn", F.md5("text").alias("h")).withColumn("task", F.get(names, ((F.col("conv_id") + F.col("turn")) % 5).cast("int")))
    name = F.substring("h", 1, 6)
    path = F.concat(F.lit("a/b."), F.substring("h", 7, 3), F.lit("/"), name, F.lit(".x.mp4"))
    row = F.struct(name.alias("video_id"), path.alias("video"), F.substring("h", 10, 4).alias("caption"), F.array(F.substring("h", 14, 3), F.lit("z")).alias("captions"), name.alias("id"), path.alias("video_path"), F.substring("h", 17, 4).alias("sentence"))
    return c.select("conv_id", "turn", "task", evaluation.video_caption(F.col("task"), row).alias("r")).select("conv_id", "turn", "task", "r.*")


register(
    "video_captions",
    video_captions,
    f"""WITH c AS (SELECT conv_id, turn, md5(text) AS h, {list(registry.VIDEO_TASKS["video_ret"])}[(conv_id + turn) % 5 + 1] AS task FROM conversations),
        x AS (SELECT *, substring(h, 1, 6) AS n, 'a/b.' || substring(h, 7, 3) || '/' || substring(h, 1, 6) || '.x.mp4' AS p FROM c)
        SELECT conv_id, turn, task, CASE task WHEN 'DiDeMo' THEN n || '.x' ELSE n END AS video_id,
               CASE task WHEN 'MSR-VTT' THEN p WHEN 'MSVD' THEN p WHEN 'VATEX' THEN n || '.mp4' ELSE n || '.x.mp4' END AS file,
               CASE task WHEN 'MSR-VTT' THEN substring(h, 10, 4) WHEN 'DiDeMo' THEN substring(h, 10, 4) WHEN 'YouCook2' THEN substring(h, 17, 4) ELSE substring(h, 14, 3) END AS caption FROM x""",
)


def moment_instructions(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("q"), F.col("event_id").cast("string"), F.get(F.array(F.lit(".mp4"), F.lit(".jpg"), F.lit(".txt"), F.lit("")), (F.col("event_id") % 4).cast("int")))
    rows = load(spark, d, "events").select("event_id", F.when(F.col("event_id") % 9 > 0, path).alias("p"))
    return rows.select("event_id", instructions.moment_instruction(F.col("p"), F.lit("plain")).alias("instruction"), media.is_video_input(F.array("p")).alias("is_video"))


register(
    "moment_instructions",
    moment_instructions,
    f"""SELECT event_id, CASE WHEN event_id % 9 > 0 AND event_id % 4 = 0 THEN '{instructions.MOMENT_VIDEO}' WHEN event_id % 9 > 0 AND event_id % 4 = 1 THEN '{instructions.MOMENT_IMAGE}' ELSE 'plain' END AS instruction,
               event_id % 9 > 0 AND event_id % 4 = 1 AS is_video FROM events""",
)


def task_codes(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array(F.lit("sts"), F.lit("retrieval"), F.lit("classification"), F.lit("vqa"), F.lit("STS22"))
    rows = load(spark, d, "events").select(F.get(kinds, (F.col("event_id") % 5).cast("int")).alias("kind"))
    code = instructions.task_code(F.col("kind"))
    return rows.groupBy("kind", code.alias("code"), instructions.task_of_code(code).alias("back"), instructions.encode_batch(F.col("kind"), 64).alias("encode_batch")).agg(F.count(F.lit(1)).alias("n"))


register(
    "task_codes",
    task_codes,
    """WITH x AS (SELECT ['sts', 'retrieval', 'classification', 'vqa', 'STS22'][event_id % 5 + 1] AS kind FROM events)
        SELECT kind, CASE kind WHEN 'sts' THEN 0 WHEN 'classification' THEN 2 ELSE 1 END AS code, CASE kind WHEN 'sts' THEN 'sts' WHEN 'classification' THEN 'classification' ELSE 'retrieval' END AS back,
               CASE kind WHEN 'STS22' THEN 16 ELSE 64 END AS encode_batch, count(*) AS n FROM x GROUP BY ALL""",
)


def _task_events(spark: SparkSession, d: str) -> DataFrame:
    """Events stand for rows of tasks, which they name by the tasks' place in the registry."""
    return load(spark, d, "events").select("event_id", (F.col("event_id") % 90).cast("int").alias("place"))


def task_registry(spark: SparkSession, d: str) -> DataFrame:
    """Rows of tasks by suite, category and way of ranking; those of active tasks and of the short lists are counted apart."""
    joined = registry.with_tasks(_task_events(spark, d), "place")
    return joined.groupBy("suite", "category", "eval_type").agg(
        F.count_distinct("task").alias("n_tasks"), F.count(F.lit(1)).alias("n_rows"), F.count_if("active").alias("n_active"), F.count_if("quick").alias("n_quick")
    )


register(
    "task_registry",
    task_registry,
    """WITH parts AS (SELECT * FROM (VALUES ('image', 'classification', 'local', 0, 9), ('image', 'vqa', 'local', 10, 19), ('image', 'retrieval', 'local', 20, 31), ('image', 'grounding', 'local', 32, 35),
            ('video', 'video_cls', 'global', 36, 39), ('video', 'video_cls', 'local', 40, 40), ('video', 'video_ret', 'global', 41, 45), ('video', 'video_qa', 'local', 46, 50), ('video', 'video_mret', 'local', 51, 53),
            ('document', 'vidore_v1', 'global', 54, 63), ('document', 'vidore_v2', 'global', 64, 70), ('document', 'visrag', 'global', 71, 76), ('document', 'vidoseek', 'global', 77, 80), ('text', NULL, 'global', 81, 89))
            t(suite, category, eval_type, first, last)),
        x AS (SELECT event_id % 90 AS place FROM events)
        SELECT suite, category, eval_type, count(DISTINCT place) AS n_tasks, count(*) AS n_rows, count(*) FILTER (WHERE place NOT IN (65, 67, 69)) AS n_active,
               count(*) FILTER (WHERE place >= 81 OR place IN (8, 10, 20, 33, 36, 41, 46, 51, 54, 72, 77)) AS n_quick
        FROM x JOIN parts ON place BETWEEN first AND last GROUP BY ALL""",
)


def task_selection(spark: SparkSession, d: str) -> DataFrame:
    """Rows of named tasks, of the quick list, of all active ones, and of what is chosen without a word."""
    known = registry.tasks(spark)
    chosen = {
        "named": registry.select(known, "document", names=["VisRAG_PlotQA", "ViDoRe_esg_reports_v2"], quick=True, full=True),
        "quick": registry.select(known, "document", quick=True, full=True),
        "full": registry.select(known, "document", full=True),
        "default": registry.select(known, "video"),
    }
    parts = [df.select(F.lit(k).alias("way"), "place", "task") for k, df in chosen.items()]
    wanted = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    rows = _task_events(spark, d).groupBy("place").agg(F.count(F.lit(1)).alias("n_rows"))  # a row for each task
    return rows.join(F.broadcast(wanted), "place").select("way", "task", "n_rows")


register(
    "task_selection",
    task_selection,
    f"""WITH w AS (SELECT 'named' AS way, unnest(['VisRAG_PlotQA', 'ViDoRe_esg_reports_v2']) AS task, unnest([76, 69]) AS place UNION ALL SELECT 'quick', unnest({list(registry.QUICK["document"])}), unnest([54, 72, 77])
            UNION ALL SELECT 'full', task, place FROM (SELECT unnest({list(registry.DOCUMENT_TASKS)}) AS task, unnest(range(54, 81)) AS place) WHERE NOT (contains(task, '_v2') AND NOT contains(task, 'multilingual') AND NOT contains(task, 'human'))
            UNION ALL SELECT 'default', unnest({list(registry.QUICK["video"])}), unnest([36, 41, 46, 51]))
        SELECT way, task, count(*) AS n_rows FROM events JOIN w ON event_id % 90 = place GROUP BY ALL""",
)


def action_parts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the action benchmark with their folder; rows of unknown parts are counted."""
    names = F.array(F.lit("scene_transition"), F.lit("moving_count"), F.lit("no_such_part"), F.lit("episodic_reasoning"))
    rows = load(spark, d, "events").select("event_id", F.get(names, (F.col("event_id") % 4).cast("int")).alias("subset"), F.concat(F.col("event_id").cast("string"), F.lit(".mp4")).alias("video"))
    known, unknown = registry.with_action_parts(rows)
    found = known.select("event_id", F.concat("video_path", "video").alias("path"), "data_type")
    return found.unionByName(unknown.agg(F.count(F.lit(1)).alias("event_id")).select("event_id", F.lit("skipped").alias("path"), _none().alias("data_type")))


register(
    "action_parts",
    action_parts,
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'scene_qa/video/' WHEN 1 THEN 'clevrer/video_validation/' ELSE 'tvqa/frames_fps3_hq/' END || event_id || '.mp4' AS path, CASE event_id % 4 WHEN 3 THEN 'frame' ELSE 'video' END AS data_type
        FROM events WHERE event_id % 4 <> 2 UNION ALL SELECT count(*), 'skipped', NULL FROM events WHERE event_id % 4 = 2""",
)


def evaluation_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """Each label stands for a task that is ranked among all prototypes, among those of its parity, or fails; one more has no query."""
    e = vectors(spark, d)
    proto = e.groupBy("label").agg(F.min_by("v", "id").alias("v"))
    kind = F.element_at(F.array(*[F.struct(F.lit(c).alias("category"), F.lit(t).alias("eval_type")) for c, t in (("video_ret", "global"), ("video_qa", "local"), ("video_mret", "odd"))]), (F.col("label") % 3 + 1).cast("int"))
    known = proto.select(F.col("label").cast("string").alias("task"), kind.alias("kind")).select("task", "kind.*")
    known = known.unionByName(spark.createDataFrame([("999", "video_cls", "global")], known.schema))

    def overall(task: str) -> DataFrame:
        best = topk(as_queries(e.where(F.col("label") == int(task))), proto.select(F.col("label").cast("long").alias("cid"), "v"), 1)
        return best.select("qid", (F.col("cid") == int(task)).cast("int").alias("hit"))

    def local(task: str) -> DataFrame:
        own = e.where(F.col("label") == int(task))
        scores = topk(as_queries(own), proto.where(F.col("label") % 2 == int(task) % 2).select(F.col("label").cast("long").alias("cid"), "v"), 4)
        return metrics.hit_at_1(scores.select("qid", "cid", "score"), own.select(F.col("id").alias("qid"), F.lit(int(task)).cast("long").alias("gt"))).select("qid", "hit")

    return registry.evaluate(known, {"global": overall, "local": local})


register(
    "evaluation_dispatch",
    evaluation_dispatch,
    f"""WITH {SQL_VECTORS}, proto AS (SELECT label AS cid, arg_min(v, id) AS v FROM e GROUP BY label),
        s AS (SELECT e.id, e.label, cid, list_inner_product(e.v, proto.v) AS score FROM e, proto),
        h AS (SELECT label, (cid = label)::INT AS hit FROM s WHERE label % 3 = 0 OR label % 3 = 1 AND cid % 2 = label % 2 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, cid) = 1)
        SELECT label::VARCHAR AS task, CASE label % 3 WHEN 0 THEN 'video_ret' ELSE 'video_qa' END AS category, round(100 * avg(hit), 2) AS hit_at_1, count(*) AS n, NULL AS error FROM h GROUP BY label
        UNION ALL SELECT DISTINCT label::VARCHAR, 'video_mret', NULL::DOUBLE, 0, 'Unknown category: video_mret' FROM e WHERE label % 3 = 2 UNION ALL SELECT '999', 'video_cls', NULL, 0, 'No valid examples'""",
)


def _results(spark: SparkSession, d: str) -> DataFrame:
    """task, category, hit_at_1, ndcg_at_5, recall_at_5, error: labels as tasks; the last has failed.

    Scores are divided by numbers that leave no halves of a cent, which systems round one way or the other.
    """
    tasks = _task_scores(spark, d).groupBy(F.col("task").cast("string").alias("task"), F.col("category").cast("string").alias("category")).agg((100 * F.avg("hit")).alias("s"))
    bad = F.col("task") == "9"
    score = lambda by: F.when(~bad, F.round(F.col("s") / by, 6))
    return tasks.select("task", "category", score(1.1).alias("hit_at_1"), score(3.0).alias("ndcg_at_5"), score(7.0).alias("recall_at_5"), F.when(bad, "gone").alias("error"))


SQL_RESULTS = f"""{SQL_HITS}, r AS (
    SELECT task::VARCHAR AS task, category::VARCHAR AS category, CASE WHEN task <> 9 THEN round(100 * avg(hit) / 1.1, 6) END AS hit_at_1, CASE WHEN task <> 9 THEN round(100 * avg(hit) / 3.0, 6) END AS ndcg_at_5,
           CASE WHEN task <> 9 THEN round(100 * avg(hit) / 7.0, 6) END AS recall_at_5, CASE WHEN task = 9 THEN 'gone' END AS error FROM h GROUP BY task, category)"""


def _flat(df: DataFrame, *names: str) -> DataFrame:
    """A summary with its map as text, a line for each category."""
    entries = F.array_sort(F.map_entries("per_category"))
    lines = F.transform(entries, lambda x: F.concat_ws(" ", x["key"], *[F.format_string("%.2f", x["value"][n]) for n in names], x["value"]["num_tasks"].cast("string")))
    return df.withColumn("per_category", F.array_join(lines, "\n"))


def image_summary(spark: SparkSession, d: str) -> DataFrame:
    return _flat(reports.summary(_results(spark, d).drop("ndcg_at_5", "recall_at_5")), "mean_hit_at_1").withColumn("tasks", F.size("tasks"))


register(
    "image_summary",
    image_summary,
    f"""WITH {SQL_RESULTS}, c AS (SELECT category, round(avg(hit_at_1), 2) AS m, count(*) AS n FROM r WHERE hit_at_1 IS NOT NULL GROUP BY category)
        SELECT count(*) AS num_tasks_completed, count(hit_at_1) AS num_tasks, round(avg(hit_at_1), 2) AS mean_hit_at_1, count(*)::INT AS tasks,
               (SELECT string_agg(category || ' ' || printf('%.2f', m) || ' ' || n, chr(10) ORDER BY category) FROM c) AS per_category FROM r""",
)


def document_summary(spark: SparkSession, d: str) -> DataFrame:
    found = reports.summary(_results(spark, d), ("hit_at_1", "ndcg_at_5", "recall_at_5"), ("hit_at_1", "ndcg_at_5"))
    return _flat(found, "mean_hit_at_1", "mean_ndcg_at_5").drop("tasks", "num_tasks_completed")


register(
    "document_summary",
    document_summary,
    f"""WITH {SQL_RESULTS}, c AS (SELECT category, round(avg(hit_at_1), 2) AS m, round(avg(ndcg_at_5), 2) AS m2, count(*) AS n FROM r WHERE hit_at_1 IS NOT NULL GROUP BY category)
        SELECT count(hit_at_1) AS num_tasks, round(avg(hit_at_1), 2) AS mean_hit_at_1, round(avg(ndcg_at_5), 2) AS mean_ndcg_at_5, round(avg(recall_at_5), 2) AS mean_recall_at_5,
               (SELECT string_agg(category || ' ' || printf('%.2f', m) || ' ' || printf('%.2f', m2) || ' ' || n, chr(10) ORDER BY category) FROM c) AS per_category FROM r""",
)


def text_summary(spark: SparkSession, d: str) -> DataFrame:
    scores = _task_scores(spark, d).groupBy(F.col("type").cast("string").alias("type"), F.col("task").cast("string").alias("task"), "subset").agg(F.avg("hit").alias("score"))
    found = reports.text_summary(scores)
    kinds = F.transform(F.array_sort(F.map_entries("per_type")), lambda x: F.concat_ws(" ", x["key"], F.format_string("%.6f", x["value"])))
    tasks = F.transform(F.array_sort(F.map_entries("per_task")), lambda x: F.concat_ws(" ", x["key"], x["value"]["type"], F.format_string("%.6f", x["value"]["score"]), x["value"]["num_subsets"].cast("string")))
    return found.withColumns({"per_type": F.array_join(kinds, "\n"), "per_task": F.array_join(tasks, "\n")})


register(
    "text_summary",
    text_summary,
    f"""WITH {SQL_HITS}, s AS (SELECT type::VARCHAR AS type, task::VARCHAR AS task, subset, avg(hit) AS score FROM h GROUP BY ALL),
        t AS (SELECT task, min(type) AS type, 100 * avg(score) AS score, count(*) AS n FROM s GROUP BY task), k AS (SELECT type, 100 * avg(score) AS score FROM s GROUP BY type)
        SELECT (SELECT count(*) FROM t) AS num_tasks, round(100 * avg(score), 6) AS mean_task, (SELECT round(avg(score), 6) FROM k) AS mean_type,
               (SELECT string_agg(type || ' ' || printf('%.6f', round(score, 6)), chr(10) ORDER BY type) FROM k) AS per_type,
               (SELECT string_agg(task || ' ' || type || ' ' || printf('%.6f', round(score, 6)) || ' ' || n, chr(10) ORDER BY task) FROM t) AS per_task FROM s""",
)


def plain_batches(spark: SparkSession, d: str) -> DataFrame:
    return batching.plain_shuffle(load(spark, d, "events"), "event_id", 32, ranks=3)


register(
    "plain_batches",
    plain_batches,
    """WITH o AS (SELECT event_id, row_number() OVER (ORDER BY md5(event_id || '_42'), event_id) - 1 AS k, count(*) OVER () // 96 * 96 AS whole FROM events)
        SELECT event_id, (k % 3)::INT AS rank, (k // 3 // 32)::INT AS batch, (k // 3 % 32)::INT AS slot FROM o WHERE k < whole""",
)


def gathered_batches(spark: SparkSession, d: str) -> DataFrame:
    """Places in the batch of all ranks, of rows that the ranks have unevenly."""
    rows = load(spark, d, "events").select("event_id", F.floor(F.col("event_id") / 50).alias("batch"), (F.col("event_id") % 50).alias("at"))
    rows = rows.withColumn("rank", F.when(F.col("at") < 7, 0).when(F.col("at") < 30, 1).otherwise(2)).withColumn("slot", F.col("at") - F.when(F.col("at") < 7, 0).when(F.col("at") < 30, 7).otherwise(30))
    return batching.gather(rows).select("event_id", "rank", "global_slot")


register("gathered_batches", gathered_batches, "SELECT event_id, CASE WHEN event_id % 50 < 7 THEN 0 WHEN event_id % 50 < 30 THEN 1 ELSE 2 END AS rank, event_id % 50 AS global_slot FROM events")


def worker_consensus(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").select(F.floor(F.col("event_id") / 4).alias("step"), (F.col("event_id") % 4).alias("worker"), "event_id")
    return evaluation.consensus(e.select("step", "worker", (F.col("event_id") % 7 > 0).alias("ok"), (F.col("event_id") % 11 == 0).alias("oom"), (F.col("event_id") % 5 == 0).alias("has_score")))


register("worker_consensus", worker_consensus, "SELECT event_id // 4 AS step, bool_and(event_id % 7 > 0) AS ok, bool_or(event_id % 11 = 0) AS oom, bool_or(event_id % 5 = 0) AS has_score FROM events GROUP BY 1")


def loss_running_mean(spark: SparkSession, d: str) -> DataFrame:
    steps = load(spark, d, "events").select(F.floor(F.col("event_id") / 100).alias("epoch"), (F.col("event_id") % 100).alias("step"), (F.col("event_id") * 7 % 13).cast("double").alias("loss"))
    return evaluation.running_mean(steps).select("epoch", "step", F.round("mean", 6).alias("mean"))


register("loss_running_mean", loss_running_mean, "SELECT event_id // 100 AS epoch, event_id % 100 AS step, round(avg((event_id * 7 % 13)::DOUBLE) OVER (PARTITION BY event_id // 100 ORDER BY event_id % 100), 6) AS mean FROM events")


def full_ranking(spark: SparkSession, d: str) -> DataFrame:
    """All ten prototypes of every vector, best first."""
    e = vectors(spark, d)
    proto = e.groupBy("label").agg(F.min_by("v", "id").alias("v")).select(F.col("label").cast("long").alias("cid"), "v")
    scores = topk(as_queries(e), proto, 1 << 20)
    return evaluation.full_ranking(scores.select("qid", "cid", F.round("score", 6).alias("score")))


register(
    "full_ranking",
    full_ranking,
    f"""WITH {SQL_VECTORS}, proto AS (SELECT label AS cid, arg_min(v, id) AS v FROM e GROUP BY label), s AS (SELECT e.id AS qid, cid::BIGINT AS cid, round(list_inner_product(e.v, proto.v), 6) AS score FROM e, proto)
        SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, cid)::INT AS rank, cid, score FROM s""",
)


def corpus_link(spark: SparkSession, d: str) -> DataFrame:
    """The number of every document's item in the corpus of different ones."""
    docs = load(spark, d, "documents").select("doc_id", "text")
    return mining.link_corpus(docs, mining.dedup_corpus(docs, "text", None, "doc_id"), "text", None).select("doc_id", "corpus_id")


register(
    "corpus_link",
    corpus_link,
    r"""WITH k AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '^\s+', ''), '\s+$', '') AS key FROM documents), f AS (SELECT key, min(doc_id) AS first FROM k GROUP BY key),
        n AS (SELECT key, row_number() OVER (ORDER BY first) - 1 AS corpus_id FROM f) SELECT doc_id, corpus_id FROM k JOIN n ON n.key = k.key""",
)


def _label_source(spark: SparkSession, d: str, label: int):
    def make() -> tuple[DataFrame, DataFrame]:
        e = vectors(spark, d)
        own = e.where(F.col("label") == label)
        return pairs(own), as_corpus(own)

    return make


def mining_driver(spark: SparkSession, d: str) -> DataFrame:
    """Every label as a source, one of which is there already; one source has no rows, one can't be read, one isn't known."""

    def broken() -> tuple[DataFrame, DataFrame]:
        raise OSError("can't be read")

    labels = sorted(r["label"] for r in vectors(spark, d).select("label").distinct().collect())  # a row for each source
    sources = {f"label_{k}": _label_source(spark, d, k) for k in labels} | {"broken": broken, "none": _label_source(spark, d, -1)}
    folder = new_path(spark, "mined")
    wanted = ["label_0", "broken", "none", "unknown", "label_0", *(f"label_{k}" for k in labels)]
    done = lambda path: writers.exists(spark, path)
    write = lambda df, path: df.write.parquet(path)
    mining.mine_sources(spark, sources, ["label_2"], folder, done, write)
    return mining.mine_sources(spark, sources, wanted, folder, done, write)


register(
    "mining_driver",
    mining_driver,
    f"""WITH {SQL_VECTORS},
        s AS (SELECT a.id AS qid, b.id AS cid, a.label, list_inner_product(a.v, b.v) AS score FROM e a JOIN e b ON a.label = b.label AND a.id <> b.id),
        t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, cid) AS rk FROM s),
        f AS (SELECT *, coalesce(lead(id) OVER (PARTITION BY label ORDER BY id), min(id) OVER (PARTITION BY label)) AS following FROM e),
        p AS (SELECT id AS qid, CASE WHEN id % 2 = 0 THEN cid ELSE following END AS pid FROM f LEFT JOIN t ON qid = id AND rk = 1),
        c AS (SELECT t.qid, t.label FROM t JOIN p ON p.qid = t.qid JOIN s x ON x.qid = t.qid AND x.cid = pid WHERE t.rk <= 50 AND t.cid <> pid AND t.score <= x.score + 0.1),
        n AS (SELECT label, qid, least(15, count(*)) AS n FROM c GROUP BY ALL)
        SELECT 'label_' || label AS source, CASE WHEN label = 2 THEN 'exists' ELSE 'mined' END AS status, CASE WHEN label <> 2 THEN count(*) END AS n_rows,
               CASE WHEN label <> 2 THEN round((SELECT sum(n) FROM n WHERE n.label = e.label) / count(*), 6) END AS avg_negatives, NULL AS error FROM e GROUP BY label
        UNION ALL SELECT 'none', 'empty', 0, NULL, NULL UNION ALL SELECT 'broken', 'failed', NULL, NULL, 'can''t be read' UNION ALL SELECT 'unknown', 'unknown', NULL, NULL, NULL""",
)


def mining_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals of a summary with a line for each label."""
    lines = vectors(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"))
    return mining.mining_totals(lines.select(F.when(F.col("label") % 3 > 0, "mined").otherwise("empty").alias("status"), F.when(F.col("label") % 3 > 0, F.col("n_rows")).alias("n_rows"), F.when(F.col("label") % 3 > 0, F.col("label") / 2).alias("avg_negatives")))


register(
    "mining_totals",
    mining_totals,
    "WITH l AS (SELECT label, count(*) AS n FROM embeddings WHERE label % 3 > 0 GROUP BY label) SELECT count(*) AS n_sources, sum(n)::BIGINT AS n_rows, round(sum(label / 2 * n) / sum(n), 6) AS avg_negatives FROM l",
)


def next_run(spark: SparkSession, d: str) -> DataFrame:
    return reports.next_run(load(spark, d, "labels").select((F.col("doc_id") % 41).alias("run")))


register("next_run", next_run, "SELECT max(doc_id % 41) + 1 AS run FROM labels")


def sentence_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "documents").select(F.col("lang").alias("sentence1"), F.col("source").alias("sentence2"), (F.col("doc_id") % 6).alias("score"), "doc_id")
    found = readers.sentence_pairs(rows, "pairs")
    return found.groupBy(F.col("query.text").alias("query"), F.col("positive.text").alias("positive"), "task_type", F.size("negatives").alias("n_negatives")).agg(F.round(F.sum("score"), 6).alias("score"), F.count(F.lit(1)).alias("n"))


register("sentence_pairs", sentence_pairs, "SELECT lang AS query, source AS positive, 'sts' AS task_type, 0 AS n_negatives, sum(doc_id % 6)::DOUBLE AS score, count(*) AS n FROM documents GROUP BY lang, source")


def benchmark_rows(spark: SparkSession, d: str) -> DataFrame:
    hole = text.PLACEHOLDER
    rows = load(spark, d, "documents").select(
        F.concat(F.lit(f"{hole}\n"), F.col("source")).alias("qry"), F.when(F.col("doc_id") % 2 == 0, F.lit("images/q.jpg")).alias("qry_image_path"),
        F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")).alias("pos_text"), F.when(F.col("doc_id") % 3 == 0, F.lit("p.jpg")).alias("pos_image_path"), F.lit('["x", " "]').alias("neg_text"),
    )
    found = readers.benchmark_rows(rows, "OK-VQA", "/root/").select("query", "positive", F.array_join("negatives", "|").alias("negatives"), "task_type")
    return found.groupBy(F.col("query.text").alias("q"), F.col("query.image_path").alias("qi"), F.col("positive.text").alias("p"), F.col("positive.image_path").alias("pi"), "negatives", "task_type").agg(F.count(F.lit(1)).alias("n"))


register(
    "benchmark_rows",
    benchmark_rows,
    """SELECT source AS q, CASE WHEN doc_id % 2 = 0 THEN '/root/q.jpg' END AS qi, CASE WHEN doc_id % 3 > 0 THEN lang END AS p, CASE WHEN doc_id % 3 = 0 THEN '/root/p.jpg' END AS pi, 'x' AS negatives, 'vqa' AS task_type, count(*) AS n
        FROM documents GROUP BY ALL""",
)


def video_triplets(spark: SparkSession, d: str) -> DataFrame:
    """Rows with a path, which is a folder of listed frames, a file, or nothing."""
    rows = load(spark, d, "conversations").select("conv_id", F.col("role").alias("query_text"), _none().alias("positive_text"), F.when(F.col("conv_id") % 3 < 2, F.concat(F.lit("v/"), (F.col("conv_id") % 5).cast("string"))).otherwise("").alias("video_path"))
    files = spark.createDataFrame([("file:/root/v/0/f10.jpg",), ("file:/root/v/0/f2.JPG",), ("file:/root/v/0/notes.txt",), ("file:/root/v/3/a.png",)], "path string")
    found = readers.video_triplets(rows, files, "/root", "clips")
    return found.select(F.col("query.text").alias("query"), F.array_join("frames", ",").alias("frames"), "file", "task_type").groupBy("query", "frames", "file", "task_type").agg(F.count(F.lit(1)).alias("n"))


register(
    "video_triplets",
    video_triplets,
    """WITH x AS (SELECT role AS query, CASE WHEN conv_id % 3 < 2 THEN conv_id % 5 END AS k FROM conversations)
        SELECT query, CASE k WHEN 0 THEN '/root/v/0/f10.jpg,/root/v/0/f2.JPG' WHEN 3 THEN '/root/v/3/a.png' END AS frames, CASE WHEN k IN (1, 2, 4) THEN '/root/v/' || k END AS file, 'retrieval' AS task_type, count(*) AS n FROM x GROUP BY ALL""",
)


def mined_file_names(spark: SparkSession, d: str) -> DataFrame:
    """Documents stand for files by their source and length: some have the prefix, some are empty, no lines of JSON, or class labels."""
    kind = F.col("doc_id") % 5
    stem = F.when(kind == 0, F.concat(F.lit("mmeb_"), "source", F.lit("_"), "doc_id")).when(kind == 1, "classification_hn").otherwise(F.concat("source", F.lit("_"), "doc_id"))
    path = F.concat(F.lit("/m/"), F.col("doc_id").cast("string"), F.lit("/"), stem, F.when(kind == 2, ".md").otherwise(".jsonl"))
    return readers.mined_files(load(spark, d, "documents").select(path.alias("path"), F.when(kind == 3, 0).otherwise(F.col("n_chars")).cast("long").alias("length")))


register(
    "mined_file_names",
    mined_file_names,
    """SELECT CASE WHEN doc_id % 5 = 1 THEN 'classification_hn' ELSE source || '_' || doc_id END AS name,
               '/m/' || doc_id || '/' || CASE doc_id % 5 WHEN 0 THEN 'mmeb_' || source || '_' || doc_id WHEN 1 THEN 'classification_hn' ELSE source || '_' || doc_id END || '.jsonl' AS path, doc_id % 5 = 1 AS is_classes
        FROM documents WHERE doc_id % 5 IN (0, 1, 4) AND n_chars > 0 AND (doc_id % 5 = 1 OR source IS NOT NULL)""",
)


def subset_concat(spark: SparkSession, d: str) -> DataFrame:
    """Parts of a benchmark as one table with the constant column subset; a part that can't be read is left out."""
    docs = load(spark, d, "documents")

    def part(lang: str):
        return lambda: docs.where(F.col("lang") == lang).select("doc_id")

    def gone() -> DataFrame:
        raise OSError("gone")

    return readers.concat_subsets({"en": part("en"), "fr": part("fr"), "xx": gone}).select("doc_id", "subset")


register("subset_concat", subset_concat, "SELECT doc_id, lang AS subset FROM documents WHERE lang IN ('en', 'fr')")


def bounded_scan(spark: SparkSession, d: str) -> DataFrame:
    """The first 40 rows that a transformation keeps, in the order of ids."""
    docs = load(spark, d, "documents")
    return readers.bounded(docs, "doc_id", lambda x: x.where(F.col("lang") == "fr").select("doc_id", F.upper("source").alias("name")), 40)


register("bounded_scan", bounded_scan, "SELECT doc_id, upper(source) AS name FROM documents WHERE lang = 'fr' ORDER BY doc_id LIMIT 40")


def corpus_ids(spark: SparkSession, d: str) -> DataFrame:
    """Only the ids of a corpus, as texts; the scan reads one column."""
    return readers.corpus_ids(spark, f"{d}/pages.parquet", "page_id")


register("corpus_ids", corpus_ids, "SELECT page_id::VARCHAR AS cid FROM pages")


def label_map(spark: SparkSession, d: str) -> DataFrame:
    """Rows with the text of their label from a side table; a label that it lacks is kept as it is."""
    names = spark.createDataFrame([(str(k), f"class {k}") for k in range(7)], "label string, name string")
    e = load(spark, d, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"))
    return readers.with_label_names(e, names).select("vec_id", "name")


register("label_map", label_map, "SELECT vec_id, CASE WHEN label < 7 THEN 'class ' || label ELSE label::VARCHAR END AS name FROM embeddings")


def paper_losses(spark: SparkSession, d: str) -> DataFrame:
    """The weighted sum with a language model's loss, and both losses of a reranker, by batch."""
    from vectorloom.operators import losses

    e = load(spark, d, "events").select(F.floor(F.col("event_id") / 64).alias("batch"), "event_id")
    rows = e.select("batch", ((F.col("event_id") * 7 % 13) / 5.0 - 1).alias("yes"), ((F.col("event_id") * 3 % 11) / 5.0 - 1).alias("no"), (F.col("event_id") % 3 == 0).cast("int").alias("label"), ((F.col("event_id") * 5 % 17) / 17.0).alias("teacher"))
    a, b = losses.reranker_ce(rows).withColumnRenamed("loss", "ce"), losses.reranker_distill(rows).withColumnRenamed("loss", "kd")
    both = losses.weighted_sum(a.select("batch", F.col("ce").alias("loss")), b.select("batch", F.col("kd").alias("loss")), 0.25).withColumnRenamed("loss", "both")
    found = a.join(b, "batch").join(both, "batch")
    return found.select("batch", *[F.round(c, 6).alias(c) for c in ("ce", "kd", "both")])


register(
    "paper_losses",
    paper_losses,
    """WITH r AS (SELECT event_id // 64 AS batch, (event_id * 7 % 13) / 5.0 - ((event_id * 3 % 11) / 5.0) AS z, event_id % 3 = 0 AS y, (event_id * 5 % 17) / 17.0 AS t FROM events),
        p AS (SELECT *, 1 / (1 + exp(-z)) AS p FROM r),
        l AS (SELECT batch, avg(-ln(CASE WHEN y THEN p ELSE 1 - p END)) AS ce, avg(-(t * ln(p) + (1 - t) * ln(1 - p))) AS kd FROM p GROUP BY batch)
        SELECT batch, round(ce, 6) AS ce, round(kd, 6) AS kd, round(ce + 0.25 * kd, 6) AS both FROM l""",
)


def half_precision(spark: SparkSession, d: str) -> DataFrame:
    """Vectors stored in two bytes a component and read again."""
    from vectorloom.functions.vectors import from_half, to_half

    e = load(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<float>").alias("v"))
    read = e.select("vec_id", F.octet_length(to_half("v")).alias("bytes"), from_half(to_half("v")).alias("h"), "v")
    error = F.aggregate(F.zip_with("v", "h", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: F.greatest(s, x.cast("double")))
    return read.select("vec_id", "bytes", (error <= 0.0005).alias("close"))


register("half_precision", half_precision, "SELECT vec_id, (2 * len(embedding))::INT AS bytes, true AS close FROM embeddings")


def model_input(spark: SparkSession, d: str) -> DataFrame:
    """The parts of every candidate as a model takes them: videos, then images, then texts."""
    c = _candidates(spark, d)
    parts = media.content(F.when(F.size("video") > 0, F.array_join("video", ",")), F.col("image"), text.filled(F.col("text")))
    return c.select("qid", "pos", F.array_join(F.transform(parts, lambda x: F.concat_ws("=", x["type"], x["value"])), ";").alias("content"))


register(
    "model_input",
    model_input,
    f"WITH {SQL_CANDIDATES} SELECT qid, pos, concat_ws(';', 'video=' || video, 'image=' || image, 'text=' || nullif(text, '')) AS content FROM k",
)
