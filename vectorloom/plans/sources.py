"""Queries that write a table in a source's own form and read it again, and on what is left of the readers' rules."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectorloom.functions import text
from vectorloom.functions.tables import new_path, ordinals
from vectorloom.functions.vectors import last_token, norm
from vectorloom.operators import batching, mining
from vectorloom.plans.catalogue import register
from vectorloom.plans.fixtures import as_corpus, load, pairs, vectors
from vectorloom.plans.retrieval import SQL_MINED
from vectorloom.sources import arrows, halves, hub, readers, teacher, writers


def _none() -> Column:
    return F.lit(None).cast("string")


def json_lines(spark: SparkSession, d: str) -> DataFrame:
    """Documents as lines of JSON, read with a declared schema: the first 300 by id, with nulls and all characters."""
    path = new_path(spark, "lines")
    writers.jsonl(load(spark, d, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("lang")), path)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())])
    return readers.jsonl(spark, path, schema, "doc_id", 300).select("doc_id", F.md5("text").alias("text_md5"), "lang")


register("json_lines", json_lines, "SELECT doc_id, md5(text) AS text_md5, CASE WHEN doc_id % 2 = 0 THEN lang END AS lang FROM documents ORDER BY doc_id LIMIT 300")


def mined_lines(spark: SparkSession, d: str) -> DataFrame:
    """Mined negatives as lines of JSON, read as training rows with at most five negatives each."""
    e = vectors(spark, d)
    own = pairs(e)
    names = e.select(F.col("id").alias("cid"), text.item(F.concat(F.lit("t"), F.col("id").cast("string")), _none()).alias("side"))
    both = own.join(names.select(F.col("cid").alias("qid"), F.col("side").alias("query")), "qid").join(names.select(F.col("cid").alias("positive_id"), F.col("side").alias("positive")), "positive_id")
    path = new_path(spark, "mined")
    writers.jsonl(writers.mined(mining.mine(own, as_corpus(e)), names, both, "retrieval", "vectors"), path)
    found = readers.mined_rows(spark, path, "file", most=5)
    return found.select(F.col("query.text").alias("query"), F.col("positive.text").alias("positive"), F.array_join("negatives", ",").alias("negatives"), "task_type", "subset_name")


register(
    "mined_lines",
    mined_lines,
    f"""WITH {SQL_MINED}, n AS (SELECT qid, string_agg('t' || cid, ',' ORDER BY pos_in_list) AS negatives FROM m WHERE pos_in_list <= 5 GROUP BY qid)
        SELECT 't' || pairs.qid AS query, 't' || pid AS positive, coalesce(negatives, '') AS negatives, 'retrieval' AS task_type, 'vectors' AS subset_name FROM pairs LEFT JOIN n ON n.qid = pairs.qid""",
)


def image_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "documents").select(
        F.concat(F.lit("images/"), (F.col("doc_id") % 9).cast("string"), F.lit(".jpg")).alias("q_img"),
        F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("t"), (F.col("doc_id") % 5).cast("string"))).alias("t_img"),
        F.when(F.col("doc_id") % 4 > 0, F.array("lang", "source")).otherwise(F.array().cast("array<string>")).alias("q_texts"),
    )
    found = readers.image_pairs(rows, "pairs", "/m")
    return found.groupBy(F.col("query.text").alias("t"), F.col("query.image_path").alias("q"), F.col("positive.image_path").alias("p"), "task_type").agg(F.count(F.lit(1)).alias("n"))


register(
    "image_pairs",
    image_pairs,
    """SELECT CASE WHEN doc_id % 4 > 0 THEN lang END AS t, '/m/' || doc_id % 9 || '.jpg' AS q, CASE WHEN doc_id % 3 = 0 THEN '/m/' || doc_id % 9 || '.jpg' ELSE '/m/t' || doc_id % 5 END AS p, 'retrieval' AS task_type, count(*) AS n
        FROM documents GROUP BY ALL""",
)


def document_pages(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 5 > 0, F.col("source")).otherwise("").alias("query"), F.when(F.col("doc_id") % 2 == 0, F.lit("page.png")).alias("image_filename"))
    found = readers.document_pages(rows, "pages", "doc_id")
    return found.select(F.col("query.text").alias("query"), F.col("positive.image_path").alias("page"), "subset_name")


register(
    "document_pages",
    document_pages,
    "SELECT source AS query, CASE WHEN doc_id % 2 = 0 THEN 'page.png' ELSE 'pages_' || doc_id END AS page, 'pages' AS subset_name FROM documents WHERE doc_id % 5 > 0 AND source <> ''",
)


def retrieval_files(spark: SparkSession, d: str) -> DataFrame:
    """Queries, corpus and relevance in three files; only queries in one language are taken, and relevance of all."""
    docs, labels, folder = load(spark, d, "documents"), load(spark, d, "labels"), new_path(spark, "triple")
    docs.select(F.col("doc_id").alias("query-id"), F.col("lang").alias("language"), F.col("source").alias("query")).write.parquet(f"{folder}/q")
    docs.select(F.col("doc_id").alias("corpus-id"), F.col("n_chars").alias("size")).write.parquet(f"{folder}/c")
    labels.select(F.col("doc_id").alias("query-id"), (F.col("doc_id") + 1).alias("corpus-id"), F.col("quality").alias("score")).write.parquet(f"{folder}/r")
    q, c, r = readers.retrieval_triple(spark, f"{folder}/q", f"{folder}/c", f"{folder}/r", "fr")
    return q.join(r, "qid").join(c, "cid", "left").select("qid", "query", "cid", "score", "size")


register(
    "retrieval_files",
    retrieval_files,
    """SELECT d.doc_id::VARCHAR AS qid, d.source AS query, (d.doc_id + 1)::VARCHAR AS cid, quality::INT AS score, c.n_chars AS size
        FROM documents d JOIN labels USING (doc_id) LEFT JOIN documents c ON c.doc_id = d.doc_id + 1 WHERE d.lang = 'fr'""",
)


def _length_model():
    """Stands for a model: an item's vector is its length and 1."""
    return lambda items: np.array([[len(x), 1.0] for x in items])


def teacher_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of the rows of three kinds of sources, stored, and joined to the rows again; one source can't be read."""
    docs = load(spark, d, "documents")

    def texts() -> tuple[DataFrame, str]:
        rows = docs.select("doc_id", F.col("text").alias("query"), F.col("source").alias("positive"), F.lit("x").alias("negative"))
        return readers.text_triplets(rows, "texts").withColumn("at", F.monotonically_increasing_id()), "at"

    def pages() -> tuple[DataFrame, str]:
        rows = docs.select("doc_id", F.col("source").alias("query"), _none().alias("image_filename"))
        return readers.document_pages(rows, "pages", "doc_id").withColumn("at", F.monotonically_increasing_id()), "at"

    def scored() -> tuple[DataFrame, str]:
        rows = docs.select(F.col("lang").alias("sentence1"), F.col("lang").alias("sentence2"), F.lit(1).alias("score"))
        return readers.sentence_pairs(rows, "scored").withColumn("at", F.monotonically_increasing_id()), "at"

    def gone() -> tuple[DataFrame, str]:
        raise OSError("gone")

    folder = new_path(spark, "teacher")
    report = teacher.store_vectors(spark, {"texts": texts, "pages": pages, "scored": scored, "gone": gone}, folder, _length_model)
    found = teacher.stored_vectors(spark, folder, ["texts", "pages", "scored"])
    checked = found.groupBy("subset").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.abs(norm(F.col("q")) - 1) < 1e-6) & (F.abs(norm(F.col("p")) - 1) < 1e-6)).alias("n_unit"))
    return report.join(checked, "subset", "left").select("subset", "status", "n_rows", "n", "n_unit", "error")


register(
    "teacher_vectors",
    teacher_vectors,
    """WITH n AS (SELECT count(*) FILTER (WHERE text <> '' AND source <> '') AS texts, count(*) FILTER (WHERE source <> '') AS pages, count(*) AS scored FROM documents),
        s AS (SELECT 'texts' AS subset, texts AS k FROM n UNION ALL SELECT 'pages', pages FROM n UNION ALL SELECT 'scored', scored FROM n)
        SELECT subset, 'stored' AS status, k AS n_rows, k AS n, k AS n_unit, NULL AS error FROM s UNION ALL SELECT 'gone', 'failed', NULL, NULL, NULL, 'gone'""",
)


def model_fields(spark: SparkSession, d: str) -> DataFrame:
    """Kind of a model by its config or path, lists in options, and the last token of a mask."""
    rows = load(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, "given").otherwise("").alias("config"), F.when(F.col("event_id") % 2 == 0, "/m/Some-VL-2B").otherwise("/m/plain").alias("path"))
    mask = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: (i < F.col("event_id") % 7).cast("int"))
    return rows.select(
        "event_id", text.model_kind(F.col("config"), F.col("path")).alias("kind"), F.size(text.comma_list(F.concat(F.col("config"), F.lit(", a,, b ")))).alias("n_options"), last_token(mask).alias("last"),
    )


register(
    "model_fields",
    model_fields,
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'given' WHEN event_id % 2 = 0 THEN 'vision-language' ELSE 'text' END AS kind, CASE WHEN event_id % 3 = 0 THEN 3 ELSE 2 END AS n_options,
               CASE WHEN event_id % 7 > 0 THEN (event_id % 7 - 1)::INT END AS last FROM events""",
)


def resumed_batches(spark: SparkSession, d: str) -> DataFrame:
    """Batches from the third on, and the steps of two epochs with every fourth batch an update."""
    rows = load(spark, d, "events").select("event_id", F.floor(F.col("event_id") / 64).cast("int").alias("batch"))
    total, warm = batching.steps(rows.count(), 64, 4, 2, 0.1)
    return batching.resume(rows, 3).groupBy("batch").agg(F.count(F.lit(1)).alias("n")).withColumns({"total_steps": F.lit(total).cast("long"), "warmup_steps": F.lit(warm).cast("long")})


register(
    "resumed_batches",
    resumed_batches,
    """WITH s AS (SELECT count(*) // 64 // 4 * 2 AS total FROM events)
        SELECT (event_id // 64)::INT AS batch, count(*) AS n, any_value(total) AS total_steps, any_value(floor(total * 0.1)::BIGINT) AS warmup_steps FROM events, s WHERE event_id // 64 >= 3 GROUP BY 1""",
)


def written_manifest(spark: SparkSession, d: str) -> DataFrame:
    """A job that runs once writes a table's manifest; the second call finds it done."""
    docs, path = load(spark, d, "documents"), new_path(spark, "manifest")
    write = lambda df, to: writers.manifest(df, to, "docs", "retrieval", "jsonl", note="whole")
    ran = [writers.once(spark, path, lambda: docs, write) for _ in range(2)]
    found = spark.read.json(path)
    return found.select("name", "count", "task_type", "format", F.col("extra.note").alias("note")).withColumns({"ran_first": F.lit(ran[0]), "ran_again": F.lit(ran[1])})


register("written_manifest", written_manifest, "SELECT 'docs' AS name, count(*) AS count, 'retrieval' AS task_type, 'jsonl' AS format, 'whole' AS note, true AS ran_first, false AS ran_again FROM documents")


def single_document(spark: SparkSession, d: str) -> DataFrame:
    """A summary document that is replaced after every task: a reader sees one whole version, the last."""
    path = f"{new_path(spark, 'summary')}/summary.json"
    scores = vectors(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy("label").collect()  # a row for each label
    tasks: dict[str, dict] = {}
    for r in scores:
        tasks[str(r["label"])] = {"type": "t", "score": float(r["n"]), "num_subsets": 1}
        writers.replace_json(spark, path, {"per_task": tasks})
    return readers.summaries(spark, path)


register("single_document", single_document, "SELECT label::VARCHAR AS task, count(*)::DOUBLE AS score FROM embeddings GROUP BY label")


def _in_order(docs: DataFrame) -> DataFrame:
    """Dealt to files in the order of doc_id, eight at least."""
    files = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return docs.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id")


def early_stop_lines(spark: SparkSession, d: str) -> DataFrame:
    """The first 300 lines of a folder of text files and their places; files behind these aren't read."""
    path = new_path(spark, "lines")
    _in_order(load(spark, d, "documents")).select(F.concat_ws(" ", "doc_id", F.md5("text"))).write.text(path)
    return readers.raw_lines(spark, path, 300)


register("early_stop_lines", early_stop_lines, "SELECT doc_id || ' ' || md5(text) AS value, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents ORDER BY doc_id LIMIT 300")


def early_stop_rows(spark: SparkSession, d: str) -> DataFrame:
    """The first 40 documents in French of a folder of Parquet files, with their places among all."""
    path = new_path(spark, "rows")
    _in_order(load(spark, d, "documents")).write.parquet(path)
    return readers.parquet_rows(spark, path, 40, F.col("lang") == "fr").select("doc_id", F.md5("text").alias("text_md5"), "place")


register(
    "early_stop_rows",
    early_stop_rows,
    "SELECT doc_id, md5(text) AS text_md5, place FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents) WHERE lang = 'fr' ORDER BY doc_id LIMIT 40",
)


def teacher_shards(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of all documents in seven shards: a first run does two of them, the second finds these done and does the others."""
    rows = load(spark, d, "documents").select("doc_id", text.item(F.col("lang"), _none()).alias("query"), text.item(F.col("source"), _none()).alias("positive"))
    folder = new_path(spark, "shards")
    teacher.store_shards(rows, "doc_id", "docs", folder, _length_model, 7, only=[1, 4])
    report = teacher.store_shards(rows, "doc_id", "docs", folder, _length_model, 7, together=3)
    unit = lambda v: F.abs(norm(F.col(v)) - 1) < 1e-6
    size = -(-rows.count() // 7)
    found = teacher.shard_vectors(spark, folder, "docs").groupBy(F.floor(F.col("row_idx") / size).cast("int").alias("shard")).agg(F.min("row_idx").alias("first_row"), F.max("row_idx").alias("last_row"), F.count_if(unit("q") & unit("p")).alias("n_unit"))
    return report.join(found, "shard")


register(
    "teacher_shards",
    teacher_shards,
    """WITH n AS (SELECT count(*) AS n, (count(*) + 6) // 7 AS size FROM documents),
        r AS (SELECT (row_number() OVER (ORDER BY doc_id) - 1) AS i FROM documents)
        SELECT (i // size)::INT AS shard, CASE WHEN i // size IN (1, 4) THEN 'exists' ELSE 'stored' END AS status, count(*) AS n_rows, min(i) AS first_row, max(i) AS last_row, count(*) AS n_unit FROM r, n GROUP BY ALL""",
)


def half_vector_files(spark: SparkSession, d: str) -> DataFrame:
    """All vectors in half precision, both sides, joined by row number to their rows again."""
    placed = ordinals(vectors(spark, d), ["id"], name="row_idx")
    both = F.array(F.struct(F.lit("query").alias("side"), F.col("v").alias("v")), F.struct(F.lit("positive").alias("side"), F.reverse("v").alias("v")))
    path = new_path(spark, "halves")
    halves.write(placed.select(F.lit("all").alias("subset"), "row_idx", F.explode(both).alias("x")).select("subset", "x.side", "row_idx", "x.v"), path, size=100)
    found = halves.aligned(placed.select("row_idx", "id", "v"), path, "all", size=100)
    near = lambda a, b: F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= 5e-4 * F.greatest(F.abs(y), F.lit(1e-3))), lambda x: x)
    return found.select(F.col("id").alias("vec_id"), "row_idx", F.size("teacher_q").alias("dims"), (near("teacher_q", F.col("v")) & near("teacher_p", F.reverse("v"))).alias("close"))


register("half_vector_files", half_vector_files, "SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS row_idx, len(embedding)::INT AS dims, true AS close FROM embeddings")


def arrow_pages(spark: SparkSession, d: str) -> DataFrame:
    """All pages with their bytes in a folder of Arrow streams, in batches of seven rows, read by batches; every third has a name of its own, every tenth no query."""
    pages = load(spark, d, "pages").select(
        "page_id", F.when(F.col("page_id") % 10 != 9, F.col("url")).alias("query"),
        F.struct(F.encode("html", "UTF-8").alias("bytes"), F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("p"), "page_id")).alias("path")).alias("image"),
    )
    path = new_path(spark, "arrows")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    arrows.write(pages.repartitionByRange(parts, "page_id").sortWithinPartitions("page_id").select("query", "image"), path, size=7)
    found = readers.page_images(arrows.read(spark, path, ["query", "image"]), "colpali")
    return found.select("place", F.col("query.text").alias("query"), F.col("positive.name").alias("name"), F.md5("positive.image").alias("image_md5"), "subset_name")


register(
    "arrow_pages",
    arrow_pages,
    """SELECT place, url AS query, CASE WHEN page_id % 3 = 0 THEN 'p' || page_id ELSE 'colpali_' || place END AS name, CASE WHEN html <> '' THEN md5(html) END AS image_md5, 'colpali' AS subset_name
        FROM (SELECT *, row_number() OVER (ORDER BY page_id) - 1 AS place FROM pages) WHERE page_id % 10 <> 9 AND url <> ''""",
)


def registry_scan(spark: SparkSession, d: str) -> DataFrame:
    """Four sources of three formats by repository, configuration and split; the test split's branch isn't in the plan."""
    root, docs = new_path(spark, "hub"), load(spark, d, "documents")
    even = F.col("doc_id") % 2 == 0
    docs.where(even).write.parquet(f"{root}/docs/short/train")
    docs.where(~even).write.json(f"{root}/docs/short/test")
    docs.where("lang = 'fr'").select("doc_id", "lang").write.orc(f"{root}/docs/french/train")
    load(spark, d, "pages").select("page_id", "url").write.parquet(f"{root}/pages/train")
    known = spark.createDataFrame(
        [("short", "docs", "short", "train", "parquet", "n_chars < 2000"), ("short", "docs", "short", "test", "json", None), ("french", "docs", "french", "train", "orc", None), ("pages", "pages", None, "train", "parquet", None)], hub.CATALOGUE
    )
    return hub.inventory(hub.scan(spark, known, root).where("split = 'train'"), "lang")


register(
    "registry_scan",
    registry_scan,
    """SELECT 'short' AS name, 'docs' AS repo, 'short' AS config, 'train' AS split, count(*) AS n, count(lang) AS n_filled FROM documents WHERE doc_id % 2 = 0 AND n_chars < 2000
        UNION ALL SELECT 'french', 'docs', 'french', 'train', count(*), count(lang) FROM documents WHERE lang = 'fr'
        UNION ALL SELECT 'pages', 'pages', NULL, 'train', count(*), 0 FROM pages""",
)
