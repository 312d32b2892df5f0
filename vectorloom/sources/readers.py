"""Readers that bring heterogeneous training sources to one row shape.

Rows: query and positive (struct of text, image_path), negatives (array of text), task_type, subset_name, score.
Each reader works lazily on a DataFrame or a path; caps are prefixes by an explicit key (see functions.tables).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectorloom.functions.media import is_frame
from vectorloom.functions.tables import prefix
from vectorloom.functions.text import clean_placeholder, filled, image_path, item, strip
from vectorloom.operators.instructions import task_type
from vectorloom.operators.mixing import mix
from vectorloom.sources.scan import first_rows, text_lines

SIDE = T.StructType([T.StructField("text", T.StringType()), T.StructField("image_path", T.StringType())])
MINED = T.StructType(
    [
        T.StructField("query", SIDE),
        T.StructField("positive", SIDE),
        T.StructField("hard_negatives", T.ArrayType(SIDE)),
        T.StructField("task_type", T.StringType()),
        T.StructField("subset_name", T.StringType()),
    ]
)
#: Column names of each text source, renamed to query, positive, negative.
TEXT_SOURCES = {
    "msmarco": ("query", "positive", "negative"),
    "allnli": ("anchor", "positive", "negative"),
    "gooaq": ("question", "answer", None),
    "quora": ("anchor", "positive", "negative"),
}


def jsonl(spark: SparkSession, path: str, schema: T.StructType, order: str | None = None, cap: int | None = None) -> DataFrame:
    """Lines of JSON with a declared schema; a cap takes the first by a key, or without one by files and places."""
    rows = spark.read.schema(schema).json(path)
    if not cap:
        return rows
    if order is None:
        return first_rows(spark, path, lambda files: spark.read.schema(schema).json(files), cap).drop("place")
    return prefix(rows, [order], cap)


def parquet_rows(spark: SparkSession, path: str, most: int, keep: Column | None = None) -> DataFrame:
    """The first ``most`` rows of Parquet files that ``keep`` holds for, with their place; files behind the cap aren't read."""
    return first_rows(spark, path, lambda files: spark.read.parquet(*files), most, keep)


def text_list(raw: Column) -> Column:
    """A field that is a text or a JSON list of texts, as a list without blanks."""
    listed = F.when(raw.rlike(r"^\s*\["), F.from_json(raw, "array<string>"))
    return F.filter(F.coalesce(listed, F.when(raw.isNotNull(), F.array(raw)), F.array().cast("array<string>")), lambda x: x.isNotNull() & (strip(x) != ""))


def text_triplets(rows: DataFrame, subset: str, names: tuple[str, str, str | None] = ("query", "positive", "negative")) -> DataFrame:
    """Rows with a query and a positive; the negative falls back to hard_negative, and may be a list."""
    q, p, n = names
    none = F.lit(None).cast("string")
    raw = F.coalesce(*[F.col(c) for c in (n, "hard_negative") if c and c in rows.columns], none)
    return rows.where((F.coalesce(F.col(q), F.lit("")) != "") & (F.coalesce(F.col(p), F.lit("")) != "")).select(
        item(F.col(q), none).alias("query"), item(F.col(p), none).alias("positive"), text_list(raw).alias("negatives"),
        F.lit("retrieval").alias("task_type"), F.lit(subset).alias("subset_name"), F.lit(None).cast("double").alias("score"),
    )


def sentence_pairs(rows: DataFrame, subset: str) -> DataFrame:
    """sentence1, sentence2, score."""
    none = F.lit(None).cast("string")
    return rows.select(
        item(F.col("sentence1"), none).alias("query"), item(F.col("sentence2"), none).alias("positive"), F.array().cast("array<string>").alias("negatives"),
        F.lit("sts").alias("task_type"), F.lit(subset).alias("subset_name"), F.col("score").cast("double").alias("score"),
    )


def benchmark_rows(rows: DataFrame, subset: str, image_root: str) -> DataFrame:
    """qry, qry_image_path, pos_text, pos_image_path, neg_text."""
    return rows.select(
        item(clean_placeholder(F.col("qry")), image_path(image_root, F.col("qry_image_path"))).alias("query"),
        item(clean_placeholder(F.col("pos_text")), image_path(image_root, F.col("pos_image_path"))).alias("positive"),
        F.transform(text_list(F.col("neg_text")), clean_placeholder).alias("negatives"),
        task_type(F.lit(subset)).alias("task_type"), F.lit(subset).alias("subset_name"), F.lit(None).cast("double").alias("score"),
    )


def image_pairs(rows: DataFrame, subset: str, image_root: str) -> DataFrame:
    """q_img, t_img, q_texts: the first text is the query's; without a target image the query's own is the positive."""
    text = F.try_element_at("q_texts", F.lit(1))
    return rows.select(
        item(text, image_path(image_root, F.col("q_img"))).alias("query"),
        item(F.lit(None).cast("string"), image_path(image_root, F.coalesce(filled(F.col("t_img")), F.col("q_img")))).alias("positive"),
        F.array().cast("array<string>").alias("negatives"), F.lit("retrieval").alias("task_type"), F.lit(subset).alias("subset_name"), F.lit(None).cast("double").alias("score"),
    )


def document_pages(rows: DataFrame, subset: str, ordinal: str) -> DataFrame:
    """query, image_filename: rows with a query; a page without a name is called by its ordinal."""
    name = F.coalesce(filled(F.col("image_filename")), F.concat(F.lit(f"{subset}_"), F.col(ordinal).cast("string")))
    return rows.where(F.coalesce(F.col("query"), F.lit("")) != "").select(
        item(F.col("query"), F.lit(None).cast("string")).alias("query"), item(F.lit(None).cast("string"), name).alias("positive"),
        F.array().cast("array<string>").alias("negatives"), F.lit("retrieval").alias("task_type"), F.lit(subset).alias("subset_name"), F.lit(None).cast("double").alias("score"),
    )


def page_images(rows: DataFrame, subset: str) -> DataFrame:
    """query, image (struct of bytes and path), place, as ``sources.arrows`` reads them: rows with a query, with the bytes of their page.

    A page is called by its path, and by its place if it has none. Empty bytes are none.
    """
    held = F.when(F.length("image.bytes") > 0, F.col("image.bytes"))
    name = F.coalesce(filled(F.col("image.path")), F.concat(F.lit(f"{subset}_"), F.col("place").cast("string")))
    return rows.where(F.coalesce(F.col("query"), F.lit("")) != "").select(
        item(F.col("query"), F.lit(None).cast("string")).alias("query"), F.struct(name.alias("name"), held.alias("image")).alias("positive"),
        F.lit("retrieval").alias("task_type"), F.lit(subset).alias("subset_name"), "place",
    )


def mined_rows(spark: SparkSession, path: str, file_stem: str, most: int = 15) -> DataFrame:
    """Rows as ``writers.jsonl`` leaves mined negatives; a row's own task and subset go before the file's."""
    rows = spark.read.schema(MINED).json(path)
    return rows.select(
        "query", "positive", F.transform(F.slice("hard_negatives", 1, most), lambda x: x["text"]).alias("negatives"),
        F.coalesce("task_type", F.lit("retrieval")).alias("task_type"), F.coalesce("subset_name", F.lit(file_stem)).alias("subset_name"), F.lit(None).cast("double").alias("score"),
    )


def conversation_pairs(turns: DataFrame) -> DataFrame:
    """conv_id, question, answer: the last text of the user and of the assistant, where both are."""
    last = lambda role: F.max_by(F.when(F.col("role") == role, F.col("text")), F.when((F.col("role") == role), F.col("turn")))
    both = turns.groupBy("conv_id").agg(last("user").alias("question"), last("assistant").alias("answer"))
    return both.where((F.coalesce("question", F.lit("")) != "") & (F.coalesce("answer", F.lit("")) != ""))


def frame_lists(files: DataFrame) -> DataFrame:
    """folder, frames: the paths of the images of each folder in order (path as the ``binaryFile`` reader gives it)."""
    images = files.select(F.regexp_replace("path", "^file:(//)?", "").alias("path")).where(is_frame(F.col("path")))
    return images.groupBy(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder")).agg(F.array_sort(F.collect_list("path")).alias("frames"))


def video_triplets(rows: DataFrame, files: DataFrame, video_root: str, subset: str) -> DataFrame:
    """query_text, positive_text, video_path: a path that is a folder of ``files`` is its list of frames, another one is a file."""
    path = F.when(strip(F.col("video_path")) != "", F.concat(F.lit(video_root.rstrip("/") + "/"), F.col("video_path")))
    none = F.lit(None).cast("string")
    found = rows.withColumn("_path", path).join(frame_lists(files), F.col("_path") == F.col("folder"), "left")
    return found.select(
        item(F.col("query_text"), none).alias("query"), item(F.col("positive_text"), none).alias("positive"), "frames",
        F.when(F.col("frames").isNull(), F.col("_path")).alias("file"), F.lit("retrieval").alias("task_type"), F.lit(subset).alias("subset_name"),
    )


def mined_files(files: DataFrame) -> DataFrame:
    """name, path, is_classes of the files (path, length) of mined rows that aren't empty; the one of class labels is told apart."""
    name = F.regexp_extract("path", r"([^/]*)\.jsonl$", 1)
    return files.where((name != "") & (F.col("length") > 0)).select(F.regexp_replace(name, "^mmeb_", "").alias("name"), "path", (name == "classification_hn").alias("is_classes"))


def concat_subsets(parts: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """The parts of a benchmark as one table with the column subset; parts that can't be read are left out."""
    return mix(parts.items()).withColumnRenamed("source_name", "subset").drop("source_idx")


def bounded(rows: DataFrame, order: str, transform: Callable[[DataFrame], DataFrame], most: int) -> DataFrame:
    """The first ``most`` rows by ``order`` that are left after ``transform``, which must keep that column."""
    return prefix(transform(rows), [order], most)


def raw_lines(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """value, place: the lines of text files as they are, at most ``most``; place orders them by files and places.

    With a cap it is their number from 0, and files behind it aren't read.
    """
    if most:
        return text_lines(spark, path, most)
    # the block where a file's rows stand orders them; lines of one block are numbered by its task
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    return lines.select("value", F.struct("file", "block", "at").alias("place"))


def by_registry(spark: SparkSession, registry: DataFrame, name: str) -> DataFrame:
    """The table of a source that ``registry`` (name, format, path, filter) lists; a filter is a condition in SQL."""
    own = registry.where(F.col("name") == name).collect()
    if len(own) != 1:
        raise ValueError(f"{len(own)} sources are called {name}")
    found = spark.read.format(own[0]["format"]).load(own[0]["path"])
    return found.where(own[0]["filter"]) if own[0]["filter"] else found


def corpus_ids(spark: SparkSession, path: str, column: str = "corpus-id") -> DataFrame:
    """cid: the ids of a corpus as texts; only their column is read."""
    return spark.read.parquet(path).select(F.col(f"`{column}`").cast("string").alias("cid"))


def with_label_names(rows: DataFrame, names: DataFrame, most: int = 100_000) -> DataFrame:
    """``rows`` (label) with name, from ``names`` (label, name); a label that it lacks is its own name. Small tables are broadcast."""
    side = F.broadcast(names) if names.limit(most + 1).count() <= most else names
    return rows.join(side, "label", "left").withColumn("name", F.coalesce("name", "label"))


def retrieval_triple(spark: SparkSession, queries: str, corpus: str | None, qrels: str, language: str | None = None) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Queries (qid, query), corpus (cid, ...) and relevance (qid, cid, score) from Parquet; ids become texts."""
    q = spark.read.parquet(queries)
    if language:
        q = q.where(F.col("language") == language)
    q = q.select(F.col("`query-id`").cast("string").alias("qid"), "query")
    r = spark.read.parquet(qrels).select(F.col("`query-id`").cast("string").alias("qid"), F.col("`corpus-id`").cast("string").alias("cid"), F.col("score").cast("int"))
    c = spark.read.parquet(corpus).withColumn("cid", F.col("`corpus-id`").cast("string")).drop("corpus-id") if corpus else None
    return q, c, r


def teacher_vectors(rows: DataFrame, teacher: DataFrame) -> DataFrame:
    """``rows`` (subset, row_idx, ...) with the teacher's q and p; a row without them raises."""
    both = rows.join(teacher.select("subset", "row_idx", F.col("q").alias("teacher_q"), F.col("p").alias("teacher_p")), ["subset", "row_idx"], "left")
    missing = F.raise_error(F.concat(F.lit("no teacher vectors for row "), F.col("row_idx").cast("string")))
    return both.withColumn("teacher_q", F.when(F.col("teacher_q").isNull(), missing.cast("array<float>")).otherwise(F.col("teacher_q")))


def summaries(spark: SparkSession, path: str) -> DataFrame:
    """task, score of a run's JSON summary (per_task); a missing file has no rows."""
    schema = "per_task map<string, struct<type: string, score: double, num_subsets: int>>"
    try:
        found = spark.read.schema(schema).option("multiLine", True).json(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], "task string, score double")
    return found.select(F.explode("per_task").alias("task", "x")).select("task", F.col("x.score").alias("score"))


def prompts(spark: SparkSession, path: str) -> DataFrame:
    """task, query_prompt, passage_prompt, symmetric of a JSON object of texts or of objects with query and passage."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("task", "entry"))
    pair = F.from_json("entry", "query string, passage string")
    symmetric = F.col("entry").rlike(r"^\s*\{")
    return raw.select(
        "task", F.when(symmetric, pair["query"]).otherwise(F.col("entry")).alias("query_prompt"),
        F.when(symmetric, pair["passage"]).otherwise(F.col("entry")).alias("passage_prompt"), symmetric.alias("symmetric"),
    )
