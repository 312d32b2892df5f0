"""Sinks: lines of JSON, manifests, vectors, and jobs that run once."""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    """A job has written ``path`` to its end."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def once(spark: SparkSession, path: str, make: Callable[[], DataFrame], write: Callable[[DataFrame, str], None]) -> bool:
    """Makes and writes a table unless it is there; tells whether it did."""
    if exists(spark, path):
        return False
    write(make(), path)
    return True


def jsonl(rows: DataFrame, path: str) -> None:
    """One object a line, nulls kept; files appear when the whole job is done."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def replace_json(spark: SparkSession, path: str, value: dict) -> None:
    """One small JSON document in place of the last one: written whole under another name, then renamed over it."""
    jvm = spark.sparkContext._jvm
    to, draft = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.{uuid.uuid4().hex}"))
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(draft, True)
    try:
        out.write(bytearray(json.dumps(value, indent=2, sort_keys=True).encode()))
    finally:
        out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    whole = fs.makeQualified(to)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(draft), whole, options)


def log_to(spark: SparkSession, path: str, name: str = "vectorloom") -> logging.Handler:
    """Adds a file to the log of a run; ``path`` is the driver's own. The caller removes the handler."""
    handler = logging.FileHandler(path)
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    logger = logging.getLogger(name)
    logger.setLevel(logging.INFO)
    logger.addHandler(handler)
    return handler


def manifest(rows: DataFrame, path: str, name: str, task_type: str, kind: str, **extra: str) -> None:
    """One row that describes a table: its name, count, task, format and what else is known."""
    more = F.create_map(*[F.lit(x) for pair in extra.items() for x in pair]) if extra else F.lit(None).cast("map<string,string>")
    one = rows.agg(F.count(F.lit(1)).alias("count")).select(F.lit(name).alias("name"), "count", F.lit(task_type).alias("task_type"), F.lit(kind).alias("format"), more.alias("extra"))
    one.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def vectors(rows: DataFrame, path: str) -> None:
    """Vectors (subset, side, row_idx, v) as single precision in a folder for each subset and side."""
    rows.withColumn("v", F.col("v").cast("array<float>")).write.mode("overwrite").partitionBy("subset", "side").parquet(path)


def mined(negatives: DataFrame, items: DataFrame, pairs: DataFrame, task_type: str, subset: str) -> DataFrame:
    """Rows of the mined contract from long negatives (qid, pos_in_list, cid), items (cid, side) and pairs (qid, query, positive)."""
    listed = (
        negatives.join(items, "cid").groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos_in_list", "side"))), lambda x: x["side"]).alias("hard_negatives"))
    )
    return pairs.join(listed, "qid", "left").select("query", "positive", F.coalesce("hard_negatives", F.array()).alias("hard_negatives"), F.lit(task_type).alias("task_type"), F.lit(subset).alias("subset_name"))
