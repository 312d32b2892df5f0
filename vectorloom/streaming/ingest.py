"""Streams of training rows and of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from vectorloom.functions.text import clean_always


def clean_rows(rows: DataFrame, text: str) -> DataFrame:
    """Cleaned texts, without blank ones, with the key that duplicates share."""
    return rows.withColumn(text, clean_always(F.col(text))).where(F.col(text) != "").withColumn("text_key", F.sha2(F.col(text), 256))


def ingest(spark: SparkSession, folder: str, schema: StructType, text: str, time: str, delay: str) -> DataFrame:
    """A stream of the JSON files that arrive in ``folder``: cleaned, the first of each text within ``delay`` of event time."""
    arrived = spark.readStream.schema(schema).json(folder).withColumn(time, F.col(time).cast("timestamp"))
    return clean_rows(arrived, text).withWatermark(time, delay).dropDuplicatesWithinWatermark(["text_key"])


def window_counts(events: DataFrame, time: str, key: str, width: str, delay: str | None = None) -> DataFrame:
    """start, ``key``, n: events of each tumbling window; with ``delay`` late ones are dropped, as a stream needs."""
    seen = events.withColumn(time, F.col(time).cast("timestamp"))
    if delay:
        seen = seen.withWatermark(time, delay)
    return seen.groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")


def append(stream: DataFrame, to: str, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Appends what has arrived as Parquet, each file once, and ends; or calls ``each`` for every batch."""
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.foreachBatch(each).start() if each else writer.format("parquet").option("path", to).start()
