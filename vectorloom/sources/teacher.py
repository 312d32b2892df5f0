"""Jobs that store a teacher's vectors of both sides of training rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from vectorloom.functions.tables import ordinals
from vectorloom.sources import writers
from vectorloom.sources.embedder import embed


def sides(rows: DataFrame, order: str, cap: int | None = None) -> DataFrame:
    """row_idx, side, item of rows in the readers' shape (query, positive): the items as JSON, numbered from 0 by ``order``."""
    placed = ordinals(rows, [order], name="row_idx")
    placed = placed.where(F.col("row_idx") < cap) if cap else placed
    both = F.array(*[F.struct(F.lit(s).alias("side"), F.to_json(s).alias("item")) for s in ("query", "positive")])
    return placed.select("row_idx", F.explode(both).alias("x")).select("row_idx", "x.side", "x.item")


def store_vectors(
    spark: SparkSession,
    sources: dict[str, Callable[[], tuple[DataFrame, str]]],
    folder: str,
    load: Callable[[], Callable[[list], np.ndarray]],
    batch: int = 32,
    cap: int | None = None,
) -> DataFrame:
    """subset, status, n_rows, error: the vectors of every source's rows, each source a table of its own in ``folder``.

    A source gives its rows, of any of the readers, and the column that orders them. One whose table is there is
    skipped, and one that fails doesn't stop the others.
    """
    out = []
    for subset, make in sources.items():
        path = f"{folder}/{subset}"
        if writers.exists(spark, path):
            out.append((subset, "exists", None, None))
            continue
        try:
            rows, order = make()
            items = sides(rows, order, cap).withColumn("key", F.col("row_idx") * 2 + (F.col("side") == "positive").cast("long"))
            found = embed(items, "key", "item", load, batch)
            named = found.select(F.lit(subset).alias("subset"), F.when(F.col("key") % 2 == 0, "query").otherwise("positive").alias("side"), F.floor(F.col("key") / 2).alias("row_idx"), "v")
            writers.vectors(named, path)
            out.append((subset, "stored", spark.read.parquet(path).where("side = 'query'").count(), None))
        except Exception as error:  # any source's error
            out.append((subset, "failed", None, str(error).splitlines()[0][:200]))
    return spark.createDataFrame(out, "subset string, status string, n_rows long, error string")


def store_shards(
    rows: DataFrame,
    order: str,
    subset: str,
    folder: str,
    load: Callable[[], Callable[[list], np.ndarray]],
    shards: int,
    together: int = 8,
    only: Iterable[int] | None = None,
    batch: int = 32,
) -> DataFrame:
    """shard, status, n_rows: the vectors of ``rows`` in contiguous shards of ceil(n / shards) rows by ``order``, a key.

    ``together`` shards are computed by one job, which replaces their folders and no others, and are marked in a table
    when it has ended. Shards with a mark are skipped; what a killed job has left of the others is replaced. ``only``
    names the shards of this run, so that several runs may share a subset. Rows must be those of the
    first run: marks that were made for another number of rows or shards raise.
    """
    spark, path = rows.sparkSession, f"{folder}/{subset}"
    items = sides(rows, order)
    n = items.count() // 2
    size = max(1, -(-n // shards))
    marks = _marks(spark, path)
    if any((m["total"], m["shards"]) != (n, shards) for m in marks.values()):
        raise ValueError(f"{path} was made of other rows or shards")
    wanted = range(-(-n // size)) if only is None else sorted({*only} & {*range(-(-n // size))})
    missing = [k for k in wanted if k not in marks]
    placed = items.withColumn("shard", F.floor(F.col("row_idx") / size).cast("int")).withColumn("key", F.col("row_idx") * 2 + (F.col("side") == "positive").cast("long"))
    for a in range(0, len(missing), together):
        group = missing[a : a + together]
        found = embed(placed.where(F.col("shard").isin(group)), "key", "item", load, batch)
        row = F.floor(F.col("key") / 2)
        named = found.select(F.floor(row / size).cast("int").alias("shard"), F.when(F.col("key") % 2 == 0, "query").otherwise("positive").alias("side"), row.alias("row_idx"), F.col("v").cast("array<float>").alias("v"))
        named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard", "side").parquet(f"{path}/vectors")
        ended = [(k, min(n, (k + 1) * size) - k * size, n, shards) for k in group]
        spark.createDataFrame(ended, MARK).coalesce(1).write.mode("append").json(f"{path}/marks")
    done = _marks(spark, path)
    out = [(k, "stored" if k in missing else "exists", done[k]["n_rows"]) for k in wanted]
    return spark.createDataFrame(out, "shard int, status string, n_rows long")


MARK = "shard int, n_rows long, total long, shards int"


def _marks(spark: SparkSession, path: str) -> dict[int, Row]:
    """The mark of each shard that is done; a row for each shard."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/marks")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return {}
    return {r["shard"]: r for r in spark.read.schema(MARK).json(f"{path}/marks").collect()}


def shard_vectors(spark: SparkSession, folder: str, subset: str) -> DataFrame:
    """row_idx, q, p of the shards of a subset that are marked."""
    marked = list(_marks(spark, f"{folder}/{subset}"))
    found = spark.read.schema("row_idx long, v array<float>, shard int, side string").parquet(f"{folder}/{subset}/vectors").where(F.col("shard").isin(marked))
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("v")))
    return found.groupBy("row_idx").agg(side("query").alias("q"), side("positive").alias("p"))


def stored_vectors(spark: SparkSession, folder: str, subsets: Iterable[str]) -> DataFrame:
    """subset, row_idx, q, p of the stored vectors, a row for each training row."""
    found = None
    for subset in subsets:
        one = spark.read.parquet(f"{folder}/{subset}").select(F.lit(subset).alias("subset"), "side", "row_idx", "v")
        found = one if found is None else found.unionByName(one)
    if found is None:
        raise ValueError("no subset is named")
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("v")))
    return found.groupBy("subset", "row_idx").agg(side("query").alias("q"), side("positive").alias("p"))
