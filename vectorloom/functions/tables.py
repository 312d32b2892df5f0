"""Tables that cut lineage, and dense ordinals without a task that sees all rows."""

from __future__ import annotations

import json
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SCOPES = threading.local()
#: Values of ``by`` whose first numbers are broadcast at most.
MOST_FIRSTS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which driver and executors share; on a local master (tests) a folder of our own where it is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="vectorloom-"))
    return sc.getCheckpointDir()


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder of any file system; one that isn't there is no error."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes what ``materialise`` writes inside, but for tables with ``keep``, which pass to the scope around this one.

    Only results that are written or collected inside may be used afterwards.
    """
    scopes = _SCOPES.__dict__.setdefault("open", [])
    scopes.append([])
    try:
        yield
    finally:
        for path in scopes.pop():
            delete(spark, path)


def share_scopes() -> Callable[[], None]:
    """A function that lets the thread which calls it write in the scopes that are open in this one."""
    scopes = _SCOPES.__dict__.setdefault("open", [])

    def inherit() -> None:
        _SCOPES.open = list(scopes)  # the same scopes, and a stack of its own for new ones

    return inherit


def new_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A path in the shared folder; it is deleted at the end of the scope, if there is one."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    scopes = _SCOPES.__dict__.setdefault("open", [])
    if len(scopes) > keep:
        scopes[-1 - keep].append(path)
    return path


def materialise(df: DataFrame, name: str = "table", keep: bool = False, compression: str = "snappy") -> DataFrame:
    """Writes ``df`` in the shared folder and reads it again."""
    path = new_path(df.sparkSession, name, keep)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ordinals(df: DataFrame, order: list[str | Column], by: str | None = None, name: str = "ordinal") -> DataFrame:
    """``df`` with dense numbers from 0 by ``order``, within each value of ``by`` if given.

    Rows are sorted by range, so a value of ``by`` that holds most rows is dealt to many tasks. Each part is
    numbered alone, and what comes before it is added from one row for each part. Ties are numbered in
    any order, so ``order`` should be a key.
    """
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    full = ([F.col(by)] if by else []) + keys
    named = {f"__k{i}": k for i, k in enumerate(full)}
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = df.select("*", *[k.alias(n) for n, k in named.items()]).repartitionByRange(parts, *named).sortWithinPartitions(*named)
    numbered = materialise(spread.withColumn("__at", F.monotonically_increasing_id()), "ordinals")
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = numbered.groupBy(part.alias("__part")).count().collect()  # one row for each part
    held = {r["__part"]: r["count"] for r in sizes}
    starts, total = [], 0
    for k in range(max(held, default=-1) + 1):
        starts.append(total)
        total += held.get(k, 0)
    # a constant array, so a row finds its part's start at once however many parts there are
    offset = F.get(F.from_json(F.lit(json.dumps(starts)), "array<bigint>"), part.cast("int"))
    out = numbered.withColumn(name, (place + offset).cast("long"))
    if by:
        first = materialise(out.groupBy(F.col(by).alias("__by")).agg(F.min(name).alias("__first")), "firsts")
        # few values of ``by`` would make as few tasks of a join by shuffle
        first = F.broadcast(first) if first.limit(MOST_FIRSTS + 1).count() <= MOST_FIRSTS else first
        out = out.join(first, F.col(by).eqNullSafe(F.col("__by"))).withColumn(name, F.col(name) - F.col("__first")).drop("__by", "__first")
    return out.drop("__at", *named)


def prefix(df: DataFrame, order: list[str], cap: int | None) -> DataFrame:
    """The first ``cap`` rows by ``order``; None or 0 is no cap. Rows are numbered by a range sort, so no task sees all of a large cap."""
    return ordinals(df, list(order), name="__place").where(F.col("__place") < cap).drop("__place") if cap else df
