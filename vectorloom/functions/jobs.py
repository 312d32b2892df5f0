"""Independent jobs side by side on one cluster."""

from __future__ import annotations

import logging
import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession

from vectorloom.functions.tables import share_scopes

LOG = logging.getLogger("vectorloom")


@dataclass(frozen=True)
class Outcome:
    value: Any = None
    error: Exception | None = None

    @property
    def message(self) -> str | None:
        """The first line of the error; the log has all of it."""
        return (str(self.error).splitlines() or [type(self.error).__name__])[0] if self.error else None


def side_by_side(spark: SparkSession, tasks: dict[str, Callable[[], Any]], most: int = 4, stop_at_error: bool = False) -> dict[str, Outcome]:
    """What each task returned or raised, in their order; ``most`` of them run at a time, each in a thread.

    Spark's jobs of a task have a pool and a tag of its own. With ``spark.scheduler.mode`` FAIR the pools share the
    executors evenly, so a long task doesn't keep short ones waiting; without it they queue by job. A task that fails
    has its own jobs cancelled and no others; with ``stop_at_error`` those of all tasks are, and tasks that haven't
    begun are left out as cancelled. Tables written inside go to the caller's ``scratch`` scope.
    """
    sc, run = spark.sparkContext, uuid.uuid4().hex
    inherit, stopped = share_scopes(), threading.Event()
    tags = {name: f"vectorloom-{run}-{k}" for k, name in enumerate(tasks)}

    def work(name: str) -> Outcome:
        if stopped.is_set():
            return Outcome(error=RuntimeError("cancelled"))
        inherit()
        sc.setLocalProperty("spark.scheduler.pool", tags[name])
        sc.addJobTag(tags[name])
        try:
            return Outcome(tasks[name]())
        except Exception as error:
            LOG.exception("%s failed", name)
            sc.cancelJobsWithTag(tags[name])
            if stop_at_error:
                stopped.set()
                for tag in tags.values():
                    sc.cancelJobsWithTag(tag)
            return Outcome(error=error)
        finally:
            sc.clearJobTags()
            sc.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(max(1, min(most, len(tasks) or 1))) as pool:
        return dict(zip(tasks, pool.map(work, tasks), strict=True))
