"""Summaries of task scores by category and type, comparisons of two runs, run numbers and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def category_means(scores: DataFrame, digits: int = 6) -> DataFrame:
    """level ('category' or 'all'), category, mean_score, n_tasks of task scores (task, category, score); null scores don't count."""
    rolled = (
        scores.where(F.col("score").isNotNull())
        .rollup("category")
        .agg(F.grouping("category").alias("_all"), F.round(F.avg("score"), digits).alias("mean_score"), F.count(F.lit(1)).alias("n_tasks"))
    )
    return rolled.select(F.when(F.col("_all") == 1, "all").otherwise("category").alias("level"), "category", "mean_score", "n_tasks")


def hierarchy_means(subsets: DataFrame, digits: int = 6) -> DataFrame:
    """level, name, score, n of subset scores (type, task, subset, score).

    Levels: 'task' (mean of its subsets), 'type' (mean of its subsets), 'mean_subset' (of all subsets) and
    'mean_type' (of the types' means).
    """
    known = subsets.where(F.col("score").isNotNull())

    def level(name: str, key: str) -> DataFrame:
        return known.groupBy(F.col(key).cast("string").alias("name")).agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("level"), "name", "score", "n")

    task, kind = level("task", "task"), level("type", "type")
    every = known.agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("n")).select(F.lit("mean_subset").alias("level"), F.lit("all").alias("name"), "score", "n")
    types = kind.agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("n")).select(F.lit("mean_type").alias("level"), F.lit("all").alias("name"), "score", "n")
    whole = task.unionByName(kind).unionByName(every).unionByName(types)
    return whole.withColumn("score", F.round("score", digits))


def compare(a: DataFrame, b: DataFrame, digits: int = 6) -> DataFrame:
    """task, score_a, score_b, delta, missing_a, missing_b of two runs (task, score); a task that a run lacks scores 0."""
    both = a.select("task", F.col("score").alias("_a")).join(b.select("task", F.col("score").alias("_b")), "task", "full")
    x, y = F.coalesce("_a", F.lit(0.0)), F.coalesce("_b", F.lit(0.0))
    return both.select("task", F.round(x, digits).alias("score_a"), F.round(y, digits).alias("score_b"), F.round(y - x, digits).alias("delta"), F.col("_a").isNull().alias("missing_a"), F.col("_b").isNull().alias("missing_b"))


def split_means(scores: DataFrame, flag: str) -> DataFrame:
    """``flag``, mean_score, n of scores inside and outside of a split."""
    return scores.groupBy(flag).agg(F.round(F.avg("score"), 6).alias("mean_score"), F.count(F.lit(1)).alias("n"))


def manifest(rows: DataFrame, source: str) -> DataFrame:
    """name, count of the rows of each source."""
    return rows.groupBy(F.col(source).alias("name")).agg(F.count(F.lit(1)).alias("count"))


def next_run(runs: DataFrame) -> DataFrame:
    """One row: the next number after the largest (``run``), 1 without any."""
    return runs.agg((F.coalesce(F.max("run"), F.lit(0)) + 1).cast("long").alias("run"))


def summary(results: DataFrame, metrics: tuple[str, ...] = ("hit_at_1",), category_metrics: tuple[str, ...] | None = None, digits: int = 2) -> DataFrame:
    """One row that sums up task results (task, category, the metrics, error): a summary document.

    num_tasks_completed counts all, num_tasks those with a score, by the first metric; means are of these. per_category is a
    map from each category to the means of ``category_metrics`` (all by default) and its number of tasks.
    """
    valid = F.col(metrics[0]).isNotNull()
    mean = lambda m: F.round(F.avg(F.when(valid, F.col(m))), digits)
    own = category_metrics or metrics
    each = results.where(valid).groupBy("category").agg(*[mean(m).alias(f"mean_{m}") for m in own], F.count(F.lit(1)).alias("num_tasks"))
    entry = F.struct("category", F.struct(*[f"mean_{m}" for m in own], "num_tasks"))
    by = each.agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("per_category"))  # a row for each category
    tasks = F.array_sort(F.collect_list(F.struct("task", "category", *metrics, "error"))).alias("tasks")  # a row for each task
    whole = results.agg(F.count(F.lit(1)).alias("num_tasks_completed"), F.count_if(valid).alias("num_tasks"), *[mean(m).alias(f"mean_{m}") for m in metrics], tasks)
    return whole.crossJoin(F.broadcast(by))  # one row each


def text_summary(subsets: DataFrame) -> DataFrame:
    """One row: num_tasks, mean_task, mean_type, per_type, per_task of subset scores (type, task, subset, score) from 0 to 1, in percent.

    mean_task is over all subsets' scores, as in the harness, and mean_type over the means of the types.
    """
    known = subsets.where(F.col("score").isNotNull())
    task = known.groupBy("task").agg(F.min("type").alias("type"), (100 * F.avg("score")).alias("score"), F.count(F.lit(1)).alias("num_subsets"))
    kind = known.groupBy("type").agg((100 * F.avg("score")).alias("score"))
    per_task = task.agg(F.count(F.lit(1)).alias("num_tasks"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("task", F.struct("type", F.round("score", 6).alias("score"), "num_subsets"))))).alias("per_task"))
    per_type = kind.agg(F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 6).alias("mean_type"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", F.round("score", 6).alias("score"))))).alias("per_type"))
    whole = known.agg(F.round(F.coalesce(100 * F.avg("score"), F.lit(0.0)), 6).alias("mean_task"))
    return per_task.crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(per_type)).select("num_tasks", "mean_task", "mean_type", "per_type", "per_task")  # one row each


def table_text(df: DataFrame, title: str, most: int = 200) -> str:
    """A small report as lines of text, with a title; at most ``most`` rows, which is a report's length."""
    rows = [df.columns] + [["" if x is None else f"{x:.2f}" if isinstance(x, float) else str(x) for x in r] for r in df.limit(most).collect()]
    width = [max(map(len, column)) for column in zip(*rows, strict=True)]
    line = lambda r: "  ".join(x.ljust(w) for x, w in zip(r, width, strict=True)).rstrip()
    return "\n".join([title, "=" * len(title), *map(line, rows)])
