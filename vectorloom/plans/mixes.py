"""Queries of the training mixtures, on events that stand for rows of the sources, with budgets divided to fit small tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.operators import mixing
from vectorloom.operators.mixing import Share
from vectorloom.plans.catalogue import register
from vectorloom.plans.fixtures import load

DIVISOR = 5_000
MINED = ("mined_b", "mined_a", "mined_c", mixing.MINED_CLASSES)
VIDEOS = ("msrvtt", "vatex")
TEXTS = ("megapairs", "msmarco", "gooaq", "allnli", "quora", "stsb", "colpali", "llava_hound")
#: Event n stands for a row of the source n modulo their number; the last one is in no mixture.
SOURCES = (*mixing.SUBSETS, *TEXTS, *MINED, *VIDEOS, "unknown")


def source_rows(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, SOURCES))
    return load(spark, d, "events").select("event_id", F.get(names, (F.col("event_id") % len(SOURCES)).cast("int")).alias("name"))


def sql_mixture(shares: Iterable[Share], divisor: int = 1) -> str:
    """The mixture in SQL: budgets are split and rows numbered there."""
    lines, k = [], 0
    for share in shares:
        for at, name in enumerate(share.sources):
            n = 1 if share.each else len(share.sources)
            lines.append(f"('{name}', {k}, {0 if share.each else at}, {n}, {'NULL' if share.rows is None else share.rows}::BIGINT)")
            k += 1
    return f"""
        WITH x AS (SELECT event_id, {list(SOURCES)}[event_id % {len(SOURCES)} + 1] AS name FROM events),
        s(name, source_idx, place, n, budget) AS (VALUES {', '.join(lines)}),
        c AS (SELECT name, source_idx::INT AS source_idx, (budget // {divisor}) // n + (place < (budget // {divisor}) % n)::INT AS cap FROM s),
        r AS (SELECT event_id, name, row_number() OVER (PARTITION BY name ORDER BY event_id) AS nth FROM x)
        SELECT event_id, r.name, source_idx FROM r JOIN c ON c.name = r.name WHERE cap IS NULL OR nth <= cap
    """


def _register(name: str, shares: tuple[Share, ...], divisor: int = 1) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return mixing.mixture(source_rows(spark, d), "name", "event_id", shares, divisor).select("event_id", "name", "source_idx")

    register(name, run, sql_mixture(shares, divisor))


_register("mix_all_subsets", mixing.all_subsets(50))
_register("mix_allowed_subsets", mixing.all_subsets(None, subsets=("MSCOCO", "CIRR", "OK-VQA", "VOC2007"), tasks=("retrieval", "vqa")))
_register("mix_everything", mixing.everything(100, VIDEOS))
_register("mix_stage1", mixing.MIXES["stage1"], DIVISOR)
_register("mix_stage1_v2", mixing.stage1_v2(MINED), DIVISOR)
_register("mix_stage2", mixing.stage2(MINED, 70))
_register("mix_video", mixing.MIXES["video"], DIVISOR)


def mix_distillation(spark: SparkSession, d: str) -> DataFrame:
    """Labels stand for subsets; the teacher's vectors are the rows' own, reversed."""
    e = load(spark, d, "embeddings").select((F.col("label") % 4).alias("l"), F.col("vec_id").alias("row_idx"), F.col("embedding").cast("array<float>").alias("v"))
    names = F.array(*map(F.lit, mixing.SUBSETS[:4]))
    rows = e.select(F.get(names, F.col("l").cast("int")).alias("subset"), "row_idx", "v")
    teacher = rows.select("subset", "row_idx", F.col("v").alias("q"), F.reverse("v").alias("p"))
    found = mixing.with_teacher(rows.drop("v"), teacher, mixing.all_subsets(60))
    return found.select("subset", "row_idx", "source_idx", F.round(F.get("teacher_q", F.lit(0)).cast("double"), 6).alias("q0"), F.round(F.get("teacher_p", F.lit(0)).cast("double"), 6).alias("p0"))


register(
    "mix_distillation",
    mix_distillation,
    f"""WITH e AS (SELECT {list(mixing.SUBSETS[:4])}[label % 4 + 1] AS subset, label % 4 AS source_idx, vec_id AS row_idx, embedding::DOUBLE[] AS v FROM embeddings)
        SELECT subset, row_idx, source_idx::INT AS source_idx, round(v[1], 6) AS q0, round(v[len(v)], 6) AS p0
        FROM e QUALIFY row_number() OVER (PARTITION BY subset ORDER BY row_idx) <= 60""",
)


def seed_pool(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events")
    k = F.col("event_id")
    rows = e.select("event_id", F.col("event_type").alias("category"), (k * 37 % 900 + 100).alias("width"), (k * 53 % 700 + 100).alias("height"), F.when(k % 4 > 0, (k % 5).cast("double")).alias("motion"), (k % 13 == 0).alias("broken"), F.when(k % 3 > 0, (k % 10) / 10.0).alias("similarity"))
    return mixing.seed_pool(rows, "event_id", 100).select("event_id", "category")


register(
    "seed_pool",
    seed_pool,
    """WITH r AS (SELECT event_id, event_type AS category, event_id * 37 % 900 + 100 AS w, event_id * 53 % 700 + 100 AS h FROM events)
        SELECT event_id, category FROM r WHERE least(w, h) >= 256 AND greatest(w, h) <= 4 * least(w, h) AND event_id % 13 <> 0 AND (event_id % 4 = 0 OR event_id % 5 > 0) AND (event_id % 3 = 0 OR event_id % 10 >= 2)
        QUALIFY row_number() OVER (PARTITION BY category ORDER BY event_id) <= 100""",
)
