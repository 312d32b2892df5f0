"""Mixtures of sources under caps and budgets.

A mixture is a table of shares: a budget of rows that some sources split, or a cap that each of them has. It
becomes caps by source, and one pass numbers the rows of every source and cuts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vectorloom.functions.tables import ordinals
from vectorloom.operators.instructions import SUBSETS, TASKS


@dataclass(frozen=True)
class Share:
    """``rows`` for the sources together, split in their order, or for each of them; None is no cap."""

    sources: tuple[str, ...]
    rows: int | None = None
    each: bool = False


#: Families of the benchmark's subsets in the order in which they split a budget, and the budgets.
FAMILIES = {
    "retrieval": ("MSCOCO", "MSCOCO_i2t", "MSCOCO_t2i", "VisualNews_i2t", "VisualNews_t2i", "CIRR", "NIGHTS", "VisDial", "WebQA"),
    "vqa": ("OK-VQA", "DocVQA", "ChartQA", "Visual7W", "InfographicsVQA", "A-OKVQA"),
    "classification": TASKS["classification"],
}
MIXES: dict[str, tuple[Share, ...]] = {
    "stage1": (
        Share(("megapairs",), 1_500_000),
        Share(FAMILIES["retrieval"], 550_000),
        Share(FAMILIES["vqa"], 250_000),
        Share(FAMILIES["classification"], 300_000),
        Share(("msmarco",), 500_000),
        Share(("gooaq",), 500_000),
        Share(("allnli",), 300_000),
        Share(("quora",), 100_000),
        Share(("stsb",)),
        Share(("colpali",), 118_000),
        Share(("llava_hound",), 255_000),
    ),
    "stage1_v2": (
        Share(("megapairs",), 280_000),
        Share(FAMILIES["retrieval"] + FAMILIES["vqa"] + FAMILIES["classification"], 320_000),
        Share(("msmarco",), 130_000),
        Share(("gooaq",), 90_000),
        Share(("allnli",), 45_000),
        Share(("quora",), 19_251),
        Share(("stsb",)),
        Share(("colpali",), 35_000),
        Share(("llava_hound",), 80_000),
    ),
    "video": (Share(("msrvtt", "vatex"), 50_000, each=True),),
}
MINED_BUDGET, MINED_CLASSES = 180_000, "classification_hn"
MINED_CLASSES_CAP = 55_000


def stage1_v2(mined: tuple[str, ...] = ()) -> tuple[Share, ...]:
    """With the files of mined rows that aren't empty: the one of class labels has a cap, the others split a budget."""
    others = tuple(sorted(m for m in mined if m != MINED_CLASSES))
    return (
        MIXES["stage1_v2"]
        + (Share(others, MINED_BUDGET),) * bool(others)
        + (Share((MINED_CLASSES,), MINED_CLASSES_CAP),) * (MINED_CLASSES in mined)
    )


def stage2(mined: tuple[str, ...], cap: int | None = None) -> tuple[Share, ...]:
    """All mined rows, the classification subsets, and the pairs and triplets of sentences."""
    return (Share(tuple(sorted(mined)), cap, each=True), Share(TASKS["classification"], cap, each=True), Share(("allnli",), cap), Share(("stsb",)))


def all_subsets(cap: int | None = None, subsets: Iterable[str] | None = None, tasks: Iterable[str] | None = None) -> tuple[Share, ...]:
    """Every subset of the benchmark up to a cap; the list of subsets and then that of tasks leave out others."""
    allowed = None if tasks is None else {s for t in tasks for s in TASKS.get(t, ())}
    chosen = tuple(s for s in SUBSETS if (subsets is None or s in set(subsets)) and (allowed is None or s in allowed))
    return (Share(chosen, cap, each=True),)


def everything(cap: int | None = None, videos: tuple[str, ...] = ()) -> tuple[Share, ...]:
    """All sources up to a cap, but for videos and scored pairs, which are taken whole."""
    return (*all_subsets(cap), Share(("msmarco", "allnli", "gooaq", "quora"), cap, each=True), Share(("stsb",)), Share(("megapairs", "colpali"), cap, each=True), Share(("llava_hound", *sorted(videos))))


def split_budget(total: int, parts: int) -> list[int]:
    """``total`` in ``parts`` that differ by one at most, the larger ones first."""
    return [total // parts + (k < total % parts) for k in range(parts)]


def caps_of(shares: Iterable[Share], divisor: int = 1) -> list[tuple[str, int, int | None]]:
    """name, source_idx, cap of every source of a mixture; budgets are divided by ``divisor`` first, for small tables."""
    found: list[tuple[str, int, int | None]] = []
    for share in shares:
        n = len(share.sources)
        rows = None if share.rows is None else share.rows // divisor
        caps = [rows] * n if share.each or rows is None else split_budget(rows, n)
        found += [(name, len(found) + k, cap) for k, (name, cap) in enumerate(zip(share.sources, caps, strict=True))]
    return found


def mixture(rows: DataFrame, source: str, order: str, shares: Iterable[Share], divisor: int = 1) -> DataFrame:
    """The rows of a mixture with source_idx: of each of its sources the first by ``order`` up to its cap."""
    caps = rows.sparkSession.createDataFrame(caps_of(shares, divisor), "name string, source_idx int, cap long")
    return cap_rows(rows, source, order, caps).join(F.broadcast(caps.select(F.col("name").alias(source), "source_idx")), source)


def budgets(names: DataFrame, total: int) -> DataFrame:
    """name, cap: ``total`` split over the names in their order."""
    n = names.select("name").distinct()
    count = n.count()
    at = F.row_number().over(Window.orderBy("name")) - 1  # names of sources, a few
    return n.withColumn("_at", at).select("name", (F.floor(F.lit(total) / max(1, count)) + F.when(F.col("_at") < total % max(1, count), 1).otherwise(0)).cast("long").alias("cap"))


def cap_rows(rows: DataFrame, source: str, order: str, caps: DataFrame) -> DataFrame:
    """The first ``cap`` rows by ``order`` of each source of ``caps`` (name, cap); a cap that is null or 0 is none.

    Sources without a cap row are left out. Rows are numbered by a range sort, so a source of any size, and a cap of
    millions, is dealt to many tasks.
    """
    named = rows.join(F.broadcast(caps.select(F.col("name").alias(source), "cap")), source)  # a row for each source
    placed = ordinals(named, [order], by=source, name="_at")
    return placed.where((F.coalesce("cap", F.lit(0)) == 0) | (F.col("_at") < F.col("cap"))).drop("_at", "cap")


def seed_pool(rows: DataFrame, order: str, per_category: int, least_side: int = 256, most_ratio: float = 4.0, least_motion: float = 0.0, least_similarity: float = 0.2) -> DataFrame:
    """Media rows fit to be seeds, at most ``per_category`` of each category by ``order``.

    ``rows``: category, width, height, motion, broken, similarity. Small and very long pictures go, and so do broken files, segments
    that don't move, and pairs that aren't alike; a null motion or similarity isn't judged.
    """
    shape = (F.least("width", "height") >= least_side) & (F.greatest("width", "height") <= most_ratio * F.least("width", "height"))
    alive = ~F.coalesce("broken", F.lit(False)) & (F.coalesce(F.col("motion"), F.lit(least_motion + 1)) > least_motion)
    fit = rows.where(F.coalesce(shape, F.lit(False)) & alive & (F.coalesce("similarity", F.lit(least_similarity)) >= least_similarity))
    return ordinals(fit, [order], by="category", name="_at").where(F.col("_at") < per_category).drop("_at")


def with_teacher(rows: DataFrame, teacher: DataFrame, shares: Iterable[Share], source: str = "subset", order: str = "row_idx") -> DataFrame:
    """The distillation mixture: rows (subset, row_idx, ...) up to their caps with the teacher's vectors, without which a row raises."""
    from vectorloom.sources.readers import teacher_vectors

    return teacher_vectors(mixture(rows, source, order, shares), teacher)


def mix(parts: Iterable[tuple[str, Callable[[], DataFrame]]], on_skip: Callable[[str, Exception], None] = lambda name, error: None) -> DataFrame:
    """Union of the sources that load, with source and source_idx; one that fails is skipped, all that fail raise."""
    loaded = []
    for k, (name, load) in enumerate(parts):
        try:
            loaded.append(load().withColumn("source_name", F.lit(name)).withColumn("source_idx", F.lit(k)))
        except Exception as error:  # any reader's error
            on_skip(name, error)
    if not loaded:
        raise ValueError("no source could be loaded")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), loaded)
