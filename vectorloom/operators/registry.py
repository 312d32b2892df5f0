"""Registries of evaluation tasks as tables, and the choice of tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.operators.instructions import document_category

#: Tasks of each suite by category, and the short lists.
IMAGE_TASKS = {
    "classification": ("ImageNet-1K", "ImageNet-A", "ImageNet-R", "ObjectNet", "Country211", "SUN397", "Place365", "VOC2007", "N24News", "HatefulMemes"),
    "vqa": ("OK-VQA", "A-OKVQA", "DocVQA", "InfographicsVQA", "ChartQA", "Visual7W", "ScienceQA", "VizWiz", "GQA", "TextVQA"),
    "retrieval": ("MSCOCO_i2t", "MSCOCO_t2i", "VisualNews_i2t", "VisualNews_t2i", "VisDial", "CIRR", "NIGHTS", "WebQA", "FashionIQ", "Wiki-SS-NQ", "OVEN", "EDIS"),
    "grounding": ("MSCOCO", "RefCOCO", "RefCOCO-Matching", "Visual7W-Pointing"),
}
VIDEO_TASKS = {
    "video_cls": ("HMDB51", "UCF101", "Breakfast", "Kinetics-700", "SmthSmthV2"),
    "video_ret": ("MSR-VTT", "MSVD", "DiDeMo", "YouCook2", "VATEX"),
    "video_qa": ("NExTQA", "EgoSchema", "MVBench", "Video-MME", "ActivityNetQA"),
    "video_mret": ("QVHighlight", "Charades-STA", "MomentSeeker"),
}
#: Folders of videos that aren't called as their tasks are.
VIDEO_FOLDERS = {"Kinetics-700": "K700", "SmthSmthV2": "SSv2"}
VIDEO_QA = "Given a video and a question, select the most accurate answer from the provided candidates. Return only the exact text of your chosen answer."
VIDEO_CLIP = "Find the clip that corresponds to the described scene in the given video."
VIDEO_INSTRUCTIONS = {
    "HMDB51": "What actions or objects interactions are the person in the video doing?",
    "UCF101": "What activities or sports are being performed by the person in the video?",
    "Breakfast": "Recognize the breakfast type that the person is cooking in the video.",
    "Kinetics-700": "Recognize the category of the video content.",
    "SmthSmthV2": "What actions or object interactions are being performed by the person in the video?",
    "MSR-VTT": "Find a video that contains the following visual content.",
    "MSVD": "Find the video snippet that corresponds to the given summary.",
    "DiDeMo": "Find a video that includes the following described scenes.",
    "YouCook2": "Find a video that demonstrates the following action while making a recipe.",
    "VATEX": "Select a video that fits the description provided.",
    "QVHighlight": VIDEO_CLIP,
    "Charades-STA": VIDEO_CLIP,
    "MomentSeeker": "Find the clip that corresponds to the given text.",
}
DOCUMENT_TASKS = (
    "ViDoRe_arxivqa", "ViDoRe_docvqa", "ViDoRe_infovqa", "ViDoRe_tabfquad", "ViDoRe_tatdqa", "ViDoRe_shiftproject",
    "ViDoRe_syntheticDocQA_artificial_intelligence", "ViDoRe_syntheticDocQA_energy", "ViDoRe_syntheticDocQA_government_reports", "ViDoRe_syntheticDocQA_healthcare_industry",
    "ViDoRe_esg_reports_human_labeled_v2", "ViDoRe_biomedical_lectures_v2", "ViDoRe_biomedical_lectures_v2_multilingual",
    "ViDoRe_economics_reports_v2", "ViDoRe_economics_reports_v2_multilingual", "ViDoRe_esg_reports_v2", "ViDoRe_esg_reports_v2_multilingual",
    "VisRAG_ArxivQA", "VisRAG_ChartQA", "VisRAG_MP-DocVQA", "VisRAG_SlideVQA", "VisRAG_InfoVQA", "VisRAG_PlotQA",
    "ViDoSeek-page", "ViDoSeek-doc", "MMLongBench-doc", "MMLongBench-page",
)
ENGLISH_ONLY = ("ViDoRe_biomedical_lectures_v2", "ViDoRe_economics_reports_v2", "ViDoRe_esg_reports_v2")
TEXT_TASKS = (
    "BUCC.v2", "AmazonCounterfactualClassification", "ArXivHierarchicalClusteringP2P", "IFIRAila", "MultiEURLEXMultilabelClassification",
    "LegalBenchPC", "AskUbuntuDupQuestions", "AILACasedocs", "STSBenchmark",
)
QUICK = {
    "image": ("N24News", "OK-VQA", "MSCOCO_i2t", "RefCOCO"),
    "video": ("HMDB51", "MSR-VTT", "NExTQA", "QVHighlight"),
    "document": ("ViDoRe_arxivqa", "VisRAG_ChartQA", "ViDoSeek-page"),
    "text": TEXT_TASKS,
}
#: Parts of the action benchmark: name, folder of their videos, and what that holds.
ACTION_PARTS = (
    ("action_sequence", "star/Charades_v1_480/", "video"),
    ("action_prediction", "star/Charades_v1_480/", "video"),
    ("action_antonym", "ssv2_video/", "video"),
    ("fine_grained_action", "Moments_in_Time_Raw/videos/", "video"),
    ("unexpected_action", "FunQA_test/test/", "video"),
    ("object_existence", "clevrer/video_validation/", "video"),
    ("object_interaction", "star/Charades_v1_480/", "video"),
    ("object_shuffle", "perception/videos/", "video"),
    ("moving_direction", "clevrer/video_validation/", "video"),
    ("action_localization", "sta/sta_video/", "video"),
    ("scene_transition", "scene_qa/video/", "video"),
    ("action_count", "perception/videos/", "video"),
    ("moving_count", "clevrer/video_validation/", "video"),
    ("moving_attribute", "clevrer/video_validation/", "video"),
    ("state_change", "perception/videos/", "video"),
    ("fine_grained_pose", "nturgbd/", "video"),
    ("character_order", "perception/videos/", "video"),
    ("egocentric_navigation", "vlnqa/", "video"),
    ("episodic_reasoning", "tvqa/frames_fps3_hq/", "frame"),
    ("counterfactual_inference", "clevrer/video_validation/", "video"),
)


def tasks(spark: SparkSession) -> DataFrame:
    """place, suite, task, category, eval_type, parser, folder, instruction, active, quick of every task; place is its number from 0.

    Videos are ranked among all candidates (global) or among those of each query (local): global for retrieval and
    for classification but one task, as its labels are per query.
    """
    rows = [("image", t, c, "local", None, None, None, True) for c, ts in IMAGE_TASKS.items() for t in ts]
    rows += [
        ("video", t, c, "global" if c in ("video_cls", "video_ret") and t != "SmthSmthV2" else "local", None, f"{c}/{VIDEO_FOLDERS.get(t, t)}", VIDEO_INSTRUCTIONS.get(t, VIDEO_QA), True)
        for c, ts in VIDEO_TASKS.items()
        for t in ts
    ]
    rows += [("document", t, None, "global", "visrag" if t.startswith("VisRAG_") else "vidore", None, None, t not in ENGLISH_ONLY) for t in DOCUMENT_TASKS]
    rows += [("text", t, None, "global", None, None, None, True) for t in TEXT_TASKS]
    schema = "place int, suite string, task string, category string, eval_type string, parser string, folder string, instruction string, active boolean"
    quick = [F.when(F.col("suite") == s, F.col("task").isin(*names)) for s, names in QUICK.items()]
    return (
        spark.createDataFrame([(place, *r) for place, r in enumerate(rows)], schema)
        .withColumn("category", F.when(F.col("suite") == "document", document_category(F.col("task"))).otherwise(F.col("category")))
        .withColumn("quick", F.coalesce(*quick, F.lit(False)))
    )


def with_tasks(rows: DataFrame, by: str = "task") -> DataFrame:
    """``rows`` with what the registry says of their task, which they name by ``by`` (task or place); rows of no task go."""
    return rows.join(F.broadcast(tasks(rows.sparkSession)), by)  # 90 rows


def action_parts(spark: SparkSession) -> DataFrame:
    """subset, video_path, data_type of the action benchmark's parts."""
    return spark.createDataFrame(ACTION_PARTS, "subset string, video_path string, data_type string")


def with_action_parts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` (subset, video, ...) with their folder, and the rows of unknown parts, which are skipped."""
    known = F.broadcast(action_parts(rows.sparkSession))  # 20 rows
    return rows.join(known, "subset"), rows.join(known, "subset", "left_anti")


def select(registry: DataFrame, suite: str, names: Iterable[str] | None = None, quick: bool = False, full: bool = False) -> DataFrame:
    """The tasks to run: named ones go before the quick list, that before all active ones; without a word, the quick list."""
    own = registry.where(F.col("suite") == suite)
    if names:
        return own.where(F.col("task").isin(*names))
    return own.where("active") if full and not quick else own.where("quick")


def evaluate(registry: DataFrame, evaluators: dict[str, Callable[[str], DataFrame]]) -> DataFrame:
    """task, category, hit_at_1, n, error of every task of ``registry``, by the evaluator of its eval_type.

    An evaluator takes the task's name and gives qid, hit. A task that fails has its error, one without queries says so;
    neither stops the others.
    """
    spark, out = registry.sparkSession, []
    for r in registry.select("task", "category", "eval_type").orderBy("task").collect():  # a row for each task
        try:
            if r["eval_type"] not in evaluators:
                raise ValueError(f"Unknown category: {r['category']}")
            found = evaluators[r["eval_type"]](r["task"]).agg(F.avg("hit").alias("mean"), F.count(F.lit(1)).alias("n")).first()
            score = None if found["mean"] is None else round(100 * found["mean"], 2)
            out.append((r["task"], r["category"], score, found["n"], None if found["n"] else "No valid examples"))
        except Exception as error:  # any task's error
            out.append((r["task"], r["category"], None, 0, str(error)[:500]))
    return spark.createDataFrame(out, "task string, category string, hit_at_1 double, n long, error string")
