"""Instructions of queries and documents, from tables of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom.functions.text import DEFAULT_INSTRUCTION, strip

#: Tasks of the benchmark's subsets, and the texts of the instructions.
TASKS = {
    "classification": ("N24News", "HatefulMemes", "VOC2007", "SUN397", "ImageNet_1K"),
    "vqa": ("OK-VQA", "A-OKVQA", "DocVQA", "InfographicsVQA", "ChartQA", "Visual7W", "VisDial", "WebQA"),
    "retrieval": ("MSCOCO_i2t", "MSCOCO_t2i", "VisualNews_i2t", "VisualNews_t2i", "CIRR", "NIGHTS"),
    "grounding": ("MSCOCO",),
}
SUBSETS = tuple(s for group in TASKS.values() for s in group)
CLASSIFICATION = ("Represent the given image for classification.", "Classify this image into one of the categories.")
VQA = "Represent the given image with the following question."
TEXT_TO_IMAGE = "Find an image that matches the given caption."
IMAGE_TO_TEXT = "Represent the given image for retrieval."
GROUNDING = "Locate the described region in the image."
IMAGE_PAIR = "Find a similar image."
TEXT_RETRIEVAL = "Given a query, retrieve a relevant passage."
SEMANTIC_TEXT = "Retrieve semantically similar text."
DOCUMENT_PAGE = "Retrieve a document page relevant to the query."
VIDEO = "Represent the video with the following text for retrieval."
MOMENT_VIDEO = "Find the clip that corresponds to the given sentence and video segment."
MOMENT_IMAGE = "Select the video clip that aligns with the given text and image."

#: Subsets whose name alone settles the instruction; classification has two, by turns.
OF_SUBSET = {
    **dict.fromkeys(TASKS["vqa"], VQA),
    **{f"{s}_t2i": TEXT_TO_IMAGE for s in ("MSCOCO", "VisualNews")},
    **{f"{s}_i2t": IMAGE_TO_TEXT for s in ("MSCOCO", "VisualNews")},
    "MSCOCO": GROUNDING,
}
#: Other sources, as rows without an instruction name them.
OF_SOURCE = {
    "MegaPairs": IMAGE_PAIR,
    "ColPali": DOCUMENT_PAGE,
    **dict.fromkeys(("llava_hound", "msrvtt", "video_retrieval"), VIDEO),
    **dict.fromkeys(("msmarco", "gooaq"), TEXT_RETRIEVAL),
    **dict.fromkeys(("allnli", "quora"), SEMANTIC_TEXT),
}
#: Kinds of document tasks: what the name starts with, and whether it holds ``v2``.
DOCUMENT_KINDS = {("ViDoRe", False): "vidore_v1", ("ViDoRe", True): "vidore_v2", ("VisRAG", False): "visrag", ("VisRAG", True): "visrag"}


def lookup(table: dict[str, str], key: Column) -> Column:
    """The value of a key of a small table; null for others."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def task_type(subset: Column) -> Column:
    """The task of a subset; retrieval for unknown ones."""
    return F.coalesce(lookup({s: task for task, subsets in TASKS.items() for s in subsets}, subset), F.lit("retrieval"))


def bare_subset(name: Column) -> Column:
    return F.regexp_replace(F.coalesce(name, F.lit("")), "^mmeb_", "")


def alternate(index: Column) -> Column:
    return F.get(F.array(*map(F.lit, CLASSIFICATION)), F.pmod(index, F.lit(2)).cast("int"))


def of_subset(subset: Column, index: Column) -> Column:
    """What the name of a subset settles, else null."""
    return F.coalesce(lookup(OF_SUBSET, subset), F.when(subset.isin(*TASKS["classification"]), alternate(index)))


def has_media(path: Column) -> Column:
    """A path is given."""
    return F.coalesce(strip(path) != "", F.lit(False))


def benchmark_instruction(subset: Column, index: Column, query_image: Column, positive_image: Column) -> Column:
    """The query's instruction for a benchmark row: by its subset, else by which sides have an image."""
    sides = F.when(~has_media(query_image), TEXT_TO_IMAGE).when(has_media(positive_image), IMAGE_PAIR).otherwise(IMAGE_TO_TEXT)
    return F.coalesce(of_subset(subset, index), sides)


def _named(subset: Column, index: Column) -> Column:
    """For any of the benchmark's subsets without a look at its images; null for other names."""
    return F.when(subset.isin(*SUBSETS), F.coalesce(of_subset(subset, index), F.lit(TEXT_TO_IMAGE)))


def text_instruction(subset: Column) -> Column:
    return F.when(F.lower(F.coalesce(subset, F.lit(""))).isin("allnli", "quora"), SEMANTIC_TEXT).otherwise(TEXT_RETRIEVAL)


def mined_instruction(kind: Column, subset: Column, index: Column) -> Column:
    """The query's instruction for a mined row, by its task and the name of its source."""
    name = bare_subset(subset)
    by_task = F.when(kind == "classification", alternate(index)).when((kind == "vqa") & name.isin(*SUBSETS), VQA)
    return F.coalesce(by_task, _named(name, index), F.when(F.lower(name) == "colpali", DOCUMENT_PAGE), text_instruction(name))


def fallback_instruction(kind: Column, subset: Column, index: Column) -> Column:
    """For rows that came without an instruction."""
    return F.coalesce(F.when(kind == "sts", SEMANTIC_TEXT), lookup(OF_SOURCE, subset), _named(subset, index), F.lit(DEFAULT_INSTRUCTION))


def moment_instruction(query_media: Column, default: Column) -> Column:
    """For moment search, by the kind of the query's own media."""
    return F.coalesce(lookup({".mp4": MOMENT_VIDEO, ".jpg": MOMENT_IMAGE}, F.regexp_extract(F.coalesce(query_media, F.lit("")), r"(\.mp4|\.jpg)$", 1)), default)


def side_instruction(side: Column, query_rule: Column) -> Column:
    """Queries take the rule, documents and negatives the default."""
    return F.when(side == "query", query_rule).otherwise(F.lit(DEFAULT_INSTRUCTION))


def resolve_prompts(tasks: DataFrame, prompts: DataFrame) -> DataFrame:
    """``tasks`` (task, type, side, metadata_prompt) with instruction.

    ``prompts``: task, query_prompt, passage_prompt, symmetric; one row a task. The dictionary goes before the
    task's own prompt; then the rules of the task's type outrank both.
    """
    found = tasks.join(F.broadcast(prompts.withColumn("_known", F.lit(True))), "task", "left")  # a row for each task
    query = F.col("side") == "query"
    listed = F.when(F.col("symmetric") & ~query, F.coalesce("passage_prompt", F.lit(""))).otherwise(F.coalesce("query_prompt", F.lit("")))
    own = F.nullif(strip(F.col("metadata_prompt")), F.lit(""))
    text = F.when(F.col("_known"), listed).otherwise(own)
    retrieval = F.coalesce(F.contains("type", F.lit("Retrieval")), F.lit(False))
    rule = (
        F.when(retrieval & ~F.coalesce("symmetric", F.lit(False)) & ~query, F.lit(""))
        .when(F.col("type").isin("STS", "PairClassification"), "Retrieve semantically similar text")
        .when(F.col("type") == "BitextMining", "Retrieve parallel sentences")
        .when(retrieval & query & text.isNull(), "Retrieval relevant passage for the given query.")
        .otherwise(F.coalesce(text, F.lit("")))
    )
    return found.select(*tasks.columns, rule.alias("instruction"))


def document_category(task: Column) -> Column:
    """Category of a document task by its name."""
    key = F.concat(F.regexp_extract(task, "^([^_]*)_", 1), F.when(task.contains("v2"), "|v2").otherwise("|"))
    return F.coalesce(lookup({f"{start}|{'v2' if second else ''}": kind for (start, second), kind in DOCUMENT_KINDS.items()}, key), F.lit("vidoseek"))


def task_code(kind: Column) -> Column:
    """Number of a task in the vectors that workers exchange; unknown ones are retrieval."""
    return F.when(kind == "sts", 0).when(kind == "classification", 2).otherwise(1)


def task_of_code(code: Column) -> Column:
    return F.get(F.array(F.lit("sts"), F.lit("retrieval"), F.lit("classification")), code)


def encode_batch(task: Column, default: int) -> Column:
    """Items that a model encodes at a time; a few tasks of long texts take less."""
    return F.when(task.isin("STS22", "STS22.v2"), 16).otherwise(default)
