"""Chat formatting of reply trees, in DataFrame functions only.

Messages form trees by their parents. Root-to-leaf paths are enumerated by iterative self-joins: each leaf starts
with itself, and in round k every ancestor found so far adds the one 2**k steps above it, so a path of n
messages takes log2(n) rounds of joins on rows of fixed size. Branches are ranked by score in each tree,
and each chosen path is formatted as one conversation with a loss mask over the assistants' texts.

Template: a turn is ``<s>[role] text</s>`` and a newline. In roles and texts ``&``, ``<``, ``[`` and ``]`` are escaped
(``&amp;``, ``&lt;``, ``&#91;``, ``&#93;``), so no text can hold a control string and every conversation can be parsed back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vectorloom.llm.common import materialise, own_columns

START, BETWEEN, END = "<s>[", "] ", "</s>\n"
#: In this order; read back in the reverse one.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("]", "&#93;"))


def escape(text: Column) -> Column:
    for raw, safe in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def ancestors(nodes: DataFrame) -> DataFrame:
    """tree, leaf, node, up: every message on the path of every leaf, ``up`` steps above it.

    ``nodes``: tree, node, parent. Rows of the same message count once, with the least parent. A parent that isn't
    a message of the tree counts as none, so its children are roots. Messages of a cycle, and such as hang below
    one, have no root; no path leads through them. Rounds end when no jump is left, or when a jump is longer
    than the largest tree, which only cycles give; each is cut by a written table, so a lost executor costs one
    round.
    """
    nodes = nodes.groupBy("tree", "node").agg(F.min("parent").alias("parent"))
    known = nodes.select("tree", F.col("node").alias("parent"))
    jump = materialise(nodes.where(F.col("parent").isNotNull()).join(known, ["tree", "parent"], "left_semi").select("tree", "node", F.col("parent").alias("to")), "jump")
    most = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    jumps = []
    while (1 << len(jumps)) <= most and not jump.isEmpty():
        jumps.append(jump)
        on = jump.select("tree", F.col("node").alias("to"), F.col("to").alias("_next"))
        jump = materialise(jump.join(on, ["tree", "to"]).select("tree", "node", F.col("_next").alias("to")), "jump")
    inner = jumps[0].select("tree", F.col("to").alias("node")).distinct() if jumps else known.limit(0).withColumnRenamed("parent", "node")
    leaves = nodes.select("tree", "node").join(inner, ["tree", "node"], "left_anti").join(jump.select("tree", "node"), ["tree", "node"], "left_anti")
    found = materialise(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).alias("up")), "paths")
    for k, jump in enumerate(jumps):
        higher = found.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("to").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        found = materialise(found.unionByName(higher), "paths")
    return found


def format_paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """One row for each chosen path: tree, leaf, rank, score, n_turns, formatted, loss_spans.

    ``messages``: tree, node, parent, role, text, score. The ``best`` branches of each tree are chosen by the
    mean score of their messages (null: 0) to twelve places, ties by the smaller leaf. Null roles and texts are
    empty. Rows of the same message count once, with the least pair of role and text and the least score. Branches are
    ranked on rows of fixed size; messages then meet the chosen branches in a semi-join before they are grouped, so
    where branches are few and the messages many, a broadcast or Spark's runtime filter keeps the other texts where they are.
    loss_spans: start and length, in code points from 0, of each assistant text in ``formatted``.
    """
    paths = ancestors(messages.select("tree", "node", "parent"))
    scored = paths.join(messages.groupBy("tree", "node").agg(F.min("score").alias("score")), ["tree", "node"])
    ranked = (
        scored.groupBy("tree", "leaf")
        .agg(F.round(F.avg(F.coalesce("score", F.lit(0.0))), 12).alias("path_score"))
        .withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("path_score"), "leaf")))
        .where(F.col("rank") <= best)
    )
    turn = F.struct(
        (-F.col("up")).alias("at"),
        (F.col("said.role") == "assistant").alias("learned"),
        F.concat(F.lit(START), escape(F.col("said.role")), F.lit(BETWEEN)).alias("head"),
        escape(F.col("said.text")).alias("body"),
    )
    chosen = materialise(paths.join(ranked, ["tree", "leaf"]), "chosen")
    said = F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    once = messages.join(chosen.select("tree", "node"), ["tree", "node"], "left_semi").groupBy("tree", "node").agg(F.min(said).alias("said"))
    joined = chosen.join(once, ["tree", "node"]).groupBy("tree", "leaf", "rank", "path_score").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    zero = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def add(state: Column, x: Column) -> Column:
        start, size = state["end"] + F.length(x["head"]), F.length(x["body"])
        span = F.array(F.struct(start.alias("start"), size.alias("length")))
        return F.struct((start + size + len(END)).alias("end"), F.when(x["learned"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return joined.select(
        "tree",
        "leaf",
        "rank",
        F.col("path_score").alias("score"),
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "").alias("formatted"),
        F.aggregate("turns", zero, add)["spans"].alias("loss_spans"),
    )


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    turns = F.filter(F.split(formatted, "</s>\n", -1), lambda x: x != "")

    def turn(x: Column) -> Column:
        bare = F.substring(x, F.lit(len(START) + 1), F.length(x))
        at = F.instr(bare, BETWEEN)
        return F.struct(
            unescape(F.substring(bare, F.lit(1), at - 1)).alias("role"),
            unescape(F.substring(bare, at + len(BETWEEN), F.length(bare))).alias("text"),
        )

    return F.transform(turns, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def messages_of(turns: DataFrame) -> DataFrame:
    """The messages of a table of conversations by turn: each answers the one before.

    Rows are ordered by turn, then role and text, nulls first, and numbered; so repeated turns follow one
    another and none is lost. Rows with a null conv_id form one conversation without an id.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return (
        own_columns(turns, "conv_id", "turn", "role", "text")
        .withColumn("node", F.row_number().over(order).cast("long"))
        .select(
            F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("tree"),
            "node",
            F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
            "role",
            "text",
            F.lit(0.0).alias("score"),
        )
    )


def digests(paths: DataFrame) -> DataFrame:
    """What can be read back from each formatted conversation."""
    turns = parse(F.col("formatted"))
    text = loss_text(F.col("formatted"), F.col("loss_spans"))
    read = paths.select("tree", "leaf", "formatted", turns.alias("turns"), text.alias("loss"))
    return read.select(
        F.when(F.col("tree") != "", F.col("tree")).cast("long").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
