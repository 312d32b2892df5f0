"""Line deduplication across documents, in DataFrame functions only.

Normalised lines are exploded and hashed (128 bits), the documents of each hash are counted, lines over the
threshold are dropped except in the largest doc_id, and the rest is put together again by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.common import BLANKS, let, materialise, own_columns

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line stripped of blanks at both ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(BLANKS))
    # lower() is the same for ASCII, and much faster
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _places(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, text_hash, pos and the two hashes of every line long enough to be dropped."""

    def hashed(x: Column, i: Column) -> Column:
        key = line_key(x)
        return let(key, lambda k: F.struct(i.alias("pos"), F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2")))

    long = F.filter(
        F.transform(_split(F.col("text")), lambda x, i: F.when(F.length(F.btrim(x, F.lit(BLANKS))) >= min_chars, hashed(x, i))),
        lambda x: x.isNotNull(),
    )
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.explode(long).alias("x")).select(
        "doc_id", "text_hash", "x.pos", "x.h1", "x.h2"
    )


def frequent_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """h1, h2, owner of each key of at least ``min_chars`` that at least ``min_docs`` documents hold; owner is the largest doc_id.

    A hash is counted once for each document, however many rows and lines the document has. (hash, document) is
    the key of the first shuffle, so a line that a third of all documents hold is dealt to all tasks, and the
    counts are summed partly before the second.
    """
    once = _places(docs, min_chars).select("h1", "h2", "doc_id").distinct()
    return once.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("owner")).where(F.col("n") >= min_docs).select("h1", "h2", "owner")


def drop_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, broadcast_rows: int = 200_000) -> DataFrame:
    """``docs`` with n_lines, n_dropped (long) and kept_text added.

    A null or empty text is one empty line. Rows of the same doc_id are one document: they count once, and
    every row of the largest doc_id keeps the line. All rows without a doc_id count as one document, which is
    less than any other. A text of which all lines go becomes empty. Other columns stay as they are, but for
    such as are named like the three that are added, which these replace.

    Frequent lines are broadcast if there are at most ``broadcast_rows`` of them (24 bytes each); beyond that
    they are joined by a shuffle of fixed-size rows, whose hot keys the adaptive planner can split.
    """
    bare = own_columns(docs, "doc_id", "text")
    frequent = materialise(frequent_lines(bare, min_chars, min_docs), "lines")
    if frequent.limit(broadcast_rows + 1).count() <= broadcast_rows:
        frequent = F.broadcast(frequent)
    gone = (
        _places(bare, min_chars)
        .join(frequent, ["h1", "h2"])
        .where(~F.col("doc_id").eqNullSafe(F.col("owner")))
        .groupBy(F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_hash"))
        .agg(F.collect_set("pos").alias("_gone"))
    )
    found = docs.join(
        gone.hint("shuffle_hash"),
        docs["doc_id"].eqNullSafe(gone["_gone_id"]) & (F.xxhash64(docs["text"]) == gone["_gone_hash"]),
        "left",
    )
    made = ("n_lines", "n_dropped", "kept_text")
    return found.select(
        *[docs[f"`{c}`"] for c in docs.columns if c not in made],
        F.size(_split(docs["text"])).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone["_gone"]), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(gone["_gone"].isNull(), F.coalesce(docs["text"], F.lit(""))).otherwise(_rest(docs["text"], gone["_gone"])).alias("kept_text"),
    )


def _rest(text: Column, gone: Column) -> Column:
    """The lines at the other positions; array_except looks positions up by hash, so long texts stay linear."""
    return let(
        _split(text),
        lambda lines: F.array_join(
            F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda i: F.get(lines, i)), "\n"
        ),
    )


def without_frequent_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """The rows and columns of ``docs`` with the text that is left, and n_chars, if there is one, counted anew."""
    found = drop_lines(docs, min_chars, min_docs)
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return found.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])
