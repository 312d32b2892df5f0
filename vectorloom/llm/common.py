"""Shared helpers: let-bindings in column expressions, ids that pass through pandas unharmed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.functions.cluster import ship
from vectorloom.functions.tables import delete, materialise, new_path, scratch, shared_dir

__all__ = ["BLANKS", "WORD", "delete", "hide_nulls", "let", "materialise", "new_path", "own_columns", "parts_of", "scratch", "shared_dir", "ship", "show_nulls", "table"]

#: The white space of the contracts: space and the controls 0x09 to 0x0D.
BLANKS = " \t\n\x0b\f\r"
#: A word is a maximal run of other characters.
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for each row, also where ``body`` uses it in a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own_columns(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns of any name can't clash with an operator's own."""
    return docs.select(*[F.col(f"`{n}`") for n in names])


def hide_nulls(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with 0 for null in the named columns of longs, and a flag for each.

    pandas holds a column of integers with one null as doubles, which rounds ids over 2**53.
    """
    return df.select("*", *[F.col(n).isNull().alias(f"_null_{n}") for n in names]).withColumns({n: F.coalesce(F.col(n).cast("long"), F.lit(0).cast("long")) for n in names})


def show_nulls(df: DataFrame, *names: str) -> DataFrame:
    """The reverse of ``hide_nulls``."""
    return df.withColumns({n: F.when(~F.col(f"_null_{n}"), F.col(n)) for n in names}).drop(*[f"_null_{n}" for n in names])


def parts_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
