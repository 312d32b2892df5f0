"""Scans of sources that a catalogue lists by repository, configuration and split.

Every source is a branch of one union with its three names as literals. A filter on these is folded by the optimiser, so that
branches which can't match vanish from the plan with their files; other filters and columns reach each scan.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

CATALOGUE = "name string, repo string, config string, split string, format string, filter string"
NAMES = ("repo", "config", "split")
FORMATS = ("parquet", "json", "orc", "csv", "text")


def folder_of(root: str, source: Row) -> str:
    """``root``/repo/config/split; a source without a configuration or split has none of these folders."""
    return posixpath.join(root, *[source[n] for n in NAMES if source[n]])


def scan(spark: SparkSession, catalogue: DataFrame, root: str, names: Iterable[str] | None = None, schemas: dict[str, str] | None = None) -> DataFrame:
    """Rows of all sources of ``catalogue`` (see ``CATALOGUE``), or of those with some names, as one table.

    Its columns are name, repo, config, split and those of all sources; a column that a source lacks is null there. A source's
    filter is a condition in SQL. ``schemas`` gives columns by name for formats that don't know theirs. A name that
    isn't listed, a format that isn't known and columns called like the four raise. The catalogue has a row for
    each source, which the driver reads.
    """
    listed = catalogue.orderBy("name", *NAMES).collect()
    wanted = {*names} if names is not None else {r["name"] for r in listed}
    if missing := wanted - {r["name"] for r in listed}:
        raise ValueError(f"sources that aren't listed: {sorted(missing)}")
    found: DataFrame | None = None
    for r in listed:
        if r["name"] not in wanted:
            continue
        if r["format"] not in FORMATS:
            raise ValueError(f"{r['name']} has the format {r['format']}, which isn't one of {FORMATS}")
        reader = spark.read.format(r["format"])
        if schemas and r["name"] in schemas:
            reader = reader.schema(schemas[r["name"]])
        rows = reader.load(folder_of(root, r))
        if clash := {"name", *NAMES} & {*rows.columns}:
            raise ValueError(f"{r['name']} has columns called {sorted(clash)}")
        if r["filter"]:
            rows = rows.where(r["filter"])
        one = rows.select(*[F.lit(r[n]).cast("string").alias(n) for n in ("name", *NAMES)], *[F.col(f"`{c}`") for c in rows.columns])
        found = one if found is None else found.unionByName(one, allowMissingColumns=True)
    return found if found is not None else spark.createDataFrame([], "name string, repo string, config string, split string")


def inventory(scanned: DataFrame, column: str) -> DataFrame:
    """name, repo, config, split, n, n_filled of each source that has rows."""
    return scanned.groupBy("name", *NAMES).agg(F.count(F.lit(1)).alias("n"), F.count(column).alias("n_filled"))
