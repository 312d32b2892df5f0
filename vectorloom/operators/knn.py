"""Exact search for the largest inner products.

Queries and corpus are cut into tiles of a bounded size, and the grid of their pairs is dealt out by one shuffle. A cell
of the grid multiplies its two matrices and keeps ``k`` rows a query; the states of a query's cells merge by rank. So
no row goes to the driver, it is one job however many tiles there are, no pair of rows is ever a row of a table, and
memory is bounded by two tiles. Rows are ranked by (score descending, id).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vectorloom.functions.cluster import ship
from vectorloom.functions.tables import new_path

#: Bytes of the vectors of a tile of queries and of one of the corpus, and scores that are held at once.
QUERY_BYTES, CORPUS_BYTES, SCORES = 16 << 20, 32 << 20, 1 << 23
#: Candidates that are scored anew at a time, and scores of a group of columns, of which the largest is taken first.
STEP, GROUP = 1 << 14, 64
#: Most parts of the shuffle; beyond them a part has several cells, which are held together.
MOST_PARTS = 100_000
#: Groups that values of ``within`` are dealt to.
GROUPS = 64


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The rows of a column of lists of as many doubles each."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def query_blocks(queries: DataFrame, key: str, most_bytes: int) -> Iterator[pa.Table]:
    """The rows of ``queries`` (``key``, v, ...) in blocks of about ``most_bytes`` of vectors, each collected when it is asked for."""
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    blocks = max(1, -(-size["n"] * (size["d"] or 0) * 8 // most_bytes))
    if blocks == 1:
        own = queries.toArrow()
        if own.num_rows:
            yield own
        return
    path = new_path(queries.sparkSession, "blocks")
    dealt = queries.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks)))
    dealt.write.partitionBy("_block").parquet(path)
    stored = queries.sparkSession.read.schema(dealt.schema).parquet(path)
    for b in range(blocks):
        own = stored.where(F.col("_block") == b).drop("_block").toArrow()
        if own.num_rows:
            yield own


def _best(frame: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("qid").orderBy(F.desc("score"), "cid")
    return frame.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("qid", "rank", "cid", "score")


def topk(queries: DataFrame, corpus: DataFrame, k: int, exclude_self: bool = False, within: str | None = None) -> DataFrame:
    """qid, rank (from 1), cid, score: the ``k`` corpus rows of each query.

    ``queries``: qid, v; ``corpus``: cid, v; ids are longs and keys, null and zero vectors take no part. exclude_self
    leaves out cid = qid. With ``within``, a column of both tables, only rows with an equal value compete. A query
    with fewer rivals than ``k`` has fewer rows.

    Each query tile is sent once for each corpus tile and the reverse, so a shuffle of ``q`` and ``c`` bytes in tiles of ``a``
    and ``b`` bytes moves ``q * c * (1 / a + 1 / b)``, with no more than one copy of the corpus where the queries fit in one tile.
    """
    ok = F.exists("v", lambda x: x != 0)
    own = [within] if within else []
    queries = queries.select(F.col("qid").cast("long"), F.col("v").cast("array<double>").alias("v"), *own)
    corpus = corpus.select(F.col("cid").cast("long"), F.col("v").cast("array<double>").alias("v"), *own)
    spark = queries.sparkSession
    ship(spark)
    # values of ``within`` are dealt to groups, and each group has a grid of its own: rows of others can't be near; a null is near nothing
    group = F.pmod(F.xxhash64(within), F.lit(GROUPS)).cast("int") if within else F.lit(0)
    if within:
        queries, corpus = (x.where(F.col(within).isNotNull()) for x in (queries, corpus))
    # all sizes by one job: rows and length of vectors of each group
    sizes = [x.groupBy(group.alias("group")).agg(F.lit(side).alias("side"), F.count(F.lit(1)).alias("n"), length.alias("d")) for side, x, length in (("q", queries, F.lit(0)), ("c", corpus, F.coalesce(F.max(F.size("v")), F.lit(0))))]
    size = {(r["side"], r["group"]): r for r in sizes[0].unionByName(sizes[1]).collect()}
    row_bytes = 8 * max([1, *(r["d"] for r in size.values())])
    rows_of = lambda side, g: size[side, g]["n"] if (side, g) in size else 0
    tiles = [-(-rows_of("q", g) * row_bytes // QUERY_BYTES) for g in range(GROUPS if within else 1)]
    # where few tiles hold all queries, the corpus is still cut so that all cores have some
    least = -(-spark.sparkContext.defaultParallelism // max(1, sum(tiles)))
    parts = [max(least, -(-rows_of("c", g) * row_bytes // CORPUS_BYTES)) if rows_of("c", g) and tiles[g] else 0 for g in range(len(tiles))]
    starts = [0, *accumulate(t * p for t, p in zip(tiles, parts, strict=True))]
    cells = max(1, starts.pop())
    of = lambda numbers: F.get(F.lit(numbers), F.col("_group"))

    def dealt(rows: DataFrame, key: str, mine: str, number: list[int], other: str, copies: list[int]) -> DataFrame:
        # by id and vector, so that the place is the same whenever a task runs again
        placed = rows.where(ok).withColumn("_group", group).where(of(parts) > 0).withColumn(mine, F.pmod(F.xxhash64(key, "v"), of(number)).cast("int"))
        cell = placed.select("*", F.explode(F.sequence(F.lit(0), of(copies) - 1)).alias(other)).select(key, "v", *own, (of(starts) + F.col("_tile") * of(parts) + F.col("_part")).alias("cell"))
        # the groups are of the very column that deals the rows, so no second shuffle follows
        return cell.withColumn("at", (F.col("cell") % MOST_PARTS).cast("int")).repartitionById(min(cells, MOST_PARTS), F.col("at"))

    q = dealt(queries, "qid", "_tile", tiles, "_part", parts)
    c = dealt(corpus, "cid", "_part", parts, "_tile", tiles)

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        if cells <= MOST_PARTS:
            return nearest(q, c, k, exclude_self, within)
        found = []  # a part of several cells; a query tile meets each of its corpus tiles in one of them
        for cell in pc.unique(q["cell"]).to_pylist():
            found.append(nearest(q.filter(pc.equal(q["cell"], cell)), c.filter(pc.equal(c["cell"], cell)), k, exclude_self, within))
        return pa.concat_tables(found) if found else nearest(q, c, k, exclude_self, within)

    return _best(q.groupBy("at").cogroup(c.groupBy("at")).applyInArrow(run, "qid long, cid long, score double"), k)


def nearest(queries: pa.Table, corpus: pa.Table, k: int, exclude_self: bool = False, within: str | None = None) -> pa.Table:
    """qid, cid, score of the ``k`` nearest rows of one tile for each query of another.

    The product of the matrices, in single precision, tells candidates: the ``k``-th of the largest scores of groups of columns
    is no more than the ``k``-th score, so only scores within rounding of it or above count, and only groups that have one are looked
    into. Candidates are scored anew, summed alike for equal vectors whatever their place, so that ties are broken by id alone.
    """
    schema = pa.schema([("qid", pa.int64()), ("cid", pa.int64()), ("score", pa.float64())])
    if not queries.num_rows or not corpus.num_rows:
        return schema.empty_table()
    qid, q = queries["qid"].to_numpy(), matrix(queries["v"])
    cid, x = corpus["cid"].to_numpy(), matrix(corpus["v"])
    if within:
        both = pa.concat_arrays([t[within].combine_chunks() for t in (queries, corpus)]).dictionary_encode().indices
        group = pc.fill_null(both, -1).to_numpy(zero_copy_only=False)
        group, rival = group[: len(q)], group[len(q) :]
    n, (rows, d) = min(k, len(x)), x.shape
    # of a size that neither overflows nor vanishes in single precision
    own, other = scaled(q, 1), scaled(x, None)
    kind = np.float32
    if not (np.isfinite(own).all() and np.isfinite(other).all()):  # numbers that aren't finite have no scale
        own, other, kind = q, x, np.float64
    slack = 8 * np.finfo(kind).eps * d * np.sqrt(np.einsum("ij,ij->i", own, own)) * np.sqrt(np.einsum("ij,ij->i", other, other).max())
    width = max(1, min(GROUP, rows // (4 * n)))
    groups = -(-rows // width)
    columns = np.zeros((d, groups * width), kind)
    columns[:, :rows] = other.T
    own, by, step = own.astype(kind), np.argsort(cid), max(1, SCORES // rows)
    room = np.empty((min(step, len(q)), groups * width), kind)
    lone = exclude_self and bool((np.diff(cid[by]) > 0).all())
    out = []
    for a in range(0, len(q), step):
        scores = np.matmul(own[a : a + step], columns, out=room[: len(own[a : a + step])])
        scores[:, rows:] = -np.inf
        if kind is np.float64:
            scores[np.isnan(scores)] = -np.inf
        if lone:
            at = by[np.minimum(np.searchsorted(cid, qid[a : a + step], sorter=by), rows - 1)]
            held = np.flatnonzero(cid[at] == qid[a : a + step])
            scores[held, at[held]] = -np.inf
        elif exclude_self:
            scores[:, :rows][qid[a : a + step, None] == cid] = -np.inf
        if within:
            scores[:, :rows][(group[a : a + step, None] != rival) | (group[a : a + step, None] < 0)] = -np.inf
        scores = scores.reshape(len(scores), width, groups)
        most = scores.max(1)
        least = np.partition(most, groups - n, 1)[:, groups - n] - slack[a : a + step]
        least[np.isnan(least)] = -np.inf
        at, near = np.nonzero((most >= least[:, None]) & (most > -np.inf))
        some = scores[at, :, near]
        row, column = np.nonzero((some >= least[at, None]) & (some > -np.inf))
        at, near = at[row], near[row] + column * groups
        exact = np.concatenate([(x[near[b : b + STEP]] * q[a + at[b : b + STEP]]).sum(1) for b in range(0, len(at), STEP)] or [np.empty(0)])
        order = np.lexsort((cid[near], -exact, at))
        at, near, exact = at[order], near[order], exact[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        kept = place < k
        out.append(pa.table([qid[a + at[kept]], cid[near[kept]], exact[kept]], schema=schema))
    return pa.concat_tables(out)


def scaled(rows: np.ndarray, axis: int | None) -> np.ndarray:
    """Each row, or all, by a factor that makes the largest component 1."""
    most = np.abs(rows).max(axis=axis, keepdims=True)
    return rows / np.where(most > 0, most, 1)
