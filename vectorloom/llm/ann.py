"""Approximate search for the largest inner products by score-aware quantisation.

A vector is split into subspaces with 16 centroids each (four bits). Centroids and codes minimise an anisotropic
loss: the part of the residual parallel to the vector, which shifts its inner products with the queries that
matter, weighs more than the part at right angles. A scan adds up table entries, two codes a byte; what it finds
best in a block of rows is ranked again by exact inner products in double precision.

The index stays where it is: a bounded block of queries is broadcast to the tasks that hold it, each task keeps its
``k`` best rows a query, and only those are shuffled. No vector of the index is copied or sent.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vectorloom.llm.common import materialise, ship
from vectorloom.operators.knn import matrix, query_blocks


@dataclass(frozen=True)
class Plan:
    #: Rows that the codebooks are fitted on, those with the least hash of their id; every row is indexed.
    sample: int = 20_000
    #: Components of a subspace.
    width: int = 2
    #: Cosine of the queries that matter; sets the weight of the parallel residual.
    threshold: float = 0.2
    rounds: int = 6
    #: Share of the rows of a block that are ranked exactly for each query, and how many times ``k`` at least.
    rerank: float = 0.02
    least: int = 4
    #: Beyond those, all within so many standard deviations of the scan's error are ranked too.
    margin: float = 2.0
    #: Rows that are scanned together, rows of a task at most, and at least where there are idle cores.
    block: int = 8_192
    task: int = 65_536
    small_task: int = 2_048
    #: Bytes of the vectors of a block of queries, which is broadcast.
    query_bytes: int = 16 << 20
    #: Rows up to which a table of crowded vectors is broadcast.
    broadcast_rows: int = 200_000


class Quantiser:
    """Codebooks of shape (subspaces, 16, width); vectors are padded with zeros to whole subspaces."""

    def __init__(self, books: np.ndarray, threshold: float) -> None:
        self.books, self.threshold = books, threshold

    @property
    def shape(self) -> tuple[int, int]:
        return self.books.shape[0], self.books.shape[2]

    def split(self, x: np.ndarray) -> np.ndarray:
        m, w = self.shape
        out = np.zeros((len(x), m * w))
        out[:, : x.shape[1]] = x
        return out.reshape(len(x), m, w)

    def extra(self, x: np.ndarray) -> float:
        """Weight of the parallel residual beyond that of the rest."""
        d, t = x.shape[1], min(self.threshold, 0.99) ** 2
        return max(0.0, (d - 1) * t / (1 - t) - 1)

    def assign(self, x: np.ndarray, passes: int = 3) -> np.ndarray:
        """Codes by coordinate descent on the anisotropic loss, from the nearest centroids."""
        parts, extra = self.split(x), self.extra(x)
        unit = parts / np.sqrt((parts**2).sum((1, 2)))[:, None, None]
        n, m, _ = parts.shape
        codes = np.stack([((parts[:, i, None] - self.books[i]) ** 2).sum(2).argmin(1) for i in range(m)], 1)
        rows = np.arange(n)
        along = np.stack([(unit[:, i] * (parts[:, i] - self.books[i][codes[:, i]])).sum(1) for i in range(m)], 1)
        total = along.sum(1)
        for _ in range(passes):
            for i in range(m):
                rest = parts[:, i, None] - self.books[i]
                par = np.einsum("nw,ncw->nc", unit[:, i], rest)
                others = total - along[:, i]
                codes[:, i] = ((rest**2).sum(2) + extra * (par + others[:, None]) ** 2).argmin(1)
                along[:, i] = par[rows, codes[:, i]]
                total = others + along[:, i]
        return codes.astype(np.uint8)

    def refit(self, x: np.ndarray, codes: np.ndarray) -> None:
        """Each centroid minimises the loss with all others held."""
        parts, extra = self.split(x), self.extra(x)
        unit = parts / np.sqrt((parts**2).sum((1, 2)))[:, None, None]
        n, m, w = parts.shape
        for i in range(m):
            along = sum((unit[:, k] * (parts[:, k] - self.books[k][codes[:, k]])).sum(1) for k in range(m) if k != i) if m > 1 else np.zeros(n)
            for c in range(16):
                own = codes[:, i] == c
                if not own.any():
                    continue
                u, p = unit[own, i], parts[own, i]
                a = own.sum() * np.eye(w) + extra * u.T @ u
                b = p.sum(0) + extra * (u * ((u * p).sum(1) + along[own])[:, None]).sum(0)
                self.books[i, c] = np.linalg.solve(a, b)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For each query and pair of subspaces the 256 sums of two table entries."""
        one = np.einsum("qmw,mcw->qmc", self.split(q), self.books).astype(np.float32)
        if one.shape[1] % 2:
            one = np.concatenate([one, np.zeros_like(one[:, :1])], 1)
        return (one[:, 0::2, :, None] + one[:, 1::2, None, :]).reshape(len(q), -1, 256)


def packed(codes: np.ndarray) -> np.ndarray:
    if codes.shape[1] % 2:
        codes = np.concatenate([codes, np.zeros_like(codes[:, :1])], 1)
    return codes[:, 0::2] << 4 | codes[:, 1::2]


def fit(x: np.ndarray, plan: Plan) -> Quantiser:
    d = x.shape[1]
    m = -(-d // plan.width)
    rng = np.random.default_rng(0)
    q = Quantiser(np.zeros((m, 16, plan.width)), plan.threshold)
    parts = q.split(x)
    q.books = np.stack([parts[rng.choice(len(x), 16, replace=len(x) < 16), i] for i in range(m)])
    for k in range(2 * plan.rounds):
        codes = q.assign(x, passes=0 if k < plan.rounds else 1)
        if k < plan.rounds:  # plain k-means first
            for i in range(m):
                n = np.bincount(codes[:, i], minlength=16)
                s = np.stack([np.bincount(codes[:, i], parts[:, i, w], 16) for w in range(plan.width)], 1)
                q.books[i][n > 0] = s[n > 0] / n[n > 0, None]
        else:
            q.refit(x, codes)
    return q


def valid(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """vec_id, v of the rows that take part: an id, and a vector that isn't null or zero and holds only finite numbers."""
    v = F.col(f"`{vector}`").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(f"`{key}`").cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))
    )


def uncrowded(vectors: DataFrame, k: int, most: int) -> DataFrame:
    """``vectors`` without rows that can't be among the ``k`` nearest of any query, as k + 1 smaller ids have the same vector.

    Vectors are told apart by 128 bits of hash. Only hashes and ids are shuffled; the few vectors that more than
    k + 1 rows have come back with the largest id that counts.
    """
    marked = vectors.withColumns({"_h1": F.xxhash64("v"), "_h2": F.xxhash64(F.lit(1), "v")})
    names = marked.select("_h1", "_h2", "vec_id").distinct()
    crowded = names.groupBy("_h1", "_h2").count().where(F.col("count") > k + 1).select("_h1", "_h2")
    crowded = materialise(crowded, "crowded")
    few = crowded.limit(most + 1).count() <= most
    by = Window.partitionBy("_h1", "_h2").orderBy("vec_id")
    own = names.join(F.broadcast(crowded) if few else crowded, ["_h1", "_h2"]).withColumn("_at", F.row_number().over(by)).where(F.col("_at") <= k + 1)
    last = materialise(own.groupBy("_h1", "_h2").agg(F.max("vec_id").alias("_last")), "last")
    both = marked.join(F.broadcast(last) if few else last, ["_h1", "_h2"], "left")
    return both.where(F.col("_last").isNull() | (F.col("vec_id") <= F.col("_last"))).select("vec_id", "v")


class Scan:
    """The ``k`` nearest rows so far of each query of a block."""

    def __init__(self, quantiser: Quantiser, names: np.ndarray, q: np.ndarray, k: int, plan: Plan) -> None:
        self.quantiser, self.names, self.q, self.k, self.plan = quantiser, names, q, k, plan
        self.ids = [np.empty(0, np.int64)] * len(q)
        self.scores = [np.empty(0)] * len(q)
        #: Pairs of a query and a row, and how many of them were ranked exactly.
        self.pairs = self.ranked = 0

    def rows(self, ids: np.ndarray, x: np.ndarray, codes: np.ndarray) -> None:
        """Takes a block of rows; codes: two subspaces a byte."""
        take, k = min(len(ids), max(self.plan.least * self.k, int(self.plan.rerank * len(ids)))), self.k
        columns = np.ascontiguousarray(codes.T)
        for a in range(0, len(self.q), 64):
            tables = self.quantiser.tables(self.q[a : a + 64])
            scores = np.zeros((tables.shape[0], len(ids)), np.float32)
            for b, column in enumerate(columns):
                scores += tables[:, b].take(column, axis=1)
            for i, row in enumerate(scores, a):
                best = np.argpartition(-row, take - 1)[:take]
                exact = (x[best] * self.q[i]).sum(1)
                if take < len(ids):
                    # as errors go, all that may still be among the k best: many for a group of near copies
                    off = exact - row[best]
                    known = np.concatenate([exact, self.scores[i]])
                    kth = -np.partition(-known, k)[k] if len(known) > k else -np.inf  # the query itself may be one of them
                    more = np.flatnonzero(row >= kth - off.mean() - self.plan.margin * off.std())
                    more = more[~np.isin(more, best)]
                    best = np.concatenate([best, more])
                    exact = np.concatenate([exact, (x[more] * self.q[i]).sum(1)])
                self.pairs, self.ranked = self.pairs + len(ids), self.ranked + len(best)
                self.keep(i, ids[best], exact)

    def keep(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        other = ids != self.names[i]
        ids, scores = np.concatenate([self.ids[i], ids[other]]), np.concatenate([self.scores[i], scores[other]])
        if len(scores) > 2 * self.k:  # nothing below the kth best of all, if no id comes twice
            least = -np.partition(-scores, 2 * self.k)[2 * self.k]
            near = scores >= least
            if len(np.unique(ids[near])) >= self.k:
                ids, scores = ids[near], scores[near]
        order = np.lexsort((ids, -scores))
        first = np.sort(np.unique(ids[order], return_index=True)[1])[: self.k]
        self.ids[i], self.scores[i] = ids[order][first], scores[order][first]

    def table(self) -> pa.RecordBatch:
        size = list(map(len, self.ids))
        columns = [np.repeat(self.names, size), np.concatenate(self.ids), np.concatenate(self.scores)]
        return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["query_id", "vec_id", "score"])


def fitted(vectors: DataFrame, plan: Plan) -> tuple[Quantiser | None, int]:
    """Codebooks fitted on the sample, and the length of most of its vectors."""
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(plan.sample).select("v").toArrow()["v"].combine_chunks()
    size = sample.value_lengths().to_numpy(zero_copy_only=False)
    if not len(size):
        return None, 0
    d = int(np.bincount(size.astype(np.int64)).argmax())
    return fit(matrix(sample.filter(pa.array(size == d))), plan), d


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, plan: Plan = Plan()) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows of largest inner product of each query, except its own id.

    Both tables have vec_id and v (see ``valid``). Vectors of another length than most of the sample take no
    part; a warning tells their number. An id counts once for a query, by its largest score, and of query
    rows with the same id the one with the least vector counts. Ties go to the smaller id. An empty table has no
    results.
    """
    spark = vectors.sparkSession
    ship(spark)
    quantiser, d = fitted(vectors, plan)
    schema = "query_id long, vec_id long, score double"
    if quantiser is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    others = vectors.where(F.size("v") != d).count()
    if others:
        warnings.warn(f"{others} vectors of another length than {d} take no part", stacklevel=2)

    def encode(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            if frame.num_rows:
                codes = packed(quantiser.assign(matrix(frame.column("v"))))
                yield pa.RecordBatch.from_arrays([frame.column("vec_id"), frame.column("v"), pa.array([c.tobytes() for c in codes], pa.binary())], names=["vec_id", "v", "code"])

    rows = materialise(uncrowded(vectors.where(F.size("v") == d), k, plan.broadcast_rows), "vectors")
    n = rows.count()
    tasks = max(-(-n // plan.task), min(spark.sparkContext.defaultParallelism, -(-n // plan.small_task)), 1)
    index = materialise(rows.repartition(tasks).mapInArrow(encode, "vec_id long, v array<double>, code binary"), "index")

    asked = queries.where(F.size("v") == d).groupBy("vec_id").agg(F.min("v").alias("v"))
    found = None
    for own in query_blocks(materialise(asked, "queries"), "vec_id", plan.query_bytes):
        sent = spark.sparkContext.broadcast((own["vec_id"].to_numpy(), matrix(own["v"])))

        def scan(frames: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            state, held = Scan(quantiser, *sent.value, k, plan), []

            def flush() -> None:
                if held:
                    whole = pa.Table.from_batches(held).combine_chunks()
                    codes = np.frombuffer(b"".join(whole["code"].to_pylist()), np.uint8).reshape(whole.num_rows, -1)
                    state.rows(whole["vec_id"].to_numpy(), matrix(whole["v"]), codes)
                    held.clear()

            for frame in frames:
                for at in range(0, frame.num_rows, plan.block):
                    held.append(frame.slice(at, plan.block))
                    if sum(x.num_rows for x in held) >= plan.block:
                        flush()
            flush()
            yield state.table()

        near = index.mapInArrow(scan, schema).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        best = near.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        part = materialise(best, "found")
        sent.unpersist()
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
