"""Near-duplicate documents by SuperMinHash, banding, verification on full sets and union-find.

Every shingle deals correlated ranks to the slots of a signature: at level j it puts the value j + u into the
j-th slot of a permutation of its own, and a slot keeps its least value. All levels of all shingles need not be
drawn: once every slot is filled, higher levels can't change anything. Documents with equal sets are one class;
classes that share a band are candidates, candidates are confirmed on their full sets, and components of the
links are found by union-find in each partition and star contraction across partitions.

No bucket is expanded into all of its pairs. A few hubs of a bucket are compared with its members in other
components; a bucket is done when all its members are in one component, or have all been hubs. So groups of
thousands of copies take about one comparison a member. Large buckets that are still mixed hold texts of one
template that differ in what they fill in. Their members are told apart by what the bucket's first hub does not
hold: two of them can only be linked if these rests are alike too, by a similarity that follows from the
threshold, so the rests are banded in their turn. Only members that are nearly linked with the hub, whose rests
are too small for that, are compared with the other members directly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vectorloom.llm.common import materialise, own_columns, scratch, ship
from vectorloom.llm.words import split, text_slices

U = np.uint64
ODD = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


@dataclass(frozen=True)
class Rules:
    words: int = 5
    #: Links have 100 * intersection >= percent * union.
    percent: int = 80
    bands: int = 40
    rows: int = 4
    #: Hubs of a bucket by the end of each round.
    hubs: tuple[int, ...] = (1, 8)
    #: Bands of the rests of members of large buckets, and the similarity of rests that they are made to find: a
    #: pair at it is missed with probability (1 - 0.45 ** 3) ** 184, 2.3e-8.
    rest_bands: int = 184
    rest_rows: int = 3
    rest_similarity: float = 0.45
    broadcast_rows: int = 200_000

    @property
    def slots(self) -> int:
        return self.bands * self.rows

    @property
    def far(self) -> float:
        """Members whose rest is so many times what they share with the hub have rests that must be alike to be linked.

        Let a pair share q, the less of both, with the hub at most, and have rests of r and s shingles. A link needs
        an intersection of t (n + m), t = percent / (100 + percent), of which q are in the hub at most; so the rests
        share t (r + s) - (1 - 2 t) q at least. With r and s at least ``far`` q, that is a similarity of
        ``rest_similarity`` or more.
        """
        t, f = self.percent / (100 + self.percent), self.rest_similarity / (1 + self.rest_similarity)
        return (1 - 2 * t) / (2 * (t - f))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the shingles of ``n`` words of each text; fewer words are one shingle, none give none."""
    words, place, size = split(pc.ascii_lower(texts))
    known = np.fromiter(map(xxhash.xxh3_64_intdigest, words.cast(pa.binary()).to_pylist()), U, len(words))
    h = known[place]

    def hashed(h: np.ndarray, n: int) -> np.ndarray:
        total = np.full(max(0, len(h) - n + 1), U(n))
        for i in range(n):
            total = mix(total * ODD[i % len(ODD)] + h[i : len(total) + i])
        return total

    whole, first = hashed(h, n), (np.cumsum(size) - size).tolist()
    return [np.unique(whole[a : a + k - n + 1] if k >= n else hashed(h[a : a + k], k) if k else h[:0]) for a, k in zip(first, size.tolist(), strict=True)]


def signatures(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash signatures (documents, m) of non-empty sets."""
    out = np.full((len(sets), m), np.inf)
    sizes = np.array([len(s) for s in sets])
    # level 0 of all shingles: a slot and a rank each
    h = np.concatenate(sets) if sets else np.empty(0, U)
    doc = np.repeat(np.arange(len(sets)), sizes)
    _level(out, doc, h, 0, m, None)
    live_docs = np.isinf(out).any(1)
    open_docs = np.flatnonzero(live_docs)
    limit, at = max(1, 9_600_000 // m), 0  # places of permutations that are held at a time
    while at < len(open_docs):
        take, held = [], 0
        while at < len(open_docs) and (not take or held + sizes[open_docs[at]] <= limit):
            take.append(open_docs[at])
            held += sizes[open_docs[at]]
            at += 1
        h = np.concatenate([sets[i] for i in take])
        doc = np.repeat(np.array(take), sizes[take])
        order = np.tile(np.arange(m, dtype=np.int16), (len(h), 1))
        _swap(order, h, 0, m)
        for level in range(1, m):
            live = live_docs[doc]
            if not live.any():
                break
            if not live.all():
                h, doc, order = h[live], doc[live], order[live]
            _swap(order, h, level, m)
            _level(out, doc, h, level, m, order[:, level])
            live_docs[take] = np.isinf(out[take]).any(1)
    return out


def _draw(h: np.ndarray, level: int, salt: int) -> np.ndarray:
    step = U((level * 2 + salt + 1) * int(ODD[0]) & (1 << 64) - 1)
    return (mix(h + step) >> U(11)) * (1.0 / (1 << 53))


def _swap(order: np.ndarray, h: np.ndarray, level: int, m: int) -> None:
    """The step of the shuffle that settles place ``level`` of each shingle's permutation."""
    rows = np.arange(len(h))
    k = level + (_draw(h, level, 1) * (m - level)).astype(np.int64)
    order[rows, level], order[rows, k] = order[rows, k], order[rows, level].copy()


def _level(out: np.ndarray, doc: np.ndarray, h: np.ndarray, level: int, m: int, slot: np.ndarray | None) -> None:
    if slot is None:
        slot = (_draw(h, 0, 1) * m).astype(np.int64)
    np.minimum.at(out.reshape(-1), doc * m + slot, level + _draw(h, level, 0))


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key of each band (documents, bands); equal keys of different bands don't meet."""
    raw = signature.view(U).reshape(len(signature), bands, rows)
    key = np.tile(mix(np.arange(1, bands + 1, dtype=U) * ODD[1]), (len(signature), 1))
    for i in range(rows):
        key = mix(key * ODD[2] + raw[:, :, i])
    return key.view(np.int64)


def _sets_of(docs: DataFrame, rules: Rules, describe: Callable[[pa.RecordBatch, list[np.ndarray]], dict], schema: str) -> DataFrame:
    """A row for each row of ``docs`` by its doc_id and set."""
    ship(docs.sparkSession)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for at, texts in text_slices(frame.column("text")):
                yield pa.RecordBatch.from_pydict(describe(frame.column("doc_id").slice(at, len(texts)), shingle_sets(texts, rules.words)))

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, schema)


def _set_ids(sets: list[np.ndarray]) -> pa.Array:
    return pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())


def lists(rows: list[np.ndarray | None]) -> pa.Array:
    """A column of lists of 64-bit numbers."""
    size = [0 if r is None else len(r) for r in rows]
    flat = np.concatenate([r for r in rows if r is not None] or [np.empty(0, np.int64)]).view(np.int64)
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array([r is None for r in rows]))


def sketch(docs: DataFrame, rules: Rules) -> DataFrame:
    """doc_id, n_shingles, set_id (128 bits), bands (null for an empty set) of each row."""

    def describe(ids: pa.Array, sets: list[np.ndarray]) -> dict:
        full = [i for i, s in enumerate(sets) if len(s)]
        keys = band_keys(signatures([sets[i] for i in full], rules.slots), rules.bands, rules.rows) if full else []
        bands: list = [None] * len(sets)
        for i, k in zip(full, keys, strict=True):
            bands[i] = k
        return {"doc_id": ids, "n_shingles": pa.array([len(s) for s in sets], pa.int64()), "set_id": _set_ids(sets), "bands": lists(bands)}

    return _sets_of(docs, rules, describe, "doc_id long, n_shingles long, set_id binary, bands array<long>")


def full_sets(docs: DataFrame, rules: Rules) -> DataFrame:
    """set_id, shingles of each row."""
    return _sets_of(docs, rules, lambda ids, sets: {"set_id": _set_ids(sets), "shingles": lists(sets)}, "set_id binary, shingles array<long>")


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, broadcast if it has at most ``rows`` rows; it must be a written table, as it is counted."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def local_unions(edges: DataFrame) -> DataFrame:
    """u, v of the same components with the least node of each partition's components as v: union-find in each task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = x = parent.setdefault(p, p)
            return x

        for frame in frames:
            for u, v in zip(frame["u"].tolist(), frame["v"].tolist(), strict=True):
                a, b = root(u), root(v)
                parent[max(a, b)] = min(a, b)
        found = [(x, r) for x in list(parent) if (r := root(x)) != x]
        if found:
            yield pd.DataFrame(found, columns=["u", "v"])

    return edges.select("u", "v").mapInPandas(run, "u long, v long")


def components(edges: DataFrame, one_task_rows: int = 20_000) -> DataFrame:
    """node, component (its least node) of every node of the links u, v.

    If the partitions' forests have at most ``one_task_rows`` links together (16 bytes each), one more task of
    union-find ends it. Beyond that, large-star and small-star contraction works across partitions: each round
    points the neighbours of a node to the least node near it, until nothing changes, in a number of rounds
    that grows with the logarithm of the nodes.
    """
    edges = materialise(local_unions(edges), "edges")
    if edges.limit(one_task_rows + 1).count() <= one_task_rows:
        return _named(materialise(local_unions(edges.coalesce(1)), "edges"))
    known = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialise(large, "edges")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(least, "u")
        edges = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(moved.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = materialise(edges, "edges")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == known:
            return _named(edges)
        known = now


def _named(stars: DataFrame) -> DataFrame:
    """node, component of links u, v that all lead to the least node, v."""
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def linked(shared: Column, a: Column, b: Column, percent: int) -> Column:
    return 100 * shared >= percent * (a + b - shared)


def own_shingles(sets: DataFrame) -> DataFrame:
    """node, n_own: how many shingles of each class no other class of ``sets`` holds."""
    return (
        sets.select("node", F.explode("shingles").alias("x"))
        .groupBy("x")
        .agg(F.count(F.lit(1)).alias("holders"), F.min("node").alias("node"))
        .where("holders = 1")
        .groupBy("node")
        .agg(F.count(F.lit(1)).alias("n_own"))
    )


class Linker:
    """The links found so far between classes, and their components."""

    def __init__(self, sets: DataFrame, rules: Rules) -> None:
        self.sets, self.rules, self.spark = sets, rules, sets.sparkSession
        self.links: DataFrame | None = None
        self.labels: DataFrame | None = None
        self.hubs_of: DataFrame | None = None
        #: How often links were found; as long as it stays, components do too.
        self.finds = 0

    def mixed(self, active: DataFrame, wanted: Column | None = None) -> DataFrame:
        """The rows of ``active`` (key, node, ...) in buckets of more than one component, with component and what the hubs told of each class.

        With ``wanted``, a condition on rows, buckets in which none meets it are left out too.
        """
        if self.labels is None:
            return active.select("*", F.col("node").alias("component"), *[F.lit(None).cast(t).alias(c) for c, t in HUB_COLUMNS])
        named = active.join(small(self.labels, self.rules.broadcast_rows), "node", "left").withColumn("component", F.coalesce("component", "node"))
        open_ = (F.min("component") != F.max("component")) & F.bool_or(F.lit(True) if wanted is None else wanted)
        keys = materialise(named.groupBy("key").agg(open_.alias("open")), "keys")
        if not keys.where("NOT open").isEmpty():  # else the join would keep all rows
            named = named.join(keys.where("open"), "key", "left_semi")
        return materialise(named.join(small(self.hubs_of, self.rules.broadcast_rows), "node", "left"), "mixed")

    def heads(self, named: DataFrame, most: int, before: int = 0) -> DataFrame:
        """The hubs of each bucket from number ``before`` + 1 to ``most``: the members that share most bands with most classes."""
        order = Window.partitionBy("key").orderBy(F.desc("w"), F.xxhash64("node"), "node")
        ranked = named.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= most)  # cut before the shuffle too
        return ranked.where(F.col("_at") > before).select("key", *[F.col(c).alias(f"h_{c}") for c in ("node", "component", "n", "m", "w", *[c for c, _ in HUB_COLUMNS])])

    def possible(self) -> Column:
        """What must hold for a class and a head of another component to be linked."""
        percent = self.rules.percent
        most = F.least("m", "h_m")
        lacking = F.bit_count(F.col("lacks0").bitwiseOR(F.col("h_lacks0"))) + F.bit_count(F.col("lacks1").bitwiseOR(F.col("h_lacks1")))
        alike = F.col("hub_n") - lacking + F.least(F.col("others") - (F.col("n") - F.col("m")), F.col("h_others") - (F.col("h_n") - F.col("h_m")))
        most = F.when(F.col("hub") == F.col("h_hub"), F.least(most, alike)).otherwise(most)
        return (
            (F.col("component") != F.col("h_component"))
            & ((100 + percent) * most >= percent * (F.col("n") + F.col("h_n")))
            & (100 * F.least("n", "h_n") >= percent * F.greatest("n", "h_n"))
        )

    def compare(self, named: DataFrame, heads: DataFrame, once: Column | None = None) -> None:
        """Compares the members of each bucket with its heads, each pair once, and adds the links; ``once`` is a further condition."""
        met = (named["key"] == heads["key"]) & self.possible()
        pairs = named.join(heads, met if once is None else met & once)
        if self.hubs_of is None:
            pairs = pairs.select(F.col("node").alias("a"), "n", F.col("h_node").alias("b"), "h_n", F.col("h_w").alias("rate"))
        else:
            swap = F.col("node") > F.col("h_node")
            pairs = pairs.select(*[F.when(swap, F.col(y)).otherwise(F.col(x)).alias(z) for x, y, z in (("node", "h_node", "a"), ("n", "h_n", "n"), ("h_node", "node", "b"), ("h_n", "n", "h_n"))])
        pairs = materialise(pairs.distinct(), "pairs")
        if pairs.isEmpty():
            if self.hubs_of is None:
                self.labels, self.hubs_of = (self.spark.createDataFrame([], x) for x in ("node long, component long", "node long, " + ", ".join(f"{c} {t}" for c, t in HUB_COLUMNS)))
            return
        compared = materialise(compare(pairs, self.sets, self.rules, tell=self.hubs_of is None), "compared")
        if self.hubs_of is None:
            self.hubs_of = materialise(_nearest_hubs(pairs, compared), "hubs")
        found = compared.where(linked(F.col("shared"), F.col("n"), F.col("h_n"), self.rules.percent)).select(F.col("a").alias("u"), F.col("b").alias("v"))
        if self.labels is not None and found.isEmpty():
            return
        self.finds += 1
        self.links = found if self.links is None else self.links.unionByName(found)
        self.labels = materialise(components(self.links), "labels")

    def resolve(self, active: DataFrame) -> DataFrame:
        """Compares hubs round by round; gives the rows of the large buckets that are still mixed.

        Components only grow together, so a round starts from the buckets that were mixed in the last one, and these are
        looked up again only if links have been found since.
        """
        bare, named, before, seen = active.columns, None, 0, -1
        for most in (*self.rules.hubs, None):
            large = (active if named is None else named).where(F.col("size") > before)
            if named is None or seen != self.finds:
                large = self.mixed(large.select(*bare))
            named, seen = large, self.finds
            if most is not None:
                if not named.isEmpty():
                    self.compare(named, self.heads(named, most, before))
                before = most
        return named

    def separate(self, rest: DataFrame) -> None:
        """Links of the members of large mixed buckets: by their rests, or directly where these are small."""
        rules = self.rules
        held = materialise(rest.join(tops(rest), "key"), "held")
        own = held.select("node", "top", "n", "m", "w").distinct()
        one, other = (self.sets.select(F.col("node").alias(c), F.col("shingles").alias(f"_{c}")) for c in ("node", "top"))
        rests = own.join(one, "node").join(other, "top").select("node", "top", "n", "m", "w", F.array_except("_node", "_top").alias("others"))
        rests = materialise(rests.withColumn("far", F.size("others") >= rules.far * (F.col("n") - F.size("others"))), "rests")
        sized = materialise(rest_bands(rests.where("far"), rules), "rest_bands")
        many = sized.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        second = materialise(sized.join(many, "key").select("key", "size", "node", "n", "m", "w"), "second")
        left = self.resolve(second)
        # members of buckets of rests that are still mixed, and members that are near the hub: pair by pair, each pair once
        self.directly(left, F.col("node") < F.col("h_node"))
        near = held.join(rests.select("node", "top", "far"), ["node", "top"]).select(*[c for c in rest.columns if c not in ("component", *[c for c, _ in HUB_COLUMNS])], "far")
        near = self.mixed(near, ~F.col("far"))
        self.directly(near, F.col("far") | (F.col("node") < F.col("h_node")), ~F.col("far"))

    def directly(self, named: DataFrame, once: Column, heads: Column | None = None) -> None:
        if not named.isEmpty():
            chosen = named if heads is None else named.where(heads)
            chosen = chosen.select("key", *[F.col(c).alias(f"h_{c}") for c in ("node", "component", "n", "m", "w", *[c for c, _ in HUB_COLUMNS])])
            self.compare(named, chosen, once)


def tops(rest: DataFrame) -> DataFrame:
    """key, top: the class whose set the members of each bucket are told apart by.

    It is the heaviest hub that any member has met, in whatever bucket, so the buckets of one family have one top and a
    class has a rest for its family, not one for each of its buckets; where no member has met a hub, the heaviest member.
    The bound of ``Rules.far`` holds for any set, also one that isn't in the bucket.
    """
    heaviest = F.max(F.struct("rate", "hub"))["hub"]
    return rest.groupBy("key").agg(F.coalesce(heaviest, F.max(F.struct("w", "node"))["node"]).alias("top"))


def rest_bands(rests: DataFrame, rules: Rules) -> DataFrame:
    """node, n, m, w, key: the bands of the rests, which meet only under the same hub."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in frames:
            for frame in (whole.slice(at, 512) for at in range(0, whole.num_rows, 512)):  # signatures are wide
                others = frame.column("others")
                ends = np.cumsum(others.value_lengths().to_numpy(zero_copy_only=False))[:-1]
                sets = np.split(others.flatten().to_numpy(zero_copy_only=False).view(U), ends)
                keys = band_keys(signatures(sets, rules.rest_bands * rules.rest_rows), rules.rest_bands, rules.rest_rows)
                own = mix(keys.view(U) ^ mix(frame.column("top").to_numpy().astype(U) * ODD[3])[:, None])
                yield pa.RecordBatch.from_arrays([*(frame.column(c) for c in ("node", "n", "m", "w")), lists(list(own))], names=["node", "n", "m", "w", "keys"])

    full = rests.where(F.size("others") > 0).select("node", "top", "n", "m", "w", "others")
    return full.mapInArrow(run, "node long, n long, m long, w long, keys array<long>").select("node", "n", "m", "w", F.explode("keys").alias("key"))


def find_links(classes: DataFrame, docs: DataFrame, rules: Rules) -> DataFrame:
    """node, component of the classes that share a band with another one.

    The hubs of a bucket are its members that share most bands with most classes, like the text that a group of near
    copies comes from; so the buckets of a group have the same hub. An intersection can't be larger than the
    shingles of either class that any other class holds, and pairs that this bound rules out need no
    comparison, like those of copies too far from their common source. Of copies of the
    same hub it is known which of its shingles each lacks, in 128 groups: two copies share no more than the
    hub's shingles without those that either lacks, and the smaller number of their others that any class shares.
    """
    banded = classes.where("n_shingles > 0").select("node", F.explode("bands").alias("key"))
    shared = materialise(banded.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "keys")
    buckets = materialise(banded.join(small(shared, rules.broadcast_rows), "key"), "buckets")
    inside = materialise(buckets.select("node").distinct().join(classes.select("node", "set_id", "n_shingles", "doc_id"), "node"), "inside")
    reps = materialise(inside.select(F.col("doc_id").alias("_rep")).distinct(), "reps")
    bare = own_columns(docs, "doc_id", "text")
    chosen = bare.join(small(reps, rules.broadcast_rows), F.col("doc_id").eqNullSafe(F.col("_rep")), "left_semi")
    sets = materialise(full_sets(chosen, rules).join(inside.select("set_id", "node"), "set_id").dropDuplicates(["node"]).select("node", "shingles"), "sets")
    bounds = inside.select("node", "n_shingles").join(own_shingles(sets), "node", "left")
    bounds = bounds.select("node", F.col("n_shingles").alias("n"), (F.col("n_shingles") - F.coalesce("n_own", F.lit(0))).alias("m"))
    # a class of which too little is shared has no link at all
    able = materialise(bounds.where(100 * F.col("m") >= rules.percent * F.col("n")), "able")
    weights = materialise(buckets.groupBy("node").agg(F.sum("size").alias("w")).join(able, "node"), "weights")
    active = materialise(buckets.join(small(weights, rules.broadcast_rows), "node").select("key", "size", "node", "n", "m", "w"), "active")
    linker = Linker(sets, rules)
    rest = linker.resolve(active)
    if not rest.isEmpty():
        linker.separate(rest)
    return linker.labels if linker.labels is not None else docs.sparkSession.createDataFrame([], "node long, component long")


def _nearest_hubs(pairs: DataFrame, compared: DataFrame) -> DataFrame:
    """What the comparisons tell of each class by the best hub that it was compared with; of a hub, by itself."""
    zero = F.lit(0).cast("long")
    itself = pairs.select(F.col("b").alias("a"), F.col("h_n").alias("n"), "b", "h_n", "rate", F.col("h_n").alias("shared"), zero.alias("lacks0"), zero.alias("lacks1")).distinct()
    told = F.struct((-F.col("rate")).alias("_r"), F.col("b").alias("hub"), "rate", F.col("h_n").alias("hub_n"), (F.col("n") - F.col("shared")).alias("others"), "lacks0", "lacks1")
    known = compared.select(*itself.columns).unionByName(itself).groupBy(F.col("a").alias("node")).agg(F.min(told).alias("_best"))
    return known.select("node", *[F.col("_best")[c].cast(t).alias(c) for c, t in HUB_COLUMNS])


#: What is known of a class by a hub that it was compared with.
HUB_COLUMNS = (("hub", "long"), ("rate", "long"), ("hub_n", "long"), ("others", "long"), ("lacks0", "long"), ("lacks1", "long"))


def compare(pairs: DataFrame, sets: DataFrame, rules: Rules, tell: bool = True) -> DataFrame:
    """``pairs`` (a, b, ...) with shared and, to ``tell``, lacks0 and lacks1: a bit for each of 128 groups of which a lacks a shingle of b."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    other = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    whole = one.join(small(pairs, rules.broadcast_rows), "a").join(other, "b")

    def bits(half: int) -> Column:
        group = lambda x: F.pmod(x, F.lit(128)) - 64 * half
        bit = lambda x: F.when(group(x).between(0, 63), F.call_function("shiftleft", F.lit(1).cast("long"), group(x).cast("int"))).otherwise(F.lit(0).cast("long"))
        return F.aggregate("_lost", F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(bit(x)))

    lost = whole.select(*pairs.columns, F.array_except("sb", "sa").alias("_lost"))
    if not tell:
        return lost.select(*pairs.columns, (F.col("h_n") - F.size("_lost")).alias("shared"))
    return lost.select(*pairs.columns, (F.col("h_n") - F.size("_lost")).alias("shared"), bits(0).alias("lacks0"), bits(1).alias("lacks1"))


def near_duplicates(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs``.

    A null text is empty; an empty set is linked with nothing, so such rows are components of their own. Rows
    of a repeated doc_id are told apart by their sets; null doc_ids are larger than any other, and a
    component of nothing else has a null id. component_id is the smallest doc_id of a component.
    """
    spark = docs.sparkSession
    with scratch(spark):  # of the tables that this takes, two are left
        sketches = materialise(sketch(docs, rules), "sketches", keep=True)
        full = sketches.where("n_shingles > 0")
        classes = full.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
        classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
        labels = find_links(classes, docs, rules)
        named = classes.select("set_id", "node", "doc_id").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        owner = materialise(named.join(least, "component").select("set_id", "component_id"), "owners", keep=True)
    many = sketches.select("doc_id", "n_shingles", "set_id").join(owner, "set_id", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return many.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def keep_first(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component; rows of a doc_id go or stay together."""
    kept = near_duplicates(docs, rules).where("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept_id"]), "left_semi")
