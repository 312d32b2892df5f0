"""Sharding with size-tiered compaction, in DataFrame functions only.

A store is a folder: ``data`` holds immutable runs of Parquet files, ``manifest`` one JSON file for each version. A
version names the runs that make up the table, with the files, bytes and rows of each. Arrivals are appended as
small runs; compaction merges runs of a similar size into files of a target size. Every change writes its files
first and then commits by creating the next version's manifest, which fails if another writer has made it; so a
reader sees one version whole, and a writer that dies leaves only files that no manifest names.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tiers:
    #: Bytes of a file that a merge aims at; a run of at least so many bytes a file isn't merged again.
    target_bytes: int = 128 << 20
    #: Runs of one tier that start a merge, and the ratio of sizes between tiers.
    merge_runs: int = 4
    ratio: float = 4.0
    #: Runs smaller than this are all in the lowest tier.
    least_bytes: int = 1 << 20


@dataclass(frozen=True)
class Run:
    name: str
    bytes: int
    rows: int
    files: list[str] = field(default_factory=list)


class CommitConflict(RuntimeError):
    """Another writer has committed this version."""


class Store:
    """A versioned table in a folder of any file system that Spark can write to."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._file(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _file(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def versions(self) -> list[int]:
        top = self._file(f"{self.path}/manifest")
        if not self._fs.exists(top):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(top)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> tuple[int, list[Run]]:
        """The version (the latest by default; 0 for an empty store) and its runs."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        if version == 0:
            return 0, []
        if version not in known:
            raise ValueError(f"no version {version}")
        stream = self._fs.open(self._file(f"{self.path}/manifest/{version:010d}.json"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return version, [Run(**r) for r in json.loads(text)["runs"]]

    def commit(self, version: int, runs: list[Run]) -> int:
        """Makes ``runs`` version ``version + 1``; of several writers that try, one succeeds.

        The manifest is written whole under another name and then given its own in one step that fails if the
        name is taken: a hard link on a local file system (where rename replaces), else a rename without overwrite,
        which HDFS does atomically. Object stores without such a rename need a committer of their own.
        """
        new = version + 1
        to = self._file(f"{self.path}/manifest/{new:010d}.json")
        draft = self._file(f"{self.path}/manifest/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps({"version": new, "runs": [asdict(r) for r in runs]}).encode()))
        finally:
            out.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                place = lambda p: self._jvm.java.nio.file.Paths.get(self._fs.makeQualified(p).toUri())
                self._jvm.java.nio.file.Files.createLink(place(to), place(draft))
            else:
                none = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
                options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
                options[0] = none
                whole = self._fs.makeQualified(to)
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(self._fs.makeQualified(draft), whole, options)
        except Py4JJavaError as error:
            if "AlreadyExists" not in str(error.java_exception):
                raise
            raise CommitConflict(f"version {new} exists") from None
        finally:
            self._fs.delete(draft, False)
        return new

    def _written(self, df: DataFrame) -> list[Run]:
        """Writes a run and describes it; a run without rows is none."""
        name = uuid.uuid4().hex
        to = f"{self.path}/data/{name}"
        df.write.parquet(to)
        files = {s.getPath().getName(): s.getLen() for s in self._fs.listStatus(self._file(to)) if s.getPath().getName().startswith("part-")}
        rows = self.spark.read.schema(df.schema).parquet(to).count()
        return [Run(name, sum(files.values()), rows, sorted(files))] if rows else []

    def append(self, df: DataFrame) -> int:
        """Adds the rows of ``df`` as one small run; other names or types of columns than the table's raise, their order doesn't matter."""
        version, runs = self.manifest()
        if runs:
            own, new = ({f.name: f.dataType for f in x.schema.fields} for x in (self.read(version), df))
            if own != new:
                raise ValueError(f"the table has the columns {own}, not {new}")
        return self.commit(version, runs + self._written(df))

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version; of an empty store there is no schema, so it can't be read."""
        _, runs = self.manifest(version)
        if not runs:
            raise ValueError("the store is empty")
        return self.spark.read.parquet(*[f"{self.path}/data/{r.name}/{f}" for r in runs for f in r.files])

    def due(self, runs: list[Run], tiers: Tiers) -> list[list[Run]]:
        """Groups of runs to merge: all runs of each tier that has enough of them."""
        by: dict[int, list[Run]] = {}
        for r in runs:
            if r.bytes < tiers.target_bytes * max(1, len(r.files)):
                tier = max(0, math.floor(math.log(max(r.bytes, 1) / tiers.least_bytes, tiers.ratio)) + 1)
                by.setdefault(tier, []).append(r)
        return [group for _, group in sorted(by.items()) if len(group) >= tiers.merge_runs]

    def compact(self, tiers: Tiers = Tiers()) -> int:
        """Merges every group that is due, one commit each, until none is; gives the last version.

        A merge reads its files and writes as many as the target needs, without a shuffle. Rows are kept as
        they are: repeated ones too. If another writer commits first, the merge is tried on its version.
        """
        version, runs = self.manifest()
        while groups := self.due(runs, tiers):
            group = groups[0]
            files = max(1, -(-sum(r.bytes for r in group) // tiers.target_bytes))
            whole = self.spark.read.parquet(*[f"{self.path}/data/{r.name}/{f}" for r in group for f in r.files])
            merged = self._written(whole.coalesce(files))
            if sum(r.rows for r in merged) != sum(r.rows for r in group):
                raise RuntimeError("a merge must keep all rows")
            gone = {r.name for r in group}
            while True:
                try:
                    version = self.commit(version, [r for r in runs if r.name not in gone] + merged)
                    break
                except CommitConflict:
                    version, runs = self.manifest()
                    if not gone <= {r.name for r in runs}:
                        break  # another writer has merged these runs; the next round starts from its version
            version, runs = self.manifest()
        return version

    def vacuum(self, keep_versions: int = 1) -> int:
        """Deletes runs that none of the last versions names, and gives how many; no writer may be at work.

        Old manifests go first, so a crash in between leaves files without a version and no version without files.
        """
        known = self.versions()
        used = {r.name for v in known[-keep_versions:] for r in self.manifest(v)[1]}
        for v in known[:-keep_versions]:
            self._fs.delete(self._file(f"{self.path}/manifest/{v:010d}.json"), False)
        top, gone = self._file(f"{self.path}/data"), 0
        for s in self._fs.listStatus(top) if self._fs.exists(top) else []:
            if s.getPath().getName() not in used:
                self._fs.delete(s.getPath(), True)
                gone += 1
        return gone


def ingest(df: DataFrame, store: Store, key: str, arrivals: int, tiers: Tiers) -> DataFrame:
    """Appends ``df`` in ``arrivals`` parts by the hash of ``key`` (a null key has a hash too), compacts, reads back.

    An empty table, of which no run is kept, is given back as it came.
    """
    for k in range(arrivals):
        store.append(df.where(F.pmod(F.xxhash64(key), F.lit(arrivals)) == k))
    store.compact(tiers)
    store.vacuum()
    return store.read() if store.manifest()[1] else df
