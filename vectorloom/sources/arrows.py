"""Folders of Arrow stream files, as libraries of data sets save them, read by record batches with binary columns.

A folder has files of the Arrow stream format and ``state.json``, which lists them in order under ``_data_files``. A stream has
no index, so a first job walks each file's messages, one task a file; of local and mounted files only the pages of message
headers are touched. A second job reads the record batches, each by its position: a file is split as its batches are.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import pyarrow.fs as pf
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from vectorloom.functions.cluster import ship
from vectorloom.sources.writers import replace_json

#: Rows go to Spark in slices of about so many bytes, so that a batch of images isn't copied whole.
SLICE = 32 << 20
INDEX = "file string, at long, length long, n long, schema binary"


def _system(path: str) -> tuple[pf.FileSystem, str]:
    """File system and path of a path or URI; ``file:`` has one slash or three."""
    if path.startswith("file:"):
        return pf.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    return pf.FileSystem.from_uri(path) if "://" in path else (pf.LocalFileSystem(), path)


def _opened(path: str) -> Any:
    system, inside = _system(path)
    return pa.memory_map(inside) if isinstance(system, pf.LocalFileSystem) else system.open_input_file(inside)


def _files(spark: SparkSession, folder: str) -> list[str]:
    """The data files in order: those of ``state.json``, which are there when a folder is whole."""
    state = spark.read.schema("_data_files array<struct<filename: string>>").option("multiLine", True).json(posixpath.join(folder, "state.json"))
    found = state.first()
    if found is None or found["_data_files"] is None:
        raise ValueError(f"state.json of {folder} lists no files")
    return [posixpath.join(folder, f["filename"]) for f in found["_data_files"]]


def _walk(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for the schema of each file and one for each of its record batches."""
    kinds = [("file", pa.string()), ("at", pa.int64()), ("length", pa.int64()), ("n", pa.int64()), ("schema", pa.binary())]
    for frame in frames:
        for file in frame.column(0).to_pylist():
            rows, schema = [], None
            with _opened(file) as stream:
                while True:
                    at = stream.tell()
                    try:
                        message = pa.ipc.read_message(stream)
                    except EOFError:
                        break
                    if message.type == "schema":
                        schema = pa.ipc.read_schema(message)
                        rows.append((file, at, stream.tell() - at, 0, schema.remove_metadata().serialize().to_pybytes()))
                    elif message.type == "record batch":
                        rows.append((file, at, stream.tell() - at, pa.ipc.read_record_batch(message, schema).num_rows, None))
                    else:
                        raise ValueError(f"{file} has a message of type {message.type}; dictionaries aren't read")
            if schema is None:
                raise ValueError(f"{file} isn't an Arrow stream")
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*rows), kinds)], names=[k for k, _ in kinds])


def read(spark: SparkSession, folder: str, columns: list[str] | None = None, most: int | None = None) -> DataFrame:
    """The rows of a folder with ``place``, their number from 0 in the order of files and batches; at most the first ``most``.

    Batches behind a cap aren't read. Tasks are as many as ``spark.sql.files.maxPartitionBytes`` asks for, and a batch isn't
    split. Files whose schemas differ, files of dictionaries, and a column called place raise. The driver holds a
    row for each record batch.
    """
    ship(spark)
    files = _files(spark, folder)
    if not files:
        raise ValueError(f"{folder} has no files, so its columns aren't known")
    named = spark.createDataFrame([(f,) for f in files], "file string").repartition(len(files))
    index = named.mapInArrow(_walk, INDEX).collect()
    schemas = {bytes(r["schema"]) for r in index if r["schema"] is not None}
    if len(schemas) != 1:
        raise ValueError(f"the files of {folder} have {len(schemas)} schemas")
    stored = schemas.pop()
    whole = pa.ipc.read_schema(pa.py_buffer(stored))
    own = columns or whole.names
    if missing := [c for c in own if c not in whole.names]:
        raise ValueError(f"{folder} has no columns {missing}")
    if "place" in own:
        raise ValueError("a column is called place")
    shape = from_arrow_schema(pa.schema([whole.field(c) for c in own])).add("place", "long", False)
    target = to_arrow_schema(shape)

    at_of, parts, start = {f: k for k, f in enumerate(files)}, [], 0
    for r in sorted((r for r in index if r["schema"] is None), key=lambda r: (at_of[r["file"]], r["at"])):
        take = r["n"] if not most else min(r["n"], most - start)
        if take > 0:
            parts.append((r["file"], r["at"], r["length"], r["n"], start, take))
        start += r["n"]
    if not parts:
        return spark.createDataFrame([], shape)

    def load(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.ipc.read_schema(pa.py_buffer(stored))
        for frame in frames:
            for part in frame.to_pylist():
                with _opened(part["file"]) as stream:
                    stream.seek(part["at"])
                    batch = pa.ipc.read_record_batch(pa.ipc.read_message(stream), schema)
                    if batch.num_rows != part["n"]:
                        raise ValueError(f"{part['file']} has changed since it was walked")
                    table = batch.select(own).slice(0, part["take"])
                    step = max(1, SLICE * batch.num_rows // max(1, batch.nbytes))
                    for k in range(0, part["take"], step):
                        piece = table.slice(k, step)
                        first = part["first"] + k
                        arrays = [c.cast(f.type) for c, f in zip(piece.columns, target)] + [pa.array(range(first, first + piece.num_rows), pa.int64())]
                        yield pa.RecordBatch.from_arrays(arrays, schema=target)

    size = int(spark.sparkContext._jsc.sc().conf().getSizeAsBytes("spark.sql.files.maxPartitionBytes", "128m"))
    tasks = min(len(parts), max(spark.sparkContext.defaultParallelism, -(-sum(p[2] for p in parts) // size)))
    listed = spark.createDataFrame(parts, "file string, at long, length long, n long, first long, take long")
    return listed.repartition(tasks).mapInArrow(load, shape)


def write(rows: DataFrame, folder: str, size: int = 1000) -> int:
    """Writes a file of the Arrow stream format for each partition of ``rows`` that isn't empty, with record batches of ``size`` rows at most.

    A file appears under its name when it is whole, one of a task that ran twice replaces the other, and ``state.json``,
    without which readers see nothing, is written last. Gives the number of rows.
    """
    spark = rows.sparkSession
    ship(spark)
    run = uuid.uuid4().hex[:8]

    def save(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inside = _system(folder)
        system.create_dir(inside, recursive=True)
        part, n, writer = TaskContext.get().partitionId(), 0, None
        name, draft = f"data-{part:06d}-{run}.arrow", f"{inside}/_draft-{uuid.uuid4().hex}"
        with system.open_output_stream(draft) as out:
            for frame in frames:
                if frame.num_rows:
                    writer = writer or pa.ipc.new_stream(out, frame.schema)
                    for k in range(0, frame.num_rows, size):
                        writer.write_batch(frame.slice(k, size))
                    n += frame.num_rows
            if writer:
                writer.close()
        if n:
            system.move(draft, f"{inside}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([name]), pa.array([n])], names=["part", "name", "n"])
        else:
            system.delete_file(draft)

    saved = sorted(rows.mapInArrow(save, "part long, name string, n long").collect())  # a row for each file
    replace_json(spark, posixpath.join(folder, "state.json"), {"_data_files": [{"filename": r["name"]} for r in saved]})
    return sum(r["n"] for r in saved)
