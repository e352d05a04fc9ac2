"""Shot gathers in files of fixed-length traces, as a Spark data source: `spark.read.format("gathers")`, `df.write.format("gathers")`.

A file has a block of 64 bytes (mark, samples of a trace, kind of sample, interval), the samples of all traces, one trace
after the other, and then their headers (shot, rcv, component). All have fixed lengths, so any range of traces is two ranges of bytes: a
file is read by as many tasks as its size asks for, and a task reads headers alone if no samples are asked for. Nothing
in a file is ever run or unpickled. The manifest lists the files with their traces and range of shots.

Writing is all or nothing: tasks write files of their own names, the manifest is put in place last by a rename, and readers see only
what it lists; files of failed or repeated tasks are in no manifest, and are deleted where the driver knows them. Paths
are local or of a store that Arrow knows (file:, s3:, gs:, hdfs:).

Rows: shot and rcv (bigint), component (string of 8 bytes at most), amp (array<double>). Null amp, or null components of
it, or other lengths than the first trace's, are refused; so are null keys. An empty table gives an empty set of gathers.
"""

from __future__ import annotations

import json
import posixpath
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

MARK, BLOCK = b"GATHERS1", 64
HEADER = np.dtype([("shot", "<i8"), ("rcv", "<i8"), ("component", "S8")])
KINDS = {"f4": "<f4", "f8": "<f8"}
SCHEMA = "shot bigint, rcv bigint, component string, amp array<double>"
#: Bytes of a split, traces that a task hands on at a time, and the manifest's name.
SPLIT_BYTES, BATCH_BYTES, MANIFEST = 32 << 20, 4 << 20, "_manifest.json"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def packed_block(nt: int, kind: str, dt: float) -> bytes:
    return struct.pack("<8sq8sd", MARK, nt, kind.encode(), dt).ljust(BLOCK, b"\0")


def read_manifest(path: str) -> dict:
    store, place = opened(path)
    with store.open_input_stream(posixpath.join(place, MANIFEST)) as file:
        return json.loads(file.read())


@dataclass
class Range(InputPartition):
    """Traces [first, last) of a file that has `traces` of them."""

    name: str
    first: int
    last: int
    traces: int

    def __post_init__(self) -> None:
        super().__init__((self.name, self.first))


class GatherReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict) -> None:
        self.path, self.columns = options["path"], [f.name for f in schema.fields]
        if unknown := set(self.columns) - {c.split()[0] for c in SCHEMA.split(", ")}:
            raise ValueError(f"gathers have no such columns: {sorted(unknown)}")
        self.split_bytes = int(options.get("splitbytes", SPLIT_BYTES))
        self.manifest, self.low, self.high = read_manifest(self.path), None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Ranges of shots skip files; Spark still tests each row."""
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) == ("shot",) and value is not None:
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = value if self.low is None else max(self.low, value)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = value if self.high is None else min(self.high, value)
            yield f

    def partitions(self) -> list[InputPartition]:
        m = self.manifest
        size = max(1, m["nt"] * np.dtype(KINDS[m["kind"]]).itemsize if "amp" in self.columns else HEADER.itemsize)
        step = max(1, self.split_bytes // size)
        open_ = [f for f in m["files"] if (self.low is None or f["last_shot"] >= self.low) and (self.high is None or f["first_shot"] <= self.high)]
        return [Range(f["name"], at, min(f["traces"], at + step), f["traces"]) for f in open_ for at in range(0, f["traces"], step)] or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        nt, kind = self.manifest["nt"], np.dtype(KINDS[self.manifest["kind"]])
        store, place = opened(self.path)
        step = max(1, BATCH_BYTES // max(1, nt * kind.itemsize))
        if not partition.traces:
            return
        with store.open_input_file(posixpath.join(place, partition.name)) as file:
            if file.read_at(BLOCK, 0) != packed_block(nt, self.manifest["kind"], self.manifest["dt"]):
                raise ValueError(f"{partition.name} isn't a file of these gathers")
            for at in range(partition.first, partition.last, step):
                n = min(step, partition.last - at)
                heads = np.frombuffer(file.read_at(n * HEADER.itemsize, BLOCK + partition.traces * nt * kind.itemsize + at * HEADER.itemsize), HEADER)
                made = {"shot": pa.array(heads["shot"]), "rcv": pa.array(heads["rcv"]), "component": pa.array([x.decode() for x in heads["component"].tolist()], pa.string())}
                if "amp" in self.columns:
                    values = np.frombuffer(file.read_at(n * nt * kind.itemsize, BLOCK + at * nt * kind.itemsize), kind)
                    made["amp"] = pa.ListArray.from_arrays(np.arange(0, n * nt + 1, max(nt, 1), dtype=np.int32) if nt else np.zeros(n + 1, np.int32), pa.array(values.astype(float)))
                yield pa.RecordBatch.from_arrays([made[c] for c in self.columns], self.columns)


@dataclass
class Wrote(WriterCommitMessage):
    name: str
    traces: int
    nt: int
    first_shot: int
    last_shot: int


class GatherWriter(DataSourceWriter):
    def __init__(self, schema: T.StructType, options: dict, overwrite: bool) -> None:
        self.path, self.kind, self.dt = options["path"], options.get("kind", "f8"), float(options.get("dt", 1.0))
        if self.kind not in KINDS:
            raise ValueError(f"kinds of samples are {sorted(KINDS)}, not {self.kind}")
        self.columns, self.overwrite = [f.name for f in schema.fields], overwrite
        if not {"shot", "rcv", "amp"} <= set(self.columns):
            raise ValueError("gathers need shot, rcv and amp")
        store, place = opened(self.path)
        if store.get_file_info(posixpath.join(place, MANIFEST)).type != fs.FileType.NotFound and not overwrite:
            raise ValueError(f"there are gathers at {self.path}")

    def write(self, rows: Iterator[T.Row]) -> WriterCommitMessage:
        """One file for a task, as rows come; the headers are held till the end, 24 bytes a trace."""
        store, place = opened(self.path)
        store.create_dir(place, recursive=True)
        name, nt, heads, kind = f"part-{uuid.uuid4().hex}.gathers", -1, bytearray(), KINDS[self.kind]
        first = next(rows, None)
        if first is None:
            return Wrote("", 0, -1, 0, 0)
        low = high = first["shot"]
        with store.open_output_stream(posixpath.join(place, name)) as file:
            while first is not None:
                component, amp = (first["component"] if "component" in self.columns else None) or "", first["amp"]
                if first["shot"] is None or first["rcv"] is None or amp is None or None in amp:
                    raise ValueError(f"a trace without shot, rcv or samples: {first['shot']}, {first['rcv']}")
                if nt < 0:
                    nt = len(amp)
                    file.write(packed_block(nt, self.kind, self.dt))
                if len(amp) != nt:
                    raise ValueError(f"traces of {nt} and of {len(amp)} samples")
                if len(component.encode()) > HEADER["component"].itemsize:
                    raise ValueError(f"components have 8 bytes at most: {component}")
                file.write(np.array(amp, kind).tobytes())
                heads += np.array([(first["shot"], first["rcv"], component.encode())], HEADER).tobytes()
                low, high = min(low, first["shot"]), max(high, first["shot"])
                first = next(rows, None)
            file.write(bytes(heads))
        return Wrote(name, len(heads) // HEADER.itemsize, nt, low, high)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        made = [m for m in messages if m is not None and m.traces]
        lengths = {m.nt for m in made}
        if len(lengths) > 1:
            self.abort(messages)
            raise ValueError(f"traces of {sorted(lengths)} samples")
        store, place = opened(self.path)
        store.create_dir(place, recursive=True)
        target = posixpath.join(place, MANIFEST)
        old = read_manifest(self.path)["files"] if self.overwrite and store.get_file_info(target).type == fs.FileType.File else []
        files = sorted(({"name": m.name, "traces": m.traces, "first_shot": m.first_shot, "last_shot": m.last_shot} for m in made), key=lambda f: (f["first_shot"], f["name"]))
        staged = f"{target}-{uuid.uuid4().hex}"
        with store.open_output_stream(staged) as file:
            file.write(json.dumps({"nt": max(lengths, default=0), "kind": self.kind, "dt": self.dt, "files": files}).encode())
        store.move(staged, target)
        for f in old:
            store.delete_file(posixpath.join(place, f["name"]))

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, place = opened(self.path)
        for m in messages:
            if m is not None and m.name:
                store.delete_file(posixpath.join(place, m.name))


class Gathers(DataSource):
    """Options: path, kind ('f8' or 'f4') and dt to write, splitBytes to read. A schema with fewer columns is read alone."""

    @classmethod
    def name(cls) -> str:
        return "gathers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return GatherReader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return GatherWriter(schema, self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, with filters handed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Gathers)
