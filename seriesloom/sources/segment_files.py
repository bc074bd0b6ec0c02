"""A Python data source for records kept as one JSON envelope a segment: format "segment_envelopes".

    register(spark)
    df.write.format("segment_envelopes").mode("overwrite").save(path)
    read(spark, path, schema).where("segment_index = 3")     # opens that segment's files alone

A file is named by its segment, so filters on segment_index are pushed down to names, and a partition is some files. What
tasks write is put in place by the commit of the job, and thrown away if the job fails. Paths may be of any store that
pyarrow knows; on a cluster it must be one that all executors share.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

INDEX = "segment_index"
#: Records that a batch holds.
BATCH = 10_000
#: Files and bytes that a partition reads at most, beyond one file, and records that a writing task holds before it writes files.
FILES, BYTES, HELD = 256, 32 << 20, 200_000
#: Files that a commit moves at a time.
MOVES = 32
_ORDERS = {GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, EqualTo: lambda a, b: a == b, In: lambda a, b: a in b}


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def _segment(path: str) -> int | None:
    name = path.rpartition("/")[2]
    return int(name[4:].split("-")[0]) if name.startswith("seg-") and name.endswith(".json") else None


def _files(path: str) -> list[tuple[int, str, int]]:
    """Segment, path and bytes of each file."""
    store, root = _store(path)
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted((s, f.path, f.size or 0) for f in found if (s := _segment(f.path)) is not None)


@dataclass
class SomeFiles(InputPartition):
    files: list[tuple[int, str]]


class Reader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType) -> None:
        self.path, self.schema, self.kept = path, schema, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes comparisons of segment_index with constants; the others are Spark's."""
        for f in filters:
            if type(f) in _ORDERS and f.attribute == (INDEX,):
                self.kept.append(f)
            else:
                yield f

    def partitions(self) -> Sequence[SomeFiles]:
        ok = lambda s: all(_ORDERS[type(f)](s, f.value) for f in self.kept)
        out, size = [SomeFiles([])], 0
        for s, path, n in _files(self.path):
            if not ok(s):
                continue
            if out[-1].files and (len(out[-1].files) == FILES or size + n > BYTES):
                out.append(SomeFiles([]))
                size = 0
            out[-1].files.append((s, path))
            size += n
        return out

    def read(self, partition: SomeFiles) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        names, types = self.schema.names, [_arrow(x.dataType) for x in self.schema]

        def batch(part: list[tuple[int, dict]]) -> pa.RecordBatch:
            columns = [[s for s, _ in part] if n == INDEX else [r.get(n) for _, r in part] for n in names]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        held: list[tuple[int, dict]] = []
        for segment, path in partition.files:
            with store.open_input_stream(path) as f:
                whole = json.loads(f.read())
            if not isinstance(whole, dict) or not isinstance(whole.get("records"), list):
                raise ValueError(f"{path}: no list of records")
            held += [(segment, r) for r in whole["records"]]
            if len(held) >= BATCH:
                for a in range(0, len(held), BATCH):
                    yield batch(held[a : a + BATCH])
                held = []
        if held:
            yield batch(held)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class Writer(DataSourceWriter):
    """A task writes a file for each segment it has rows of under a name of the job; the commit moves them in place."""

    def __init__(self, path: str, schema: T.StructType, overwrite: bool, meta: dict) -> None:
        self.path, self.names, self.overwrite, self.meta, self.job = path, schema.names, overwrite, meta, uuid.uuid4().hex
        if INDEX not in self.names:
            raise ValueError(f"rows need a column {INDEX}")

    def write(self, rows: Iterator) -> Written:
        store, root = _store(self.path)
        store.create_dir(f"{root}/_job-{self.job}", recursive=True)
        files: list[tuple[str, str]] = []

        def put(held: dict[int, list[dict]]) -> None:
            task = uuid.uuid4().hex[:12]
            for s, records in held.items():
                name = f"seg-{int(s):06d}-{task}.json"
                with store.open_output_stream(f"{root}/_job-{self.job}/{name}") as f:
                    f.write(json.dumps({INDEX: s, **self.meta, "records": records}, default=str).encode())
                files.append((f"{root}/_job-{self.job}/{name}", f"{root}/{name}"))

        held: dict[int, list[dict]] = {}
        n = 0
        for r in rows:
            one = r.asDict(recursive=True)
            held.setdefault(one.pop(INDEX), []).append(one)
            n += 1
            if n >= HELD:  # a segment may have more than one file
                put(held)
                held, n = {}, 0
        put(held)
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        before = [p for _, p, _ in _files(self.path)] if self.overwrite else []
        with ThreadPoolExecutor(MOVES) as pool:
            for _ in pool.map(lambda f: store.move(*f), (f for m in messages if m for f in m.files)):
                pass
            for _ in pool.map(store.delete_file, before):
                pass
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, root = _store(self.path)
        if store.get_file_info(f"{root}/_job-{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/_job-{self.job}")


class SegmentEnvelopes(DataSource):
    """Options: path; on writing every other option is put beside the records as metadata. On reading the schema must be given, segment_index among it."""

    @classmethod
    def name(cls) -> str:
        return "segment_envelopes"

    def schema(self) -> T.StructType:
        raise ValueError("give the records' schema: spark.read.format('segment_envelopes').schema(...)")

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(self.options["path"], schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], schema, overwrite, {k: v for k, v in self.options.items() if k != "path"})


def read(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The records under a path. Segments are numbered from 0.

    Spark 4.1 plans the partitions of a Python source when it pushes filters, and keeps those partitions for a later query on
    the same DataFrame that has no filter. So there is always one, which all segments meet.
    """
    return spark.read.format(SegmentEnvelopes.name()).schema(schema).load(path).where(F.col(INDEX) >= 0)


def register(spark: SparkSession) -> None:
    """Makes the format known in a session, with its filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.dataSource.register(SegmentEnvelopes)
