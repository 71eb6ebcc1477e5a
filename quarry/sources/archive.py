"""``spark.read.format("archive")`` and its writers, as Python data sources.

Reading: one partition for each file, so tables of any number of archives spread over the cluster.
The options ``names`` (separated by newlines) and ``prefix`` pick entries before anything is decoded.
With the option ``pushdown`` equality, membership and prefix filters on ``archive`` and ``name`` do the
same: files of another archive are not opened. Spark 4.1 keeps a pushed reader with the loaded
relation, so with it each query must load the table anew. Payload columns are null unless ``content`` (or ``raw``) is asked for, as data sources are not told which columns a
query reads.

The paths of this source are opened on the executors with Python's own file access (a mounted or
local file system). ``operators.archives.read`` takes any file system that Spark can read.

Options: path, format, mode (auto, central, local_headers, stream), lenient, content, raw, verify,
password, memory_limit, max_ratio, glob, names, prefix, pushdown.
"""

from __future__ import annotations

import fnmatch
import itertools
import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, DataSourceStreamReader, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from quarry.containers import archive
from quarry.containers.model import ENTRIES, arrow_schema

EXTENSIONS = {"zip": "zip", "tar": "tar", "lzh": "lzh", "gzip": "gz", "xz": "xz", "bzip2": "bz2", "zstd": "zst", "lz4": "lz4", "brotli": "br", "snappy": "sz"}


def _true(value: str | None) -> bool:
    return str(value).lower() in ("true", "1", "yes")


def list_files(path: str, glob: str | None = None) -> list[str]:
    path = path.removeprefix("file://")
    if os.path.isfile(path):
        return [path]
    found = [os.path.join(d, f) for d, _, names in os.walk(path) for f in names if not f.startswith((".", "_"))]
    return sorted(f for f in found if glob is None or fnmatch.fnmatch(os.path.basename(f), glob))


def _options(o: dict) -> dict:
    return {
        "format": o.get("format"), "mode": o.get("mode", "auto"), "lenient": _true(o.get("lenient")), "content": _true(o.get("content")), "raw": _true(o.get("raw")), "verify": _true(o.get("verify")),
        "password": o["password"].encode() if "password" in o else None, "memory_limit": int(o["memory_limit"]) if "memory_limit" in o else None, "max_ratio": float(o["max_ratio"]) if "max_ratio" in o else None,
    }


@dataclass
class ArchiveFile(InputPartition):
    path: str


def batched(entries: Iterator[dict], most: int = 32 << 20) -> Iterator[list[dict]]:
    """Entry rows in lists of about that many bytes of payload, 256 at most."""
    held, size = [], 0
    for e in entries:
        held.append({n: e[n] for n in ENTRIES.names})
        size += len(e["content"] or b"") + len(e["raw_content"] or b"")
        if size > most or len(held) >= 256:
            yield held
            held, size = [], 0
    if held:
        yield held


def batch_slices(batch: pa.RecordBatch, rows: int = 64) -> Iterator[pa.RecordBatch]:
    """A few rows at a time: Python objects of a whole batch would be a second copy of it."""
    return (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def rows_of(path: str, options: dict, names: set[str] | None, prefixes: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    with open(path, "rb") as f:
        data = f.read()
    schema = arrow_schema()
    for held in batched(archive.iter_rows(data, path, names=names, prefixes=prefixes, **options)):
        yield pa.RecordBatch.from_pylist(held, schema)


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths, self.options = list_files(options["path"], options.get("glob")), _options(options)
        self.names: set[str] | None = set(options["names"].split("\n")) if "names" in options else None
        self.prefixes: tuple[str, ...] = (options["prefix"],) if "prefix" in options and self.names is None else ()

    def partitions(self) -> Sequence[InputPartition]:
        return [ArchiveFile(p) for p in self.paths]

    def read(self, partition: ArchiveFile) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, ArchiveFile):
            return iter(())
        # names filter first, prefixes only without names: together they would be a union
        return rows_of(partition.path, self.options, self.names, self.prefixes if self.names is None else ())


class PushedArchiveReader(ArchiveReader):
    """With filters from the query."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("archive",) and isinstance(f, EqualTo | In):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.paths = [p for p in self.paths if p in wanted]
            elif column == ("name",) and isinstance(f, EqualTo | In):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = wanted if self.names is None else self.names & wanted
                yield f  # a single-stream file has no name before it is read
            elif column == ("name",) and isinstance(f, StringStartsWith) and self.names is None and not self.prefixes:
                self.prefixes = (f.value,)
                yield f
            else:
                yield f


class ArchiveStream(DataSourceStreamReader):
    """New archive files of a folder, in the order of their names: the offset is the last name. Files
    are read on the executors, one partition each."""

    def __init__(self, options: dict) -> None:
        self.path, self.glob, self.options = options["path"], options.get("glob"), _options(options)

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self, *_: object) -> dict:
        return {"after": max(list_files(self.path, self.glob), default="")}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return [ArchiveFile(p) for p in list_files(self.path, self.glob) if start["after"] < p <= end["after"]]

    def read(self, partition: ArchiveFile) -> Iterator[pa.RecordBatch]:
        return rows_of(partition.path, self.options, None, ())


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class ArchiveWriter(DataSourceArrowWriter):
    """One archive for each partition: part-<n>.<extension>. Files are written under a temporary name
    and renamed when the job commits."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.format, self.level = options["path"].removeprefix("file://"), options.get("format", "zip"), int(options.get("level", 6))
        self.overwrite = overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        rows = (r for batch in iterator for small in batch_slices(batch) for r in small.to_pylist())
        first = next(rows, None)
        if first is None:
            return Written([])
        os.makedirs(self.path, exist_ok=True)
        name = f"part-{TaskContext.get().partitionId():05d}.{EXTENSIONS[self.format]}"
        with open(os.path.join(self.path, f".{name}.{TaskContext.get().attemptNumber()}.tmp"), "wb") as f:
            f.write(archive.pack(itertools.chain([first], rows), self.format, self.level))
        return Written([f.name])

    def commit(self, messages: list[Written | None]) -> None:
        old = set(list_files(self.path)) if self.overwrite and os.path.isdir(self.path) else set()
        new = {tmp: os.path.join(self.path, os.path.basename(tmp)[1:].rsplit(".", 2)[0]) for m in messages for tmp in (m.files if m else ())}
        for tmp, target in new.items():
            os.replace(tmp, target)
        for f in old - set(new.values()):  # only when the new ones are in place
            os.remove(f)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            for tmp in m.files if m else ():
                if os.path.exists(tmp):
                    os.remove(tmp)


class FilesWriter(DataSourceArrowWriter):
    """Each row (path, content) as a file under the option ``path``; with ``overwrite`` false existing
    files stay. Files are written under temporary names and renamed when the job commits."""

    def __init__(self, options: dict) -> None:
        self.root, self.replace = options["path"].removeprefix("file://"), _true(options.get("overwrite", "true"))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        done, mark = [], f".{TaskContext.get().taskAttemptId()}.tmp"
        for batch in iterator:
            for small in batch_slices(batch):
                for r in small.to_pylist():
                    parts = [p for p in r["path"].replace("\0", "_").split("/") if p not in ("", ".", "..")]
                    target = os.path.join(self.root, *parts)
                    if not self.replace and os.path.exists(target):
                        continue
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    with open(target + mark, "wb") as f:
                        f.write(r["content"] or b"")
                    done.append(target + mark)
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        for m in messages:
            for tmp in m.files if m else ():
                os.replace(tmp, tmp.rsplit(".", 2)[0])

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            for tmp in m.files if m else ():
                if os.path.exists(tmp):
                    os.remove(tmp)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> StructType:
        return ENTRIES

    def reader(self, schema: StructType) -> ArchiveReader:
        return (PushedArchiveReader if _true(self.options.get("pushdown")) else ArchiveReader)(self.options)

    def streamReader(self, schema: StructType) -> ArchiveStream:
        return ArchiveStream(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options, overwrite)


class FilesSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "files"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options)


def register(spark: SparkSession) -> None:
    """Makes both formats known to a session."""
    spark.dataSource.register(ArchiveSource)
    spark.dataSource.register(FilesSink)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # for readers that ask for it
