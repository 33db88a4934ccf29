"""Zip archives as a Spark data source: a partition is a range of one archive's members, and only wanted members are read."""

from __future__ import annotations

import fnmatch
import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

SCHEMA = "archive string, member string, size long, text string"
#: Bytes of members, as they are packed, that one task reads; a larger member is a task of its own.
PART_BYTES = 32_000_000
TESTS = {EqualTo: str.__eq__, In: lambda name, values: name in values, StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: str.__contains__}


@dataclass
class Members(InputPartition):
    """Members first to last - 1 of an archive's directory."""

    path: str
    first: int
    last: int


class _File(io.RawIOBase):
    """A file of a store as zipfile expects one: a place before its begin is an OSError."""

    def __init__(self, path: str) -> None:
        store, at = fs.FileSystem.from_uri(path)
        self.file = store.open_input_file(at)

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.file.tell()

    def seek(self, offset: int, whence: int = 0) -> int:
        at = offset + (0, self.file.tell(), self.file.size())[whence]
        if at < 0:
            raise OSError("before the begin of the file")
        return self.file.seek(at)

    def readinto(self, into: memoryview) -> int:
        return self.file.readinto(into)


def _open(path: str) -> zipfile.ZipFile:
    """The archive, read by seeking: its directory, then what is asked for."""
    return zipfile.ZipFile(io.BufferedReader(_File(path), 1 << 16))


class MemberReader(DataSourceReader):
    """Names are compared as the directory is read, so that of other members no byte is read and, where a range has none, no task runs."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.part = options["path"], int(options.get("partbytes", PART_BYTES))
        self.tests: list[tuple[type[Filter], object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if type(f) in TESTS and f.attribute == ("member",):
                self.tests.append((type(f), f.value))
            else:
                yield f

    def _wanted(self, m: zipfile.ZipInfo) -> bool:
        return not m.is_dir() and all(TESTS[kind](m.filename, value) for kind, value in self.tests)

    def partitions(self) -> list[Members]:
        store, at = fs.FileSystem.from_uri(self.path.rsplit("/", 1)[0])
        scheme = self.path[: len(self.path) - len(self.path.split("://", 1)[-1])] or "file://"
        files = sorted(f.path for f in store.get_file_info(fs.FileSelector(at)) if f.is_file and fnmatch.fnmatch(f.base_name, self.path.rsplit("/", 1)[1]))
        out = []
        for path in (f if "://" in f else scheme + f for f in files):
            with _open(path) as z:
                first, held, some = 0, 0, False
                members = z.infolist()
                for i, m in enumerate(members):
                    size = m.compress_size if self._wanted(m) else 0
                    if some and held + size > self.part:
                        out.append(Members(path, first, i))
                        first, held, some = i, 0, False
                    held, some = held + size, some or self._wanted(m)
                if some:
                    out.append(Members(path, first, len(members)))
        return out

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        with _open(partition.path) as z:
            for m in z.infolist()[partition.first : partition.last]:
                if self._wanted(m):
                    try:
                        text = z.read(m).decode()
                    except UnicodeDecodeError:
                        text = None
                    yield pa.RecordBatch.from_arrays([pa.array([partition.path.rsplit("/", 1)[-1]]), pa.array([m.filename]), pa.array([m.file_size], pa.int64()), pa.array([text], pa.string())], names)


class MemberSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> MemberReader:
        return MemberReader(self.options)


def archive_members(spark: SparkSession, glob: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """archive, member, size, text (null if it is no UTF-8) of the files in the zip archives that match a pattern in one folder. An
    archive of any size is read by as many tasks as it has ranges of part_bytes; filters on member names (equal, among, starts,
    ends, contains) are compared in the directory, and other members' bytes are not read. The driver reads the directories, one
    after another, and keeps ranges."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MemberSource)
    return spark.read.format("zip_members").option("path", glob).option("partBytes", part_bytes).load()
