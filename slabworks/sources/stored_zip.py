"""Tables in an uncompressed ZIP, read where they are: ``spark.read.format("stored_zip")``.

A stored member is a range of the archive's bytes, so a Parquet member is opened on that range and each
task reads row groups of its own. Nothing is unpacked. Options: ``path`` (a local path or a URI pyarrow
knows, such as s3:// or hdfs://), ``member``, and ``columns`` (comma separated; all if it isn't given).
Register once per session: ``spark.dataSource.register(StoredZip)``.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


class MemberRange(io.RawIOBase):
    """The bytes [start, start + size) of a seekable file as a file."""

    def __init__(self, file, start: int, size: int):
        self._file, self._start, self._size, self._at = file, start, size, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self._at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self._at = max(0, offset + {io.SEEK_SET: 0, io.SEEK_CUR: self._at, io.SEEK_END: self._size}[whence])
        return self._at

    def read(self, n: int = -1) -> bytes:
        left = max(0, self._size - self._at)
        n = left if n is None or n < 0 else min(n, left)
        self._file.seek(self._start + self._at)
        got = self._file.read(n) if n else b""
        self._at += len(got)
        return got

    def readinto(self, b) -> int:
        got = self.read(len(b))
        b[: len(got)] = got
        return len(got)

    def close(self) -> None:
        self._file.close()
        super().close()


def open_file(path: str):
    """A local path or URI as a seekable binary file."""
    if "://" in path and not path.startswith("file://"):
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        return system.open_input_file(inner)
    return open(path.removeprefix("file://"), "rb")


def member_range(path: str, member: str) -> tuple[int, int]:
    """Where a stored member's bytes begin in the archive, and how many there are."""
    with open_file(path) as f, zipfile.ZipFile(f) as z:
        info = z.getinfo(member)
        if info.compress_type != zipfile.ZIP_STORED:
            raise ValueError(f"{member} is compressed; members must be stored")
        f.seek(info.header_offset + 26)  # the local header repeats the name and has extra fields of its own
        name, extra = struct.unpack("<HH", f.read(4))
        return info.header_offset + 30 + name + extra, info.file_size


@dataclass
class RowGroups(InputPartition):
    first: int
    last: int


class StoredZipReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.member = options["path"], options["member"]
        self.columns = [c.strip() for c in options["columns"].split(",")] if options.get("columns") else None
        self.per_task = int(options.get("rowgroupspertask", 1))
        self.start, self.size = member_range(self.path, self.member)

    def parquet(self):
        import pyarrow.parquet as pq

        return pq.ParquetFile(MemberRange(open_file(self.path), self.start, self.size))

    def partitions(self) -> list[RowGroups]:
        n = self.parquet().num_row_groups
        return [RowGroups(i, min(n, i + self.per_task)) for i in range(0, n, self.per_task)] or [RowGroups(0, 0)]

    def read(self, partition: RowGroups) -> Iterator:
        groups = list(range(partition.first, partition.last))
        if groups:
            yield from self.parquet().iter_batches(row_groups=groups, columns=self.columns)


class StoredZip(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stored_zip"

    def schema(self) -> StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        reader = StoredZipReader(self.options)
        schema = from_arrow_schema(reader.parquet().schema_arrow)
        return schema if reader.columns is None else StructType([schema[c] for c in reader.columns])

    def reader(self, schema: StructType) -> StoredZipReader:
        return StoredZipReader(self.options)
