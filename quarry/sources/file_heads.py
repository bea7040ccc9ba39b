"""A source of the first lines of files: a file is read up to its first line break, whatever its size.

    spark.dataSource.register(FileHeads)
    spark.read.format("file_heads").options(at=..., suffix=".csv").load()

Rows are path, value: the first line without its break, and null for an empty file. `at` is a folder, searched with all its
subfolders through pyarrow, of any file system that it knows. Only names pass through the driver; a task reads SHARE files.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SHARE, BLOCK = 64, 1 << 13


@dataclass
class Files(InputPartition):
    paths: list[str]


def head_of(stream) -> str | None:
    """The first line of a binary stream, read a block at a time; UTF-8, a byte order mark left out."""
    found = b""
    while block := stream.read(BLOCK):
        found += block
        if b"\n" in block:
            break
    return found.split(b"\n", 1)[0].removesuffix(b"\r").decode("utf-8-sig", "replace") if found else None


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.at, self.suffix = options["at"], options.get("suffix", "")

    def _files(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.at if "://" in self.at or self.at.startswith("file:") else f"file://{self.at}")

    def partitions(self) -> list[Files]:
        from pyarrow.fs import FileSelector, FileType

        system, base = self._files()
        found = sorted(f.path for f in system.get_file_info(FileSelector(base, recursive=True)) if f.type == FileType.File and f.path.endswith(self.suffix) and not f.base_name.startswith(("_", ".")))
        return [Files(found[k : k + SHARE]) for k in range(0, len(found), SHARE)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = self._files()
        for path in partition.paths:
            with system.open_input_stream(path) as stream:
                yield path, head_of(stream)


class FileHeads(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_heads"

    def schema(self) -> str:
        return "path string, value string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))
