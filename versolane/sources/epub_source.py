"""EPUB archives as a Spark data source: spark.read.format("epub").load(folder), once `register` has named it.

An input partition is a range of files, or of the entries of one large file, so a big archive is read by several tasks. Filters on path and doc_idx are pushed
down: files and entries that they exclude are not opened. With option("content", "false") names come without any document being unpacked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

from . import epub

SCHEMA = "path string, doc_idx int, name string, html string, error string"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
MOST = 2**31 - 1


@dataclass
class Entries(InputPartition):
    """Some files and, of each, the entries of part `part` of `parts`."""

    paths: tuple[str, ...]
    part: int = 0
    parts: int = 1


class EpubReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.content = options.get("content", "true").lower() != "false"
        self.files_each = int(options.get("filesPerPartition", 64))
        self.bytes_each = int(options.get("bytesPerPartition", 16 << 20))
        self.cap = int(options.get("maxBytes", 104_857_600))
        self.low, self.high, self.tests = 0, MOST, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes what bounds doc_idx or names paths. doc_idx filters go back to Spark as well: a file that is no book has a row without doc_idx."""
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column == ("path",) and isinstance(f, EqualTo | In | StringEndsWith | StringStartsWith):
                self.tests.append(f)
                continue
            if column == ("doc_idx",):
                if isinstance(f, EqualTo):
                    self.low, self.high = max(self.low, value), min(self.high, value)
                elif isinstance(f, In) and f.value:
                    self.low, self.high = max(self.low, min(value)), min(self.high, max(value))
                elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                    self.low = max(self.low, value + isinstance(f, GreaterThan))
                elif isinstance(f, LessThan | LessThanOrEqual):
                    self.high = min(self.high, value - isinstance(f, LessThan))
            yield f

    def _named(self, path: str) -> bool:
        for f in self.tests:
            if isinstance(f, EqualTo) and path != f.value or isinstance(f, In) and path not in f.value:
                return False
            if isinstance(f, StringEndsWith) and not path.endswith(f.value) or isinstance(f, StringStartsWith) and not path.startswith(f.value):
                return False
        return True

    def partitions(self) -> list[InputPartition]:
        """Lists the folder, on the driver: names and sizes alone. No archive is opened."""
        files, base = epub.place(self.folder)
        prefix = self.folder.removesuffix("/")[: -len(base.removesuffix("/"))] if self.folder.removesuffix("/").endswith(base.removesuffix("/")) else ""
        found = files.get_file_info(fs.FileSelector(base, recursive=True))
        found = sorted((prefix + x.path, x.size) for x in found if x.is_file and x.path.endswith(".epub") and x.size <= self.cap and not x.base_name.startswith(("_", ".")))
        found = [x for x in found if self._named(x[0])]
        small = [path for path, size in found if size <= self.bytes_each]
        out: list[InputPartition] = [Entries(tuple(small[i : i + self.files_each])) for i in range(0, len(small), self.files_each)]
        for path, size in found:
            parts = -(-size // self.bytes_each)
            out += [Entries((path,), k, parts) for k in range(parts)] if parts > 1 else []
        return out or [Entries(())]

    def read(self, partition: Entries) -> Iterator[tuple]:
        for path in partition.paths:
            files, own = epub.place(path)
            with files.open_input_file(own) as source:  # only what is asked for is read, not the file
                try:
                    book = epub.Archive(source)
                except epub.BROKEN as why:
                    if partition.part == 0:
                        yield path, None, None, None, epub.described(why)
                    continue
                n = len(book.names)
                begin, end = n * partition.part // partition.parts, n * (partition.part + 1) // partition.parts
                for i in range(max(begin, self.low), min(end, self.high + 1)):
                    yield (path, i, book.names[i], *(book.read(i) if self.content else (None, None if book.paths[i] in book.there else epub.MISSING)))


class EpubSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "epub"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> EpubReader:
        return EpubReader(self.options)


def register(spark: SparkSession) -> None:
    """Names the source in this session and lets filters reach it."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(EpubSource)


def read(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """(path, doc_idx, name, html, error) of all archives under a folder; what is no book, and documents that are missing, are rows with an error."""
    register(spark)
    return spark.read.format("epub").options(**options).load(folder)
