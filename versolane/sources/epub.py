"""EPUB archives as a source: one row for each HTML document, in the order of the package."""

from __future__ import annotations

import io
import posixpath
import re
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

KINDS = ("application/xhtml+xml", "text/html")


class Archive:
    """An open archive: the HTML documents that its manifest lists, each read when it is asked for."""

    def __init__(self, content: bytes | BinaryIO):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(content) if isinstance(content, bytes) else content)
        except pa.ArrowInvalid as why:  # Arrow's files say so of a place before their start, where a file is too short for an archive
            raise zipfile.BadZipFile("File is not a zip file") from why
        box = ElementTree.fromstring(self.zip.read("META-INF/container.xml"))
        package = next(x.get("full-path") for x in box.iter() if x.tag.endswith("rootfile"))
        root = posixpath.dirname(package)
        items = [x for x in ElementTree.fromstring(self.zip.read(package)).iter() if x.tag.endswith("}item") or x.tag == "item"]
        #: As the manifest spells them, in its order.
        self.names = [x.get("href") for x in items if x.get("media-type") in KINDS]
        self.paths = [posixpath.normpath(posixpath.join(root, unquote(n or ""))) for n in self.names]
        self.there = set(self.zip.namelist())

    def read(self, i: int) -> tuple[str | None, str | None]:
        """(html, error) of a document. Percent-encoded names are decoded; bytes that are no UTF-8 become U+FFFD. A document that isn't there, or is damaged, has an error."""
        if self.paths[i] not in self.there:
            return None, MISSING
        try:
            return self.zip.read(self.paths[i]).decode("utf-8", "replace"), None
        except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError) as why:
            return None, described(why)


MISSING = "not in the archive"
#: What an archive that is no book raises when it is opened.
BROKEN = (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError)


def described(why: Exception) -> str:
    return f"{type(why).__name__}: {why}"[:60]


def archive(names: list[str], pages: list[str]) -> bytes:
    """A small archive with a manifest: what the reader needs, for tests and hand-over."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>')
        items = "".join(f'<item id="c{i}" href="{n}" media-type="{KINDS[0]}"/>' for i, n in enumerate(names))
        z.writestr("OEBPS/content.opf", f'<package xmlns="http://www.idpf.org/2007/opf"><manifest>{items}</manifest></package>')
        for n, page in zip(names, pages, strict=True):
            z.writestr(f"OEBPS/{unquote(n)}", page)
    return out.getvalue()


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system that a path or URI is on, and its path there."""
    return fs.FileSystem.from_uri(path) if re.match("[a-z0-9+]+:", path) else (fs.LocalFileSystem(), path)


def put(folder: str, name: str, content: bytes) -> None:
    """Writes a file into a folder that workers share, whole or not at all. Any folder that pyarrow's file systems reach."""
    files, base = place(folder)
    files.create_dir(base, recursive=True)
    draft = f"{base}/_{uuid.uuid4().hex}"
    with files.open_output_stream(draft) as out:
        out.write(content)
    files.move(draft, f"{base}/{name}")


def chapters(files: DataFrame, cap: int = 104_857_600) -> DataFrame:
    """(path, doc_idx, name, html, error) of files (path, length, content), as spark.read.format("binaryFile") gives them.

    Larger files give no row. What can't be read as a book gives one row, with its error alone; a document that the manifest names and the archive lacks has its place, name and error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    book = Archive(bytes(content))
                    rows = [(path, i, name, *book.read(i)) for i, name in enumerate(book.names)]
                except BROKEN as why:
                    rows = [(path, None, None, None, described(why))]
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "doc_idx", "name", "html", "error"]).astype({"doc_idx": "Int32"})

    return files.where(files.length <= cap).select("path", "content").mapInPandas(run, "path string, doc_idx int, name string, html string, error string")


def read(spark: SparkSession, path: str) -> DataFrame:
    return chapters(spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").load(path))
