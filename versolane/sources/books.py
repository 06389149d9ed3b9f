"""Finished books as files: the chapters of each under a folder of its own, in order, with the language they are now in; published whole or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import language_code
from . import shelf

CHAPTERS = "doc_idx int, name string, html string, language string, book_id string"


def _finished(chapters: DataFrame) -> DataFrame:
    return chapters.select("book_id", "doc_idx", "name", "html", language_code(F.col("target_lang")).alias("language"))


def _dealt(rows: DataFrame) -> DataFrame:
    """Chapters by ranges of (book, place), so a large book is written by several tasks, each of which holds few books."""
    return rows.repartitionByRange("book_id", "doc_idx").sortWithinPartitions("book_id", "doc_idx")


def write(chapters: DataFrame, out: str) -> None:
    """Chapters (book_id, doc_idx, name, html, target_lang) under out/book_id=...: doc_idx, name, html and language, the code of target_lang."""
    _dealt(_finished(chapters)).write.partitionBy("book_id").parquet(out)


def read(spark: SparkSession, out: str) -> DataFrame:
    """(book_id, doc_idx, name, html, language) of books that `write` put there."""
    return spark.read.schema(CHAPTERS).parquet(out).select("book_id", "doc_idx", "name", "html", "language")


def _marks(rows: DataFrame) -> DataFrame:
    """(book_id, n_chapters, mark): what tells two states of a book apart. Sums, so no task holds a book."""
    parts = [F.sum(F.xxhash64(F.lit(salt), "doc_idx", "name", "html", "language").cast("decimal(38,0)")).cast("string") for salt in (1, 2)]
    return rows.groupBy("book_id").agg(F.count("*").alias("n_chapters"), F.concat_ws("/", *parts).alias("mark"))


def manifest(spark: SparkSession, out: str) -> DataFrame:
    """(book_id, n_chapters, mark, data) of all published books; data is the folder that holds a book's chapters."""
    _, folder = shelf.latest(spark, out)
    kind = "book_id string, n_chapters long, mark string, data string"
    return spark.read.schema(kind).parquet(folder) if folder else spark.createDataFrame([], kind)


def outputs(spark: SparkSession, out: str) -> DataFrame:
    """(job_id) of the books that can be downloaded: those in the newest manifest, see `operators.jobs.lookup`."""
    return manifest(spark, out).select(F.col("book_id").alias("job_id"))


def publish(chapters: DataFrame, out: str) -> int:
    """Publishes books on the shelf `out` and returns the shelf's version.

    Books that are there with the same chapters are left as they are; if all are, no version is made. Others are staged, each under a folder of its own, and take the place of what
    was there at once, when the new manifest is committed. Books that `chapters` doesn't name stay published. A run that dies before the commit changes nothing that readers see.
    """
    spark = chapters.sparkSession
    number, _ = shelf.latest(spark, out)
    rows = _finished(chapters)
    old, new = manifest(spark, out), _marks(rows)
    changed = new.join(old.select("book_id", F.col("mark").alias("before")), "book_id", "left").where("before IS NULL OR before <> mark").drop("before")
    listed = shelf.stage(changed, f"{out}/work")  # read twice, worked out once
    changed = spark.read.schema(changed.schema).parquet(listed)
    if changed.isEmpty():
        return number
    data = shelf.stage(_dealt(rows.join(changed.select("book_id"), "book_id", "left_semi")), f"{out}/data", ("book_id",))
    after = old.join(changed.select("book_id"), "book_id", "left_anti").unionByName(changed.withColumn("data", F.lit(data)))
    shelf.commit(spark, out, shelf.stage(after, out), number + 1)
    return number + 1


def published(spark: SparkSession, out: str) -> DataFrame:
    """(book_id, doc_idx, name, html, language) of the books in the newest manifest."""
    books = manifest(spark, out)
    folders = [r["data"] for r in books.select("data").distinct().collect()]  # one for each run that published
    if not folders:
        return spark.createDataFrame([], CHAPTERS).select("book_id", "doc_idx", "name", "html", "language")
    rows = [read(spark, folder).withColumn("data", F.lit(folder)) for folder in folders]
    all_ = rows[0]
    for more in rows[1:]:
        all_ = all_.unionByName(more)
    return all_.join(books.select("book_id", "data"), ["book_id", "data"], "left_semi").drop("data")
