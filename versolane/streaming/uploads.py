"""Book files as they arrive: archives to chapters, analysed once for each content, merged by book from what is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analyze
from ..sources import epub
from .jobs import shared, started

#: Spark's setting for how many tasks look up a micro-batch's files, else one for each file.
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
FILES = "path string, modificationTime timestamp, length long, content binary"
#: book.vol-3.epub, or book.vol-3.anything.epub, is volume 3 of a book; a name without it is a book in one volume.
VOLUME = "([^/]*?)(?:\\.vol-([0-9]+)(?:\\.[^/]*)?)?\\.epub$"
PARTIAL = "content_hash string, book_id string, volume long, total_chars long, total_words long, num_chapters long, chapter_names array<string>, error string"


def partials(files: DataFrame) -> DataFrame:
    """PARTIAL rows of files (path, length, content): the analysis of each distinct content, under the name that comes first. What is no book has its error and zeros."""
    own = files.groupBy(F.sha2("content", 256).alias("content_hash")).agg(F.min(F.struct("path", "length", "content")).alias("f"))
    # hash and path stand for the file in what follows, so files are read and opened once
    chapters = epub.chapters(own.select(F.concat("content_hash", F.lit(" "), "f.path").alias("path"), "f.length", "f.content")).withColumnRenamed("path", "book_id")
    path = F.substr("book_id", F.lit(66))
    told = analyze.books(chapters, error="error").select(F.left("book_id", F.lit(64)).alias("content_hash"), path.alias("path"), "total_chars", "total_words", "num_chapters", "chapter_names", "error")
    volume = F.coalesce(F.nullif(F.regexp_extract("path", VOLUME, 2), F.lit("")).cast("long"), F.lit(0).cast("long"))
    return told.select("content_hash", F.regexp_extract("path", VOLUME, 1).alias("book_id"), volume.alias("volume"), "total_chars", "total_words", "num_chapters", "chapter_names", "error")


def arrive(spark: SparkSession, folder: str, store: str, offsets: str | None = None, files_per_batch: int = 1000) -> None:
    """Takes in all files under `folder` that weren't seen before. Each micro-batch writes the partial analyses of contents that are new, under its number, so a batch that runs again writes the same."""

    def work(batch: DataFrame, number: int) -> None:
        fresh = partials(batch)
        before = stored(spark, store)
        if before is not None:
            fresh = fresh.join(before.where(F.col("batch") < number).select("content_hash"), "content_hash", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{store}/batch={number:09d}")

    source = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.epub").load(folder)
    query = source.writeStream.foreachBatch(work).option("checkpointLocation", offsets or shared(spark, "offsets")).trigger(availableNow=True)
    started(spark, LISTING, str(2 * spark.sparkContext.defaultParallelism), lambda: query.start().awaitTermination())  # the source reads the session's setting in each micro-batch


def stored(spark: SparkSession, store: str) -> DataFrame | None:
    """All partial analyses with their batch, or None before the first."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema(f"{PARTIAL}, batch long").parquet(store)


def analysed(spark: SparkSession, store: str) -> DataFrame:
    """The analysis (see `analyze.books`) of all books that have arrived so far; contents that are no book count for nothing."""
    return analyze.merged(stored(spark, store).where("error IS NULL"))
