"""Folders of versions: data is staged under a name of its own, and one small file, put in place by an atomic rename, makes it the version that readers see.

A shelf is a folder with `staged/`, where writers leave tables, and `versions/`, whose files 000000001, 000000002, ... name them. A writer that dies between
staging and commit leaves a table that nobody reads; of two writers of one version the first to commit wins and the other fails. Files are reached by Spark's
file systems, from the driver only.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def _place(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, shelf: str) -> list[tuple[int, str]]:
    """(number, folder) of all versions, oldest first."""
    at, files = _place(spark, f"{shelf}/versions")
    if not files.exists(at):
        return []
    found = sorted(x.getPath().getName() for x in files.listStatus(at))
    return [(int(name), f"{shelf}/staged/{_line(spark, f'{shelf}/versions/{name}')}") for name in found if name.isdigit()]


def _line(spark: SparkSession, path: str) -> str:
    at, files = _place(spark, path)
    source = files.open(at)
    try:
        return source.readUTF()
    finally:
        source.close()


def latest(spark: SparkSession, shelf: str) -> tuple[int, str | None]:
    """The newest version and its folder; 0 and None if there is none."""
    return max(versions(spark, shelf), default=(0, None))


def stage(df: DataFrame, shelf: str, partition_by: tuple[str, ...] = ()) -> str:
    """Writes df under the shelf and returns its folder, which no reader knows yet."""
    folder = f"{shelf}/staged/{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(folder)
    return folder


class Taken(Exception):
    """Another writer has committed this version."""


def commit(spark: SparkSession, shelf: str, folder: str, number: int) -> None:
    """Makes a staged folder version `number`: all of it from one moment on. Raises Taken if that version is there already."""
    if any(n >= number for n, _ in versions(spark, shelf)):
        raise Taken(f"version {number} of {shelf}")
    name = folder.rsplit("/", 1)[1]
    draft, files = _place(spark, f"{shelf}/drafts/{name}")
    out = files.create(draft, True)
    out.writeUTF(name)
    out.close()
    final, _ = _place(spark, f"{shelf}/versions/{number:09d}")
    files.mkdirs(final.getParent())
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        # without the option to overwrite: what is there stays there
        context.rename(draft, final, spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
    except Py4JJavaError as why:
        if files.exists(final):
            raise Taken(f"version {number} of {shelf}") from why
        raise


def publish(df: DataFrame, shelf: str) -> DataFrame:
    """Stages df, commits it as the next version and reads it from there."""
    spark = df.sparkSession
    number = latest(spark, shelf)[0] + 1
    folder = stage(df, shelf)
    commit(spark, shelf, folder, number)
    return spark.read.schema(df.schema).parquet(folder)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder with all that it holds, if it is there."""
    at, files = _place(spark, path)
    files.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at, files = _place(spark, path)
    return files.exists(at)
