"""Boilerplate lines by their site-relative frequency: the distinct texts of a host that hold a line, over all distinct texts of that host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

EDGES = "^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$"


def _line(line: Column) -> Column:
    return F.xxhash64(F.regexp_replace(line, EDGES, ""))


def drop_boilerplate(df: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", percent: int = 5, min_pages: int = 5) -> DataFrame:
    """df with each text's boilerplate lines dropped, and two more columns: n_lines and n_dropped.

    A line, compared without white space at its ends, is boilerplate on a host if at least `min_pages` and over
    `percent` per cent of the host's pages hold it. Rows of a host with the same text are one page, so a text that is
    copied often doesn't make its own lines boilerplate. Lines without any word are never dropped. The other lines keep their order and bytes.
    Null hosts are one host. A null text stays null, with 0 lines; an empty text has 1 line. A text of boilerplate only becomes empty.
    Rows that share a key lose the same lines. Rows with a null key count as pages and lose nothing.
    Further columns pass through; those named n_lines or n_dropped are replaced. An empty table gives an empty result.
    """
    own = df.select(F.col(key).alias("__key"), F.coalesce(F.col(host), F.lit("")).alias("__host"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    own = own.withColumn("__page", F.xxhash64("__text"))
    # a line may stand on a page twice: once is enough, and within a row that needs no shuffle
    marks = F.array_distinct(F.transform(F.filter(F.split("__text", "\n"), lambda x: F.regexp_replace(x, EDGES, "") != ""), _line))
    held = saved(own.select("__key", "__host", "__page", F.explode(marks).alias("__line")), "lines")  # read twice, made once
    pages = own.select("__host", "__page").distinct().groupBy("__host").agg(F.count("*").alias("__pages"))
    often = held.select("__host", "__page", "__line").distinct().groupBy("__host", "__line").agg(F.count("*").alias("__n")).where(F.col("__n") >= min_pages)
    often = often.join(pages, "__host").where(F.col("__n") * 100 > F.col("__pages") * percent).select("__host", "__line")
    # a page's list is no longer than its lines; a host's is bounded by its lines a page * 100 / percent
    drops = held.where(F.col("__key").isNotNull()).join(often, ["__host", "__line"]).groupBy("__key").agg(F.collect_set("__line").alias("__drops")).withColumnRenamed("__key", "__k")
    lines = F.split(F.col(text), "\n")
    rest = F.when(F.col("__drops").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains("__drops", _line(x)) | (F.regexp_replace(x, EDGES, "") == "")))
    kept = [c for c in df.columns if c not in ("n_lines", "n_dropped")]
    out = df.select(*kept).join(drops, F.col(key) == F.col("__k"), "left").withColumn("__rest", rest)
    n, m = F.coalesce(F.size(lines), F.lit(0)), F.coalesce(F.size("__rest"), F.lit(0))
    n, m = F.greatest(n, F.lit(0)).cast("long"), F.greatest(m, F.lit(0)).cast("long")
    return out.select(*[F.array_join("__rest", "\n").alias(c) if c == text else F.col(c) for c in kept], n.alias("n_lines"), (n - m).alias("n_dropped"))
