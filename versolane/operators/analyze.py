"""Book analysis and pricing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.html import heading, plain_text
from ..functions.text import scaled_estimate, trim_ws, word_count


def chapter_texts(chapters: DataFrame) -> DataFrame:
    return chapters.select("book_id", "doc_idx", "name", "html", plain_text(F.col("html")).alias("text"))


def books(chapters: DataFrame, of: DataFrame | None = None, names: int = 30, part: int = 512, error: str | None = None) -> DataFrame:
    """(book_id, total_chars, total_words, num_chapters, chapter_names, estimated_tokens) of HTML books.

    Chapters of ten characters or fewer don't count. At most `names` names are listed; the count is full. A book without counted chapters has zeros,
    as has one that `of` (book_id) lists and that has no chapter at all. Sums and names are made for each `part` chapters first: no list holds a book's names.
    With `error`, a column of chapters, a book also has the least one of its rows without a place, which say why it can't be read.
    """
    bad = [F.when(F.col("doc_idx").isNull(), F.col(error)).alias("error")] if error else []
    least = [F.min("error").alias("error")] if error else []
    rows = chapters.select("book_id", "doc_idx", "name", "html", plain_text(F.col("html")).alias("text"), *bad)
    rows = rows.select("book_id", "doc_idx", F.coalesce("text", F.lit("")).alias("text"), heading(F.col("html"), F.col("name")).alias("title"), *["error"] * bool(error))
    counts = F.length(trim_ws(F.col("text"))) > 10
    rows = rows.select("book_id", F.floor(F.col("doc_idx") / part).alias("part"), F.when(counts, F.length("text")).alias("n"), F.when(counts, word_count(F.col("text"))).alias("w"), F.when(counts, F.struct("doc_idx", "title")).alias("c"), *["error"] * bool(error))
    some = rows.groupBy("book_id", "part").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.count("c").alias("k"), F.slice(F.sort_array(F.collect_list("c")), 1, names).alias("c"), *least)
    # the first parts with any name hold all that are listed
    rank = F.row_number().over(Window.partitionBy("book_id").orderBy(F.col("k") == 0, "part"))
    some = some.withColumn("c", F.when(rank <= names, F.col("c")))
    out = some.groupBy("book_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_chars"), F.coalesce(F.sum("w"), F.lit(0)).alias("total_words"), F.sum("k").alias("num_chapters"), F.sort_array(F.flatten(F.collect_list("c"))).alias("c"), *least)
    out = out.select("book_id", "total_chars", "total_words", "num_chapters", F.transform(F.slice("c", 1, names), lambda x: x["title"]).alias("chapter_names"), *["error"] * bool(error))
    if of is not None:
        out = of.select("book_id").distinct().join(out, "book_id", "left").select("book_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total_chars", "total_words", "num_chapters")], F.coalesce("chapter_names", F.array().cast("array<string>")).alias("chapter_names"), *["error"] * bool(error))
    return out.withColumn("estimated_tokens", scaled_estimate(F.col("total_chars") + F.col("num_chapters")))


def paged_books(pages: DataFrame) -> DataFrame:
    """(book_id, total_chars, total_words, num_pages, estimated_tokens) of paged books. Empty pages count as pages only."""
    n = F.coalesce(F.length("text"), F.lit(0))
    rows = pages.select("book_id", n.alias("n"), word_count(F.col("text")).alias("w"))
    out = rows.groupBy("book_id").agg(F.sum("n").cast("long").alias("total_chars"), F.sum("w").cast("long").alias("total_words"), F.count("*").alias("num_pages"), F.sum(F.when(F.col("n") > 0, F.col("n") + 1).otherwise(0)).alias("all"))
    return out.select("book_id", "total_chars", "total_words", "num_pages", scaled_estimate(F.col("all")).alias("estimated_tokens"))


def either(html: DataFrame, paged: DataFrame) -> DataFrame:
    """Both analyses under one schema, told apart by file_type; what a type lacks is null."""
    a, b = html.withColumn("file_type", F.lit("epub")), paged.withColumn("book_id", F.col("book_id").cast("string")).withColumn("file_type", F.lit("pdf"))
    return a.unionByName(b, allowMissingColumns=True)


def priced(analysis: DataFrame, models: DataFrame, expansion: float = 1.0) -> DataFrame:
    """(book_id, model, input_usd, output_usd, total_usd): every book with every model. The catalogue has a fixed number of rows."""
    rows = analysis.select("book_id", "estimated_tokens").crossJoin(F.broadcast(models.select("model", "input_cost", "output_cost")))
    tokens = F.col("estimated_tokens") / F.lit(1e6)
    rows = rows.select("book_id", "model", (tokens * F.col("input_cost")).alias("input_usd"), (tokens * F.lit(expansion) * F.col("output_cost")).alias("output_usd"))
    return rows.withColumn("total_usd", F.col("input_usd") + F.col("output_usd"))


def heads(pieces: DataFrame, cap: int = 50_000, part: int = 512) -> DataFrame:
    """(book_id, head, length) of (book_id, idx, piece): the first `cap` characters of a book's pieces put together in order, and the length of all.

    Lengths by part of a book say where each part begins; text moves only for pieces that reach into the head. No task holds a book.
    """
    rows = pieces.select("book_id", F.floor(F.col("idx") / part).alias("part"), "idx", "piece").where(F.length("piece") > 0)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("book_id", "part").agg(F.sum(F.length("piece")).alias("n"))
    parts = parts.select(F.col("book_id").alias("b"), F.col("part").alias("p"), "n", F.coalesce(F.sum("n").over(before.partitionBy("book_id")), F.lit(0)).alias("start"))
    near = rows.join(parts.where(F.col("start") < cap), F.col("book_id").eqNullSafe(F.col("b")) & (F.col("part") == F.col("p")))
    inner = Window.partitionBy("book_id", "part").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("start") + F.coalesce(F.sum(F.length("piece")).over(inner), F.lit(0))
    cut = near.select("book_id", "idx", at.alias("at"), "piece").where(F.col("at") < cap).select("book_id", "idx", F.left("piece", (F.lit(cap) - F.col("at")).cast("int")).alias("piece"))
    head = cut.groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct("idx", "piece"))).alias("all"))  # cap characters at most
    total = parts.groupBy("b").agg(F.sum("n").alias("length"))
    return head.select("book_id", F.array_join(F.transform("all", lambda x: x["piece"]), "").alias("head")).join(total, F.col("book_id").eqNullSafe(F.col("b"))).drop("b")


def encoded_estimate(pieces: DataFrame, count: Callable[[Column], Column], cap: int = 50_000) -> DataFrame:
    """(book_id, estimated_tokens): tokens of a book's first `cap` characters by `count` (see `functions.text.token_counter`), scaled up to its length."""
    rows = heads(pieces, cap).select("book_id", count(F.col("head")).alias("tokens"), "length")
    return rows.select("book_id", F.when(F.col("length") > cap, F.floor(F.col("tokens") * (F.col("length") / F.lit(float(cap))))).otherwise(F.col("tokens")).cast("long").alias("estimated_tokens"))


def chapter_pieces(chapters: DataFrame) -> DataFrame:
    """(book_id, idx, piece): the texts of chapters that count, each with a line end."""
    return chapter_texts(chapters).where(F.length(trim_ws(F.col("text"))) > 10).select("book_id", F.col("doc_idx").alias("idx"), F.concat("text", F.lit("\n")).alias("piece"))


def page_pieces(pages: DataFrame) -> DataFrame:
    """(book_id, idx, piece): the texts of pages (book_id, page_no, text) that hold any, each with a line end."""
    return pages.where(F.length("text") > 0).select("book_id", F.col("page_no").alias("idx"), F.concat("text", F.lit("\n")).alias("piece"))


def merged(partials: DataFrame, names: int = 30) -> DataFrame:
    """The analysis of books that came in volumes: (book_id, volume) and the columns of `books`, one row for each volume, put together."""
    rank = F.row_number().over(Window.partitionBy("book_id").orderBy(F.col("num_chapters") == 0, "volume"))
    # the first volumes with any name hold all that are listed
    some = partials.withColumn("c", F.when(rank <= names, F.struct("volume", "chapter_names")))
    out = some.groupBy("book_id").agg(*[F.sum(c).alias(c) for c in ("total_chars", "total_words", "num_chapters")], F.sort_array(F.collect_list("c")).alias("c"))
    listed = F.slice(F.flatten(F.transform("c", lambda x: x["chapter_names"])), 1, names)
    return out.select("book_id", "total_chars", "total_words", "num_chapters", listed.alias("chapter_names"), scaled_estimate(F.col("total_chars") + F.col("num_chapters")).alias("estimated_tokens"))
