"""Job control as data: validation, progress, state folded from events, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import EXTENSIONS, extension

CAP = 104_857_600  # bytes


def validated(manifest: DataFrame, models: DataFrame, providers: DataFrame, *carry: str) -> DataFrame:
    """Each job with the provider its model belongs to, and the first rule that it breaks, null if none.

    Rules in order: a file name, a known extension, at most 100 MiB, two languages, a known model, an available provider.
    Missing languages, provider and model take their defaults. The stated provider gives way to the model's. Columns named in `carry` go along.
    """
    rows = manifest.withColumns({"source_lang": F.coalesce("source_lang", F.lit("English")), "target_lang": F.coalesce("target_lang", F.lit("Italian")), "provider": F.coalesce("provider", F.lit("anthropic")), "model": F.coalesce("model", F.lit("claude-sonnet-4-20250514"))})
    own = models.select("model", F.col("provider").alias("own"))
    rows = rows.join(F.broadcast(own), "model", "left").join(F.broadcast(providers.select(F.col("provider").alias("own"), "available")), "own", "left")
    ext = extension(F.col("original_filename"))
    error = (
        F.when(F.coalesce(F.col("original_filename"), F.lit("")) == "", "no file name")
        .when(~ext.isin(*EXTENSIONS), "bad extension")
        .when(F.col("length") > CAP, "too large")
        .when(F.col("source_lang") == F.col("target_lang"), "same language")
        .when(F.col("own").isNull(), "unknown model")
        .when(~F.coalesce("available", F.lit(False)), "provider not available")
    )
    return rows.select("job_id", "original_filename", ext.alias("ext"), "source_lang", "target_lang", "model", F.coalesce("own", "provider").alias("provider"), error.alias("error"), *carry)


def chapter_progress(units: DataFrame) -> DataFrame:
    """(book_id, doc_idx, block_no, progress) of (book_id, doc_idx, block_no): where a job stands after each block; block_no null marks a skipped chapter.

    Within a chapter progress stays under 0.99; a skipped one reports its own end, uncapped.
    """
    by = Window.partitionBy("book_id", "doc_idx")
    total = units.groupBy("book_id").agg(F.countDistinct("doc_idx").cast("double").alias("d"))
    rows = units.select("*", F.row_number().over(by.orderBy("block_no")).alias("cur"), F.greatest(F.count("block_no").over(by), F.lit(1)).alias("b")).join(total, "book_id")
    inside = F.least(F.col("doc_idx") / F.col("d") + F.col("cur") / F.col("b") / F.col("d"), F.lit(0.99))
    return rows.select("book_id", "doc_idx", "block_no", F.when(F.col("block_no").isNull(), (F.col("doc_idx") + 1) / F.col("d")).otherwise(inside).alias("progress"))


#: How every book ends: it is saved, then done.
CLOSING = (("saving", 0.99, "Saving the book"), ("done", 1.0, "Done"))
EMPTY = ("done", 1.0, "Done: nothing to translate")
SHOWN = 60  # characters of an error that are shown


def totals(units: DataFrame) -> DataFrame:
    """(book_id, doc_idx, blocks, chapters, units) of (book_id, doc_idx, block_no): what a chapter and its book hold. A chapter that is skipped, or that failed, is one unit without block_no."""
    each = units.groupBy("book_id", "doc_idx").agg(F.count("block_no").alias("blocks"), F.count("*").alias("n"))
    book = each.groupBy(F.col("book_id").alias("b")).agg(F.count("*").alias("chapters"), F.sum("n").alias("units"))
    return each.join(book, F.col("book_id").eqNullSafe(F.col("b"))).select("book_id", "doc_idx", "blocks", "chapters", "units")


def placed(answers: DataFrame, held: DataFrame) -> DataFrame:
    """Answers (book_id, doc_idx, block_no from 0, error), streamed or not, with where a job stands after each: step, progress, message.

    A block stands within its chapter, under 0.99. A chapter that is skipped or has failed stands at its end, the failure with the start of its error.
    """
    rows = answers.join(held, ["book_id", "doc_idx"])
    chapter = F.concat(F.lit("Chapter "), (F.col("doc_idx") + 1).cast("string"), F.lit("/"), F.col("chapters").cast("string"))
    inside = F.least(F.col("doc_idx") / F.col("chapters") + (F.col("block_no") + 1) / F.greatest("blocks", F.lit(1)) / F.col("chapters"), F.lit(0.99))
    failed, block = F.col("error").isNotNull(), F.col("block_no").isNotNull()
    step = F.when(failed, "failed").when(block, "block").otherwise("skipped")
    progress = F.when(failed | ~block, (F.col("doc_idx") + 1) / F.col("chapters")).otherwise(inside)
    told = F.when(failed, F.concat(F.lit(" - failed: "), F.left("error", F.lit(SHOWN)))).when(block, F.concat(F.lit(" - block "), (F.col("block_no") + 1).cast("string"), F.lit("/"), F.col("blocks").cast("string"))).otherwise(F.lit(" - skipped, no text"))
    return rows.select("book_id", "doc_idx", "block_no", step.alias("step"), progress.alias("progress"), F.concat(chapter, told).alias("message"), "units")


def book_progress(answers: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(book_id, doc_idx, block_no, step, progress, message): `placed` for answers that are all there, with the rows that close each book. Books of `of` (book_id) without any unit are done at once."""
    rows = placed(answers, totals(answers)).drop("units")
    end = F.explode(F.array(*[F.struct(F.lit(step).alias("step"), F.lit(progress).alias("progress"), F.lit(message).alias("message")) for step, progress, message in CLOSING])).alias("c")
    closed = answers.select("book_id").distinct().select("book_id", end).select("book_id", "c.*")
    if of is not None:
        step, progress, message = EMPTY
        empty = of.select("book_id").distinct().join(answers.select("book_id"), "book_id", "left_anti")
        closed = closed.unionByName(empty.select("book_id", F.lit(step).alias("step"), F.lit(progress).alias("progress"), F.lit(message).alias("message")))
    return rows.unionByName(closed, allowMissingColumns=True)


def page_progress(groups: DataFrame, pages: DataFrame) -> DataFrame:
    """(book_id, page_no, gid, started, grouped, progress): a page's start, its start of translation, and where the job stands after each group."""
    total = pages.groupBy("book_id").agg(F.count("*").cast("double").alias("p"))
    rows = groups.select("book_id", "page_no", "gid", F.count("*").over(Window.partitionBy("book_id", "page_no")).alias("n")).join(total, "book_id")
    page = F.col("page_no") / F.col("p")
    return rows.select("book_id", "page_no", "gid", page.alias("started"), (page + F.lit(0.3) / F.col("p")).alias("grouped"), F.least((F.col("page_no") + (F.col("gid") + 1) / F.col("n")) / F.col("p"), F.lit(0.99)).alias("progress"))


#: The state that an event puts a job in.
STATES = {"started": "processing", "progress": "processing", "completed": "completed", "error": "error"}


def status(events: DataFrame) -> DataFrame:
    """(job_id, status, progress, text, logs): the state after the latest event by (ts, event_id); progress of the latest event that has one. Works on a stream as well."""
    at = F.struct("ts", "event_id")
    state = F.element_at(F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair]), F.max_by("kind", at))
    return events.groupBy("job_id").agg(state.alias("status"), F.coalesce(F.max_by("progress", F.when(F.col("progress").isNotNull(), at)), F.lit(0.0)).alias("progress"), F.max_by("message", at).alias("text"), F.count("*").alias("logs"))


def lookup(asked: DataFrame, state: DataFrame, outputs: DataFrame | None = None) -> DataFrame:
    """(job_id, code): what a download request gets: 404 for an unknown job, 400 for one that isn't completed, 404 if its output is gone, else 200. outputs (job_id) are those that are there; None: all are."""
    code = F.when(F.col("status").isNull(), 404).when(F.col("status") != "completed", 400)
    if outputs is not None:
        asked = asked.join(outputs.select("job_id", F.lit(True).alias("there")).distinct(), "job_id", "left")
        code = code.when(F.col("there").isNull(), 404)
    code = code.otherwise(200)
    return asked.join(state.select("job_id", "status"), "job_id", "left").select("job_id", code.alias("code"))
