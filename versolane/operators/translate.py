"""The translate step: requests, ordered runs through a backend with retries, fallbacks, and what is put back together.

A backend is a function (text, context) -> response that may raise. It is called inside Python workers, once for each unit and attempt.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_response, sendable
from ..sources import shelf
from ..sources.catalog import COMPLETION_CAP
from . import batches
from .batches import Batch

Backend = Callable[[str, str], "str | None"]

CONTEXT, CAP, TEMPERATURE = 800, 8192, 0.3
SHOWN = 60  # characters of an error that are kept
SYSTEM = "Translate literary text from {source} into {target}. Keep markup, names, numbers and paragraph breaks. Answer with the translation only."
BEFORE = "What precedes, already translated; use it for terms and tone only:\n---\n{context}\n---\nTranslate what follows."


def system_prompt(source: Column, target: Column) -> Column:
    return F.replace(F.replace(F.lit(SYSTEM), F.lit("{source}"), source), F.lit("{target}"), target)


def user_message(text: Column, context: Column) -> Column:
    last = F.right(context, F.lit(CONTEXT))
    return F.when(F.length(F.coalesce(context, F.lit(""))) > 0, F.concat(F.replace(F.lit(BEFORE), F.lit("{context}"), last), F.lit("\n\n"), text)).otherwise(text)


def requests(units: DataFrame, models: DataFrame) -> DataFrame:
    """Units (with text, context, source_lang, target_lang, model) as requests: system, user, temperature, token_param, max_out, provider. Units that need no backend are left out."""
    rows = units.where(sendable(F.col("text"))).join(F.broadcast(models.select("model", "provider")), "model")
    cap = F.when((F.col("provider") == "openai") & F.col("model").isin(*COMPLETION_CAP), "max_completion_tokens").otherwise("max_tokens")
    return rows.withColumns({"system": system_prompt(F.col("source_lang"), F.col("target_lang")), "user": user_message(F.col("text"), F.col("context")), "temperature": F.lit(TEMPERATURE), "token_param": cap, "max_out": F.lit(CAP)}).drop("text", "context")


def echo(text: str, context: str) -> str:
    """A stand-in backend: the text, marked by four hex digits of its context."""
    return f"[{hashlib.md5(context.encode()).hexdigest()[-4:]}] {text}"


def call(backend: Backend, text: str, context: str, tries: int, wait: Callable[[float], None]) -> tuple[str | None, int, str | None]:
    """(answer, attempts, error): waits 1, 2, 4, ... seconds after failures but the last."""
    for attempt in range(tries):
        try:
            return backend(text, context), attempt + 1, None
        except Exception as why:  # any failure of a backend is tried again
            error = str(why)[:SHOWN]
            if attempt < tries - 1:
                wait(2.0**attempt)
    return None, tries, error


def run_units(units: DataFrame, backend: Backend, scope: str = "seq_key", order: str = "pos", text: str = "text", tries: int = 3, advance_on_failure: bool = False, wait: Callable[[float], None] = time.sleep, carry: tuple[str, ...] = ()) -> DataFrame:
    """(scope, order, text, translated, attempts, error): the units of a scope one after the other, each with the end of the answer before it.

    A scope is a chapter, a book or a text: it runs in one task, row by row, and no scope is held in memory.
    Blank units and those of digits and punctuation pass through, and are the next unit's context. A failed unit keeps its
    source, and doesn't change the context. translated: as cleaned, source where nothing came back. Columns named in `carry` go along.

    The frame is lazy: each use of it calls the backend again. Use it once, or see `stored`.
    """
    kinds = {c: units.schema[c].dataType.simpleString() for c in (scope, order)}
    along = "".join(f"{c} {units.schema[c].dataType.simpleString()}, " for c in carry)
    rows = units.select(scope, order, *carry, F.col(text).alias("text"), sendable(F.col(text)).alias("send"))
    rows = rows.repartition(scope).sortWithinPartitions(scope, order)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, context = object(), ""
        for batch in parts:
            answers = []
            for key, source, send in zip(batch[scope], batch["text"], batch["send"]):
                if key != here:
                    here, context = key, ""
                answer, attempts, error = call(backend, source, context[-CONTEXT:], tries, wait) if send else (source, 0, None)
                answers.append((answer, attempts, error))
                done = source if not answer or error else answer.strip() if send else answer
                if error is None or advance_on_failure:
                    context = done or ""
            got = pd.DataFrame(answers, columns=["answer", "attempts", "error"], index=batch.index)
            yield pd.concat([batch, got], axis=1)

    out = rows.mapInPandas(run, f"{scope} {kinds[scope]}, {order} {kinds[order]}, {along}text string, send boolean, answer string, attempts int, error string")
    done = F.when(F.col("error").isNotNull() | ~F.col("send"), F.col("text")).otherwise(clean_response(F.col("answer"), F.col("text")))
    return out.select(scope, order, *carry, "text", done.alias("translated"), "attempts", "error")


def stored(units: DataFrame, store: str, backend: Backend, scope: str = "seq_key", order: str = "pos", text: str = "text", settings: str = "", batch: Batch | None = None, **how) -> DataFrame:
    """The units' translations, kept in the folder `store`: its newest version holds exactly these units, and a plan that reads it calls no backend.

    A request that was answered before, in this run or an earlier one, isn't sent again, even if the run that sent it failed: `batches` says how requests are told apart. `settings` names what else
    answers depend on, such as model and languages; other settings ask anew. A failed unit is asked again, and those behind it if its answer changes their context.
    `batch` is a backend that takes many requests a call; without it `backend` is called for each. A version appears whole or not at all.
    """
    spark = units.sparkSession
    _, folder = shelf.latest(spark, store)
    known = spark.read.parquet(folder).where("request IS NOT NULL AND error IS NULL").select(F.col(scope).cast("string").alias("scope"), F.col(order).cast("string").alias("place"), "request", "answer") if folder else None
    done = batches.fresh(units, batch or batches.singly(backend), f"{store}/journal", scope=scope, order=order, text=text, settings=settings, known=known, **how)
    kept = shelf.publish(done, store)
    shelf.remove(spark, f"{store}/journal")  # the version holds its answers now
    return kept


def attempts_report(done: DataFrame) -> DataFrame:
    """How each unit fared: attempts, seconds waited between them, outcome."""
    outcome = F.when(F.col("error").isNotNull(), "failed").when(F.col("attempts") == 0, "passed").otherwise("ok")
    waited = F.when(F.col("attempts") > 0, F.pow(F.lit(2.0), F.col("attempts") - 1) - 1).otherwise(F.lit(0.0))
    return done.select("seq_key", "pos", "attempts", waited.cast("long").alias("waited"), outcome.alias("outcome"))


def fallbacks(done: DataFrame, scope: str = "seq_key") -> DataFrame:
    """done with n_failed, the failures of the scope, and both texts that may be put back, from one pass.

    as_chapter: one failed unit gives its whole chapter its source again. as_group: only the failed unit keeps its source.
    """
    rows = done.withColumn("n_failed", F.sum(F.col("error").isNotNull().cast("long")).over(Window.partitionBy(scope)))
    kept = lambda keep: F.when(keep, F.col("text")).otherwise(F.col("translated"))
    return rows.withColumns({"as_chapter": kept(F.col("n_failed") > 0), "as_group": kept(F.col("error").isNotNull())})


def with_fallback(done: DataFrame, whole_scope: bool, scope: str = "seq_key") -> DataFrame:
    """The text that is put back, as `final`: that of a chapter (whole_scope) or that of a group."""
    return fallbacks(done, scope).withColumn("final", F.col("as_chapter" if whole_scope else "as_group")).drop("as_chapter", "as_group")
