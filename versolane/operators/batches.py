"""Ordered units through a backend that answers many requests in one call: a wavefront over scopes.

Within a scope each unit needs the answer before it, so a worker can't send a scope's units together; but it can send unit i of many scopes together.
Scopes are dealt into lanes of `width`, those of like length side by side, and a lane runs wave by wave: one call of the backend for the open units of a wave.
What is in memory is a wave and the context of each open scope, not the scopes.

A backend is paid for, and Spark may run a task again. Each answer is therefore kept under its request, a digest of run settings, text and context:

- A journal is a folder that workers write as they go, a small file for each call. A task that runs again reads its wave's files first.
- `known` are answers of earlier runs as a table; they travel with the units.

Either is used only where the very same request comes up again. A unit that changed, one behind it whose context changed, other settings or an earlier failure all make a new request.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean_response, sendable
from ..sources import shelf

#: Takes (text, context) pairs, returns for each an answer, None, or the exception that it met.
Batch = Callable[[Sequence[tuple[str, str]]], Sequence["str | None | Exception"]]

CONTEXT = 800
SHOWN = 60  # characters of an error that are kept
KNOWN = "scope string, place string, request string, answer string"


def singly(backend: Callable[[str, str], str | None]) -> Batch:
    """A backend for batches out of one for single requests."""

    def one(text: str, context: str) -> str | None | Exception:
        try:
            return backend(text, context)
        except Exception as why:  # any failure is the request's own
            return why

    return lambda requests: [one(*r) for r in requests]


def request_id(settings: str, text: str, context: str) -> str:
    parts = (settings, text, context)
    return hashlib.sha256("".join(f"{len(p)}:{p}" for p in parts).encode()).hexdigest()


class Journal:
    """Answers of one wave, in files that are whole or not there. Any folder that pyarrow's file systems reach from the workers."""

    def __init__(self, folder: str, lane: str, wave: int):
        self.files, base = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        self.folder = f"{base}/lane={lane}/wave={wave}"

    def read(self) -> dict[str, str | None]:
        found: dict[str, str | None] = {}
        for info in self.files.get_file_info(fs.FileSelector(self.folder, allow_not_found=True)):
            if not info.base_name.startswith(("_", ".")):
                with self.files.open_input_stream(info.path) as f:
                    found.update((x["request"], x["answer"]) for x in map(json.loads, f.read().decode().splitlines()))
        return found

    def write(self, rows: list[dict]) -> None:
        self.files.create_dir(self.folder, recursive=True)
        name = uuid.uuid4().hex
        with self.files.open_output_stream(f"{self.folder}/_{name}") as f:
            f.write("".join(json.dumps(r) + "\n" for r in rows).encode())
        self.files.move(f"{self.folder}/_{name}", f"{self.folder}/{name}.json")


def journalled(spark: SparkSession, folder: str) -> DataFrame:
    """What a journal holds, as `known` answers."""
    return spark.read.schema(KNOWN).option("recursiveFileLookup", "true").json(folder)


def ask(backend: Batch, requests: list[tuple[str, str]], tries: int, wait: Callable[[float], None], keep: Callable[[dict[int, str | None]], None]) -> list[tuple[str | None, int, str | None]]:
    """(answer, attempts, error) of each request. What failed is sent again, together, after 1, 2, 4, ... seconds; `keep` gets what each call has answered."""
    out: list[tuple[str | None, int, str | None]] = [(None, 0, None)] * len(requests)
    left = list(range(len(requests)))
    for attempt in range(tries):
        if not left:
            break
        if attempt:
            wait(2.0 ** (attempt - 1))
        try:
            got = list(backend([requests[i] for i in left]))
            if len(got) != len(left):
                raise ValueError(f"{len(got)} answers to {len(left)} requests")
        except Exception as why:  # a call that fails as a whole fails for each of its requests
            got = [why] * len(left)
        failed = {i for i, x in zip(left, got) if isinstance(x, Exception)}
        for i, x in zip(left, got):
            out[i] = (None, attempt + 1, str(x)[:SHOWN]) if i in failed else (x, attempt + 1, None)
        keep({i: x for i, x in zip(left, got) if i not in failed})
        left = [i for i in left if i in failed]
    return out


def lanes(units: DataFrame, scope: str, order: str, width: int) -> DataFrame:
    """units with lane_a, lane_b and wave: lanes of at most `width` scopes, the longest scopes first, and each unit's number in its scope.

    There are as many lanes side by side as shuffle partitions, or fewer, so that calls stay full.
    """
    sizes = units.groupBy(F.col(scope).alias("of")).agg(F.count("*").alias("n"))
    parts = max(1, min(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sizes.count() // width)))
    dealt = sizes.withColumn("lane_a", F.pmod(F.xxhash64(F.col("of").cast("string")), F.lit(parts)).cast("int"))
    number = F.row_number().over(Window.partitionBy("lane_a").orderBy(F.col("n").desc(), "of")) - 1
    dealt = dealt.select("of", "lane_a", F.floor(number / width).cast("int").alias("lane_b"))
    wave = F.row_number().over(Window.partitionBy(scope).orderBy(order))
    return units.withColumn("wave", wave).join(dealt, F.col(scope).eqNullSafe(F.col("of"))).drop("of")


def run_batches(
    units: DataFrame, backend: Batch, scope: str = "seq_key", order: str = "pos", text: str = "text", width: int = 64, tries: int = 3, advance_on_failure: bool = False, wait: Callable[[float], None] = time.sleep,
    carry: tuple[str, ...] = (), settings: str = "", known: DataFrame | None = None, journal: str | None = None,
) -> DataFrame:
    """(scope, order, carry, text, translated, attempts, error, request, answer, reused): the rows of `translate.run_units`, at most `width` requests a call.

    settings is what else an answer depends on: model, languages, prompt. request names what was asked, null where a unit passes through. reused: the answer was known or in the journal.
    known has (scope, place, request, answer), scope and place as strings. A null scope is one scope; two units at one place of a scope are taken one after the other.
    The frame is lazy: each use of it calls the backend again, unless there is a journal.
    """
    kinds = {c: units.schema[c].dataType.simpleString() for c in (scope, order, *carry)}
    rows = units.select(scope, order, *carry, F.col(text).alias("text"), sendable(F.col(text)).alias("send"))
    rows = lanes(rows, scope, order, width)
    if known is not None:
        last = known.groupBy(F.col("scope").alias("k_scope"), F.col("place").alias("k_place")).agg(F.collect_set(F.struct("request", "answer")).alias("known"))
        rows = rows.join(last, F.col(scope).cast("string").eqNullSafe(F.col("k_scope")) & F.col(order).cast("string").eqNullSafe(F.col("k_place")), "left").drop("k_scope", "k_place")
    else:
        rows = rows.withColumn("known", F.lit(None).cast("array<struct<request:string,answer:string>>"))
    rows = rows.repartition("lane_a", "lane_b").sortWithinPartitions("lane_a", "lane_b", "wave", scope)

    def wave_of(own: pd.DataFrame, lane: str, wave: int, contexts: dict) -> pd.DataFrame:
        log = Journal(journal, lane, wave) if journal else None
        past = log.read() if log else {}
        asked, where, out = [], [], []
        for i, (key, source, send, held) in enumerate(zip(own[scope], own["text"], own["send"], own["known"])):
            context = contexts.get(key, "")
            if not send:
                out.append((source, 0, None, None, False))
                continue
            name = request_id(settings, source, context)
            past_own = past | {x["request"]: x["answer"] for x in (held if held is not None else [])}
            if name in past_own:
                out.append((past_own[name], 0, None, name, True))
            else:
                asked.append((source, context))
                where.append(i)
                out.append((None, 0, None, name, False))

        def keep(got: dict[int, str | None]) -> None:
            if log and got:
                log.write([{"scope": str(own[scope].iloc[where[j]]), "place": str(own[order].iloc[where[j]]), "request": out[where[j]][3], "answer": x} for j, x in got.items()])

        for i, (answer, attempts, error) in zip(where, ask(backend, asked, tries, wait, keep)):
            out[i] = (answer, attempts, error, out[i][3], False)
        for key, source, send, (answer, _, error, _, _) in zip(own[scope], own["text"], own["send"], out):
            done = source if not answer or error else answer.strip() if send else answer
            if error is None or advance_on_failure:
                contexts[key] = (done or "")[-CONTEXT:]
        got = pd.DataFrame(out, columns=["answer", "attempts", "error", "request", "reused"], index=own.index)
        return pd.concat([own[[scope, order, *carry, "text", "send"]], got], axis=1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lane, contexts = None, {}
        for batch in batches:
            # a null key of numbers arrives as not-a-number, which is no key
            batch[scope] = batch[scope].astype(object).where(batch[scope].notna(), None)
            for (a, b, wave), own in batch.groupby(["lane_a", "lane_b", "wave"], sort=False):
                if (a, b) != lane:
                    lane, contexts = (a, b), {}
                yield wave_of(own, f"{a}-{b}", int(wave), contexts)

    shape = ", ".join(f"{c} {k}" for c, k in kinds.items())
    out = rows.mapInPandas(run, f"{shape}, text string, send boolean, answer string, attempts int, error string, request string, reused boolean")
    done = F.when(F.col("error").isNotNull() | ~F.col("send"), F.col("text")).otherwise(clean_response(F.col("answer"), F.col("text")))
    return out.select(scope, order, *carry, "text", done.alias("translated"), "attempts", "error", "request", "answer", "reused")


def fresh(units: DataFrame, backend: Batch, journal: str, **how) -> DataFrame:
    """run_batches with all that a journal holds as known answers as well: for a run whose units or lanes are no longer those of the run that wrote it."""
    if shelf.exists(units.sparkSession, journal):
        old = journalled(units.sparkSession, journal)
        how["known"] = old if how.get("known") is None else old.unionByName(how["known"])
    return run_batches(units, backend, journal=journal, **how)
