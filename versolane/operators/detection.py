"""Language detection through a backend: requests in any order, a bounded number of them in flight, late ones given up."""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_answer

#: Takes provider, model and prompt, returns the answer or raises.
Detector = Callable[[str, str, str], "str | None"]

SHOWN = 60  # characters of an error that are kept
UNKNOWN = "Unknown"


class Flight:
    """Requests in threads of their own, at most `width` of them that still count. One that takes over `timeout` seconds is given up: its answer is dropped if it ever comes.

    A backend that hangs leaves its thread behind, so over `lost` threads that never came back are an error.
    """

    def __init__(self, backend: Detector, width: int, timeout: float, lost: int = 1000):
        self.backend, self.width, self.timeout, self.lost = backend, width, timeout, lost
        self.done: queue.Queue = queue.Queue()
        self.open: dict[int, float] = {}  # number of a request, and when it is given up
        self.hanging: set[int] = set()

    def _one(self, number: int, request: tuple[str, str, str]) -> None:
        try:
            self.done.put((number, self.backend(*request), "answered"))
        except Exception as why:  # any failure of a backend is the request's outcome
            self.done.put((number, None, f"failed: {why}"[:SHOWN]))

    def send(self, number: int, request: tuple[str, str, str]) -> None:
        self.open[number] = time.monotonic() + self.timeout
        threading.Thread(target=self._one, args=(number, request), daemon=True).start()

    def landed(self) -> Iterator[tuple[int, str | None, str]]:
        """Waits until at least one open request has an outcome and gives all that have one."""
        out = []
        while self.open and not out:
            try:
                out.append(self.done.get(timeout=max(0.0, min(self.open.values()) - time.monotonic())))
                while not self.done.empty():
                    out.append(self.done.get_nowait())
            except queue.Empty:
                pass
            self.hanging.difference_update(number for number, _, _ in out)
            out = [x for x in out if self.open.pop(x[0], None) is not None]
            now = time.monotonic()
            for number in [k for k, until in self.open.items() if until <= now]:
                del self.open[number]
                self.hanging.add(number)
                out.append((number, None, "timed out"))
            if len(self.hanging) > self.lost:
                raise RuntimeError(f"{len(self.hanging)} requests never came back")
        return iter(out)


def ask(requests: DataFrame, backend: Detector, key: str = "job_id", width: int = 8, timeout: float = 30.0) -> DataFrame:
    """(key, language, outcome) of requests (key, provider, model, prompt), in no order.

    Each worker has `width` requests in flight. language is the cleaned answer, Unknown if there is none. outcome: answered, timed out, or failed with the error's start.
    No request waits for another, and none is sent twice by a worker. The frame is lazy: each use of it asks again.
    """
    kind = requests.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flight, keys, sent = Flight(backend, width, timeout), {}, 0
        frame = lambda got: pd.DataFrame([(keys.pop(n), a, o) for n, a, o in got], columns=[key, "answer", "outcome"])
        for part in parts:
            for k, *request in zip(part[key], part["provider"], part["model"], part["prompt"]):
                while len(flight.open) >= width:
                    yield frame(flight.landed())
                keys[sent] = k
                flight.send(sent, tuple(request))
                sent += 1
        while flight.open:
            yield frame(flight.landed())

    out = requests.select(key, "provider", "model", "prompt").mapInPandas(run, f"{key} {kind}, answer string, outcome string")
    return out.select(key, clean_answer(F.col("answer")).alias("language"), "outcome")


def detected(jobs: DataFrame, requests: DataFrame, backend: Detector, key: str = "job_id", **how) -> DataFrame:
    """(key, language, outcome) of all jobs: those without a request have no usable sample or no provider, and Unknown is an outcome of its own."""
    asked = ask(requests, backend, key, **how)
    rows = jobs.select(F.col(key).alias("of")).join(asked, F.col("of") == F.col(key), "left")
    outcome = F.when(F.col(key).isNull(), "not asked").when((F.col("outcome") == "answered") & (F.col("language") == UNKNOWN), "not recognised").otherwise(F.col("outcome"))
    return rows.select(F.col("of").alias(key), F.coalesce("language", F.lit(UNKNOWN)).alias("language"), outcome.alias("outcome"))
