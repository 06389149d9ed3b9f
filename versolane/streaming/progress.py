"""Progress of running jobs: answers, as they are stored, joined with what each job holds in all."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import jobs

STATE = "answered long, shown double"
ROWS = "book_id string, doc_idx int, block_no int, step string, progress double, shown double, message string"
NAMES = [x.split()[0] for x in ROWS.split(", ")]
KINDS = {"doc_idx": "Int32", "block_no": "Int32"}


class Bars(StatefulProcessor):
    """How many units of a job are there and how far its bar has come: it never goes back, and closes when the last unit is there."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bar = handle.getValueState("bar", STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        answered, shown = self.bar.get() if self.bar.exists() else (0, 0.0)
        for batch in rows:
            out = batch.assign(book_id=key[0], shown=np.maximum.accumulate(np.append(shown, batch["progress"]))[1:])[NAMES]
            last = int(batch["units"].iloc[0]) - answered if len(batch) else 0
            if 0 < last <= len(out):
                closing = pd.DataFrame([(key[0], None, None, step, progress, progress, message) for step, progress, message in jobs.CLOSING], columns=NAMES)
                more = out.iloc[last:]
                parts = [out.iloc[:last], closing, more.assign(shown=1.0)]
                out, shown = pd.concat([x.astype(KINDS) for x in parts]), 1.0
            elif len(batch):
                shown = float(out["shown"].iloc[-1])
            answered += len(batch)
            yield out.astype(KINDS)
        self.bar.update((answered, shown))

    def close(self) -> None:
        pass


def bars(answers: DataFrame, totals: DataFrame) -> DataFrame:
    """ROWS for a stream of answers (book_id, doc_idx, block_no, error), each unit once, and what the books hold (see `jobs.totals`).

    progress is the unit's own place, as in `jobs.book_progress`; shown is where the job's bar stands, which only goes up. Needs the state store in `machine.STORE`.
    """
    rows = jobs.placed(answers, totals)
    return rows.groupBy("book_id").transformWithStateInPandas(Bars(), outputStructType=ROWS, outputMode="append", timeMode="none")
