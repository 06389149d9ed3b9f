"""Toxicity as severity grades: cumulative-link (proportional odds) regression on sparse hashed words (McCullagh, 1980).

P(grade <= k) = sigmoid(threshold_k - w.x): one weight vector for all grades, ordered thresholds between them.
The score is the expected grade. The fit takes a bounded sample of labelled rows, in numpy, on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import offsets, sampled, slices, words


@dataclass
class Model:
    """weights: one for each hashed word; thresholds: ascending, one fewer than grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def at_least(self, idx: np.ndarray, off: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ...: a row for each text."""
        return sigmoid(sums(self.weights, idx, off)[:, None] - self.thresholds)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def sums(w: np.ndarray, idx: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.r_[0.0, np.cumsum(w[idx], dtype=np.float64)]
    return total[off[1:]] - total[off[:-1]]


def features(texts: pa.Array, bits: int, prefixes: tuple[int, ...] = (4, 5, 6)) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed words of each text, with their first 4, 5 and 6 bytes, and where each text's features start.

    Words are runs of letters, A-Z as a-z. Prefixes let inflected forms of a stem share a weight.
    """
    h, off, *cut = words(*offsets(texts), letters=True, prefixes=prefixes)
    row = np.repeat(np.arange(len(off) - 1, dtype=np.uint64), np.diff(off)) << np.uint64(bits)
    both = np.unique(np.concatenate([row | (x >> np.uint64(64 - bits)) for x in (h, *cut)]))
    return (both & np.uint64((1 << bits) - 1)).astype(np.int64), np.searchsorted(both >> np.uint64(bits), np.arange(len(off)))


def fit(idx: np.ndarray, off: np.ndarray, grade: np.ndarray, bits: int = 18, epochs: int = 12, batch: int = 128, steps: int = 700, rate: float = 0.5, l1: float = 4e-4, seed: int = 7) -> Model:
    """AdaGrad on the negative log-likelihood with an L1 step, so that words that tell nothing weigh nothing. `steps` at least, also over few rows."""
    k = max(2, int(grade.max(initial=0)) + 1)
    w, seen_w = np.zeros(1 << bits), np.full(1 << bits, 1e-6)
    above = np.array([max(1e-3, min(1 - 1e-3, float((grade >= g).mean()) if len(grade) else 0.5)) for g in range(1, k)])
    base = np.log((1 - above) / above)
    gaps = np.log(np.maximum(np.diff(base), 1e-2))
    first, seen_t = base[0], np.full(k - 1, 1e-6)
    draw = np.random.default_rng(seed)
    edges = lambda: np.r_[-np.inf, np.cumsum(np.r_[first, np.exp(gaps)]), np.inf]
    rounds = max(epochs, -(-steps * batch // max(1, len(grade))))
    mean_w, mean_t, averaged = np.zeros(1 << bits), np.zeros(k - 1), 0
    for e in range(rounds):
        for rows in np.array_split(order := draw.permutation(len(grade)), max(1, len(order) // batch)) if len(grade) else []:
            n = off[rows + 1] - off[rows]
            take = np.repeat(off[rows] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            col = idx[take]
            eta = np.bincount(np.repeat(np.arange(len(rows)), n), w[col], len(rows))
            t = edges()
            hi, lo = sigmoid(t[grade[rows] + 1] - eta), sigmoid(t[grade[rows]] - eta)
            p = np.maximum(hi - lo, 1e-9)
            g = (1 - hi - lo) / len(rows)
            used, at = np.unique(col, return_inverse=True)
            gw = np.bincount(at, np.repeat(g, n))
            seen_w[used] += gw**2
            step = rate / np.sqrt(seen_w[used])
            moved = w[used] - step * gw
            w[used] = np.sign(moved) * np.maximum(0, np.abs(moved) - step * l1)
            gt = np.zeros(k + 1)
            np.add.at(gt, grade[rows] + 1, -hi * (1 - hi) / p / len(rows))
            np.add.at(gt, grade[rows], lo * (1 - lo) / p / len(rows))
            gt = np.cumsum(gt[1:-1][::-1])[::-1]  # a threshold moves all above it
            gt[1:] *= np.exp(gaps)
            seen_t += gt**2
            move = rate * gt / np.sqrt(seen_t)
            first, gaps = first - move[0], gaps - move[1:]
        if 2 * e >= rounds:  # the mean over the later half is steadier than the last step
            mean_w, mean_t, averaged = mean_w + w, mean_t + edges()[1:-1], averaged + 1
    return Model((mean_w / averaged).astype(np.float32), mean_t / averaged)


def grades(idx: np.ndarray, off: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Severity grades where labels say only toxic or not: 0 for clean; toxic texts are 2 if they hold more telling words than the median toxic text, else 1.

    A word is telling if it occurs in 5 labelled toxic texts at least, and its share of them is ten times its share of clean ones.
    """
    row = np.repeat(np.arange(len(toxic)), np.diff(off))
    size = int(idx.max(initial=0)) + 1
    bad, good = np.bincount(idx, toxic[row] == 1, size), np.bincount(idx, toxic[row] == 0, size)
    telling = (bad >= 5) & (bad / max(1, (toxic == 1).sum()) > 10 * good / max(1, (toxic == 0).sum()))
    hits = np.bincount(row, telling[idx], len(toxic))
    middle = np.median(hits[toxic == 1]) if (toxic == 1).any() else 0
    return np.where(toxic == 1, 1 + (hits > middle), 0).astype(np.int64)


def _features(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            idx, off = features(batch["text"], bits)
            yield pa.RecordBatch.from_arrays([batch["grade"], pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(idx.astype(np.int32)))], ["grade", "idx"])

    return run


def train(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", graded: bool = False, fit_rows: int = 8_000, bits: int = 18) -> Model:
    """A model from at most about `fit_rows` labelled rows, taken by a hash of the key. graded: the label is a grade from 0; else it is 0 or 1, see grades().

    Null labels, keys and texts are left out. Without any labelled row the model gives every text the same low score.
    """
    rows = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("int").alias("grade"))
    total = rows.count()
    rows = rows.where(sampled("k", fit_rows / max(1, total))).limit(2 * fit_rows)
    if total and rows.isEmpty():
        raise ValueError(f"no row of {total} was sampled")
    chosen = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text IS NOT NULL").join(F.broadcast(rows), F.col("key") == F.col("k"))  # at most 2 * fit_rows
    got = chosen.select("grade", "text").mapInArrow(_features(bits), "grade int, idx array<int>").toArrow()
    held = got["idx"].combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.int32()))
    held = held.chunk(0) if isinstance(held, pa.ChunkedArray) else held
    grade = got["grade"].to_numpy().astype(np.int64)
    idx, off = held.flatten().to_numpy().astype(np.int64), np.r_[0, np.cumsum(held.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
    if not graded:
        grade = grades(idx, off, grade)
    return fit(idx, off, grade, bits)


def scorer(model: Model):
    bits = len(model.weights).bit_length() - 1

    def score(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade, and the probability of any grade above 0."""
        idx, off = features(texts, bits)
        p = model.at_least(idx, off) * (np.diff(off) > 0)[:, None]  # 0 without a letter
        return p.sum(axis=1), p[:, 0]

    return score


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", reject: float = 0.5) -> DataFrame:
    """One row per row of df: key, severity (expected grade), p_toxic, toxic (p_toxic >= reject), kept.

    Null texts and texts without a letter have severity 0 and are kept. Repeated rows and null keys are scored like any other.
    Only key and text are read, whatever other columns are called. An empty table gives an empty result.
    """
    rate = scorer(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            severity, p = rate(batch["text"])
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(severity), pa.array(p), pa.array(p >= reject), pa.array(p < reject)], ["key", "severity", "p_toxic", "toxic", "kept"])

    docs = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = df.schema[key].dataType.simpleString()
    return docs.mapInArrow(run, f"key {kind}, severity double, p_toxic double, toxic boolean, kept boolean").withColumnRenamed("key", key)


def drop_toxic(df: DataFrame, model: Model, text: str = "text", reject: float = 0.5) -> DataFrame:
    """The rows of df that are not toxic, with all their columns as they are; wordless and null texts stay. Only the text goes to Python."""
    rate = scorer(model)

    @F.arrow_udf("boolean")
    def clean(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for own in texts:
            keep = [rate(part["text"])[1] < reject for part in slices([pa.RecordBatch.from_arrays([own], ["text"])])]
            yield pa.array(np.concatenate([np.zeros(0, bool), *keep]))

    return df.where(clean(F.col(text).cast("string")))
