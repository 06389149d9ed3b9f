"""Language identification: averaged hashed subword embeddings with a linear softmax (after Joulin and others, 2016), in numpy.

A text's vector is the mean of the embeddings of its subwords: whole words, and runs of 2, 3 and 4 bytes of its letters with
their word edges. Embeddings and softmax are trained together by stochastic gradient descent on a bounded sample.
A temperature fitted on texts kept out of training makes the scores honest, and the score that only `reject` of their
right answers fall under becomes the bar for rejection.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTES, _powers, mix, offsets, sampled, slices, words

GRAMS = (2, 3, 4)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  #: embedding times softmax weights, for each bucket and language
    bias: np.ndarray
    temperature: float
    bar: float

    def probabilities(self, idx: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = np.maximum(1, np.diff(off))[:, None]
        total = np.zeros((len(idx) + 1, self.table.shape[1]))
        np.cumsum(self.table[idx], axis=0, out=total[1:], dtype=np.float64)
        return softmax(((total[off[1:]] - total[off[:-1]]) / n + self.bias) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def subwords(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of each text, and where each text's start. Anything but ASCII letters and bytes from 0x80 is an edge."""
    flat, off = offsets(texts)
    n, top = len(flat), np.uint64(64 - bits)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    low = flat | 32
    plain = np.where(((low >= 97) & (low <= 122)), low, np.where(flat >= 128, flat, 32))
    h, edge = words(plain, off)
    row = [np.repeat(np.arange(len(off) - 1), np.diff(edge))]
    out = [(h >> top).astype(np.int64)]
    power, back = _powers(1 << max(20, (n + 1).bit_length()))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTES[plain] * power[:n], out=total[1:])
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    space = plain == 32
    for g in GRAMS:
        if n < g:
            continue
        a = np.arange(n - g + 1)
        fits = (doc[: n - g + 1] == doc[g - 1 :]) & ~(space[: n - g + 1] & space[g - 1 :] if g < 3 else space[1 : n - g + 2])
        a = a[fits]
        out.append((mix((total[a + g] - total[a]) * back[a] + np.uint64(977 * g)) >> top).astype(np.int64))
        row.append(doc[a])
    rows, idx = np.concatenate(row), np.concatenate(out)
    order = np.argsort(rows, kind="stable")
    return idx[order], np.searchsorted(rows[order], np.arange(len(off)))


def fit(idx: np.ndarray, weight: np.ndarray, off: np.ndarray, y: np.ndarray, langs: list[str], bits: int, dims: int = 12, epochs: int = 8, steps: int = 1500, rate: float = 0.5, batch: int = 16, reject: float = 0.005, seed: int = 11) -> Model:
    """idx, weight: distinct buckets of each text and their shares of its subwords. A fifth of the texts sets temperature and bar. `steps` at least, also over few texts."""
    draw = np.random.default_rng(seed)
    emb = (draw.random((1 << bits, dims)) - 0.5).astype(np.float32) / dims
    soft, bias = np.zeros((dims, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    order = draw.permutation(len(y))
    apart, own = order[: len(y) // 5], order[len(y) // 5 :]

    def gather(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = off[rows + 1] - off[rows]
        take = np.repeat(off[rows] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        return idx[take], weight[take][:, None], np.repeat(np.arange(len(rows)), n)

    def mean(col: np.ndarray, w: np.ndarray, of: np.ndarray, m: int) -> np.ndarray:
        x = emb[col] * w
        return np.stack([np.bincount(of, x[:, d], m) for d in range(dims)], 1).astype(np.float32)

    each = max(1, -(-len(own) // batch))
    epochs = max(epochs, -(-steps // each))
    step = 0
    for _ in range(epochs if len(own) else 0):
        for rows in np.array_split(draw.permutation(own), each):
            lr = rate * (1 - step / (epochs * each))
            step += 1
            col, w, of = gather(rows)
            x = mean(col, w, of, len(rows))
            g = softmax(x @ soft + bias)
            g[np.arange(len(rows)), y[rows]] -= 1
            back = g @ soft.T
            soft -= lr * (x.T @ g) / len(rows) * 4
            bias -= lr * g.mean(axis=0)
            np.add.at(emb, col, (-lr * w * back[of]).astype(np.float32))
    model = Model(langs, emb @ soft, bias, 1.0, 0.0)
    if len(apart):
        col, w, of = gather(apart)
        logits = mean(col, w, of, len(apart)) @ soft + bias
        loss = lambda t: -np.log(np.maximum(1e-12, softmax(logits / t)[np.arange(len(apart)), y[apart]])).mean()
        model.temperature = float(min(np.geomspace(0.05, 5, 60), key=loss))
        p = softmax(logits / model.temperature)
        right = p.argmax(axis=1) == y[apart]
        model.bar = float(np.quantile(p.max(axis=1)[right], reject)) if right.any() else 0.0
    return model


def _counted(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            idx, off = subwords(batch["text"], bits)
            cols, shares, ends = [], [], [0]
            for i in range(batch.num_rows):
                u, c = np.unique(idx[off[i] : off[i + 1]], return_counts=True)
                cols.append(u.astype(np.int32))
                shares.append((c / max(1, c.sum())).astype(np.float32))
                ends.append(ends[-1] + len(u))
            at = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([batch["lang"], pa.ListArray.from_arrays(at, pa.array(np.concatenate(cols))), pa.ListArray.from_arrays(at, pa.array(np.concatenate(shares)))], ["lang", "idx", "share"])

    return run


def held_out(key: str):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1


def train(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", fit_rows: int = 3_000, bits: int = 16) -> Model:
    """A model from about `fit_rows` rows, taken by a hash of the key from those with text and language outside the held-out third.

    Without any such row there is no language to learn: then every text is `und`.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.where(F.coalesce(~held_out("key"), F.lit(False)) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    total = rows.count()
    got = rows.where(sampled("key", fit_rows / max(1, total))).select("lang", "text").mapInArrow(_counted(bits), "lang string, idx array<int>, share array<float>").toArrow()
    if total and not got.num_rows:
        raise ValueError(f"no row of {total} was sampled")
    if not got.num_rows:
        return Model([], np.zeros((1 << bits, 1), np.float32), np.zeros(1, np.float32), 1.0, 0.0)
    flat = lambda c: np.concatenate([x.flatten().to_numpy() for x in got[c].chunks])
    sizes = np.concatenate([x.value_lengths().to_numpy(zero_copy_only=False) for x in got["idx"].chunks])
    langs, y = np.unique(got["lang"].to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
    return fit(flat("idx").astype(np.int64), flat("share"), np.r_[0, np.cumsum(sizes)].astype(np.int64), y, langs.tolist(), bits)


def identify(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of df: key, held_out, lang_pred, score, rejected.

    lang_pred is a learned language, or `und` with score 0 if the text is null or has no letter. rejected: `und`, or a score below the bar.
    A null key is held out. Rows that repeat are predicted alike. Only key and text are read, whatever other columns are called.
    An empty table gives an empty result.
    """
    bits = len(model.table).bit_length() - 1
    names = np.array([*model.langs, "und"], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            idx, off = subwords(batch["text"], bits)
            p = model.probabilities(idx, off)
            some = batch["letter"].to_numpy(zero_copy_only=False) & (len(model.langs) > 0)
            best, score = np.where(some, p.argmax(axis=1), len(model.langs)), np.where(some, p.max(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays([batch["key"], batch["held"], pa.array(names[best], pa.string()), pa.array(score), pa.array(score < max(model.bar, 1e-9))], ["key", "held_out", "lang_pred", "score", "rejected"])

    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    rows = rows.select("key", "text", F.coalesce(held_out("key"), F.lit(True)).alias("held"), F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("letter"))
    kind = df.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, held_out boolean, lang_pred string, score double, rejected boolean").withColumnRenamed("key", key)
