"""Native language detection by rank-order profiles of letter sequences (Cavnar and Trenkle, 1994), learnt from a table.

A text's profile is its most frequent sequences of one to three letters, word edges as a space, in order of frequency. A language's profile is that of all
its texts together. A text's distance to a language is how far its sequences are out of place there; one that the language lacks counts as a whole profile.
Profiles have a fixed size, so what goes to the workers is a few hundred numbers for each language.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SIZE = 300
SHIFT = 21  # bits of a character
SPACE = 32
#: More languages than this are no languages.
MOST = 1000


@cache
def letter(c: int) -> int:
    """A letter's code point, A-Z as a-z; a space for anything else."""
    return c + 32 if 65 <= c <= 90 else c if unicodedata.category(chr(c))[0] == "L" else SPACE


def letters(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(characters in order, place of each of the text's among them): a space for each run of anything but letters, and one at both ends."""
    raw = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    if len(raw) and int(raw.max()) < 1 << 16:
        kinds = np.flatnonzero(np.bincount(raw))
        where = np.zeros(int(kinds[-1]) + 1, np.int64)
        where[kinds] = np.arange(len(kinds))
        at = where[raw]
    else:
        kinds, at = np.unique(raw, return_inverse=True)
    known, of = np.unique(np.array([*map(letter, kinds.tolist()), SPACE], np.int64), return_inverse=True)
    x = np.r_[of[-1], of[at] if len(raw) else of[:0], of[-1]]
    word = x != of[-1]
    return known, x[np.r_[True, word[1:] | word[:-1]]]


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct sequences of one to three characters without a space inside and not of a space alone, as numbers that sort as the sequences do, and how often each stands in the text."""
    known, x = letters(text)
    width = len(known) + 1
    word, x = known[x] != SPACE, x + 1
    one = x[word] * width**2
    two = (x[:-1] * width**2 + x[1:] * width)[word[:-1] | word[1:]] if len(x) > 1 else one[:0]
    three = (x[:-2] * width**2 + x[1:-1] * width + x[2:])[word[1:-1]] if len(x) > 2 else one[:0]
    codes = np.concatenate([one, two, three])
    if width**3 <= 1 << 18:  # few letters: counted without sorting
        n = np.bincount(codes)
        u = np.flatnonzero(n)
        n = n[u]
    else:
        u, n = np.unique(codes, return_counts=True)
    full = np.r_[0, known]
    return full[u // width**2] << 2 * SHIFT | full[u // width % width] << SHIFT | full[u % width], n


def profile(text: str, size: int) -> np.ndarray:
    """The text's sequences, the most frequent first, of equal ones the smaller first."""
    u, n = counted(text)
    return u[np.argsort(-n, kind="stable")][:size]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by language, summed over a partition before they leave it: as many rows as there are sequences, not texts."""
    held: dict[str, tuple[list, list, int]] = {}

    def summed(us: list[np.ndarray], ns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        u, at = np.unique(np.concatenate(us), return_inverse=True)
        return u, np.bincount(at, np.concatenate(ns)).astype(np.int64)

    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
            us, ns, size = held.get(lang, ([], [], 0))
            u, n = counted(text)
            us.append(u)
            ns.append(n)
            size += len(u)
            if size > 1 << 20:
                u, n = summed(us, ns)
                us, ns, size = [u], [n], 0  # what is new since counts, so sums stay few
            held[lang] = us, ns, size
    for lang, (us, ns, _) in held.items():
        u, n = summed(us, ns)
        for a in range(0, len(u), 1 << 16):
            part = u[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part), pa.array(n[a : a + (1 << 16)])], ["lang", "gram", "n"])


def learn(df: DataFrame, text: str = "text", lang: str = "lang", size: int = SIZE) -> DataFrame:
    """(lang, gram, rank) of the `size` most frequent sequences of each language, rank from 0. Rows without text or language teach nothing."""
    rows = df.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")) - 1
    return counts.select("lang", "gram", rank.alias("rank")).where(F.col("rank") < size)


def nearest(df: DataFrame, profiles: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """(key, language, distance) of every row: the language of least distance, of equal ones the first by name; Unknown and null for a text without letters.

    Whole texts are read, one at a time in a worker; nothing is shuffled.
    """
    rows = profiles.toArrow()  # languages times size
    langs = sorted(set(rows["lang"].to_pylist()))
    if len(langs) > MOST:
        raise ValueError(f"{len(langs)} languages")
    at = {x: i for i, x in enumerate(langs)}
    known, where = np.unique(np.asarray(rows["gram"], np.int64), return_inverse=True)
    ranks = np.full((len(langs), len(known) + 1), -1, np.int64)
    ranks[[at[x] for x in rows["lang"].to_pylist()], where] = np.asarray(rows["rank"], np.int64)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, far = [], []
            for source in batch["text"].to_pylist():
                own = profile(source or "", size)
                if not len(own) or not langs:
                    names.append("Unknown")
                    far.append(None)
                    continue
                spot = np.searchsorted(known, own)
                spot[known[np.minimum(spot, len(known) - 1)] != own] = len(known)
                there = ranks[:, spot]
                distance = np.where(there < 0, size, np.abs(there - np.arange(len(own)))).sum(axis=1)
                names.append(langs[int(distance.argmin())])
                far.append(int(distance.min()))
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(names, pa.string()), pa.array(far, pa.int64())], ["key", "language", "distance"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, language string, distance long").withColumnRenamed("key", key)
