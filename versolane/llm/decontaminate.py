"""Benchmark decontamination by spaced-seed hashing (the idea of Ma, Tromp and Li, 2002, on words).

A mask of 1s and 0s is laid at each word of a text; the words under its 1s are hashed, those under its 0s are ignored,
so a substituted word under a 0 leaves the hash as it is. Hashes of training texts that also occur in test items are hits.
Around each hit the text and the item are laid side by side and compared word by word.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, offsets, slices, words

TABLE = 22  # bits of a mask's filter at most; it has 16 to 32 places a seed


def masks(size: int, percent: int, sliding: bool) -> set[str]:
    """Masks of which one at least fits in between any substitutions that leave `percent` per cent of `size` words in a row equal.

    So many words stand in one block more than may be substituted, or more blocks: some are always left whole, and a mask has 1s
    under those it counts on. With `sliding`, masks are laid at each word of an item, so blocks of one width need only their distance:
    two of them, in k + 2 blocks, are the k + 1 masks of a long item. A short item has few places, and heavier masks: all but k of five blocks.
    """
    k = size * (100 - percent) // 100
    if sliding and size >= k + 2:
        width = size // (k + 2)
        return {"1" * width + "0" * (width * (d - 1)) + "1" * width for d in range(1, k + 2)}
    blocks = max(min(size, 5), k + 1)
    edges = [size * i // blocks for i in range(blocks + 1)]
    out = set()
    for whole in combinations(range(blocks), blocks - k):
        out.add("".join(("1" if i in whole else "0") * (edges[i + 1] - edges[i]) for i in range(blocks)).strip("0"))
    return out


def seeds(h: np.ndarray, off: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Places where the mask fits into one text, and the hashes of the words under its 1s."""
    span, n = len(mask), len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    end = np.repeat(off[1:], np.diff(off))
    out = np.full(n, zlib.crc32(mask.encode()), np.uint64)
    for i, m in enumerate(mask):
        if m == "1":
            out = (out ^ h[i : i + n]) * np.uint64(0x9FB21C651E98DF25)
            out ^= out >> np.uint64(32)
    at = np.flatnonzero(np.arange(n) + span <= end[:n])
    return at, mix(out[at])


class Block:
    """Test items of one block: their words, and for each mask the sorted seed hashes with their places.

    The masks follow from the number of words that have to agree: `window`, or all of a shorter item. Those of a length are laid only on items of that length.
    """

    def __init__(self, texts: list[str | None], window: int = 12, percent: int = 80):
        self.h, self.off = words(*offsets(pa.array(texts, pa.string())))
        counts = np.minimum(np.diff(self.off), window)
        sizes = defaultdict(set)
        for n in np.unique(counts[counts > 0]).tolist():
            for mask in masks(n, percent, n == window):
                sizes[mask].add(n)
        self.seeds = {}
        for mask, own in sizes.items():
            at, s = seeds(self.h, self.off, mask)
            fit = np.isin(counts[np.searchsorted(self.off, at, side="right") - 1], list(own))
            at, s = at[fit], s[fit]
            order = np.argsort(s, kind="stable")
            bits = max(10, min(TABLE, (16 * len(s)).bit_length()))
            maybe = np.zeros(1 << bits, bool)
            maybe[s >> np.uint64(64 - bits)] = True
            self.seeds[mask] = s[order], at[order], maybe


def overlaps(h: np.ndarray, off: np.ndarray, block: Block, window: int, percent: int) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, equal words, words compared) for each pair with an overlap.

    A pair overlaps if on some diagonal `window` words in a row, or the whole item if it is shorter,
    agree in `percent` per cent of places at least (percent above 0). All such pairs are found: each has a hit of some mask.
    Equal words are counted on the best diagonal. `block` is made with the same window and percent.
    """
    found = []
    for mask, (known, places, maybe) in block.seeds.items():
        at, s = seeds(h, off, mask)
        some = maybe[s >> np.uint64(65 - len(maybe).bit_length())]
        at, s = at[some], s[some]
        lo, hi = np.searchsorted(known, s), np.searchsorted(known, s, side="right")
        n = hi - lo
        spot = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        found.append(np.stack([np.repeat(at, n), places[spot]], 1))
    hits = np.concatenate(found)
    text, item = np.searchsorted(off, hits[:, 0], side="right") - 1, np.searchsorted(block.off, hits[:, 1], side="right") - 1
    # an offset may stand twice where a text is empty: the last such text is the one that has the word
    lines = np.unique(np.stack([text, item, hits[:, 0] - hits[:, 1] + block.off[item]], 1), axis=0)
    best: dict[tuple[int, int], tuple[int, int]] = {}
    # an item within the window is compared whole, all places of all such items at once
    size = np.diff(block.off)[lines[:, 1]]
    t, i, start = lines[size <= window].T
    m = size[size <= window]
    inside = (start >= off[t]) & (start + m <= off[t + 1])
    t, i, start, m = t[inside], i[inside], start[inside], m[inside]
    equal = np.zeros(len(m), np.int64)
    for j in range(int(m.max(initial=0))):
        on = np.flatnonzero(j < m)
        equal[on] += h[start[on] + j] == block.h[block.off[i[on]] + j]
    enough = 100 * equal >= percent * m
    for pair, same in zip(zip(t[enough].tolist(), i[enough].tolist()), zip(equal[enough].tolist(), m[enough].tolist())):
        best[pair] = max(best.get(pair, (0, 0)), same)
    for t, i, start in lines[size > window].tolist():
        own = block.h[block.off[i] : block.off[i + 1]]
        lo, hi = max(start, int(off[t])), min(start + len(own), int(off[t + 1]))
        if hi - lo < window:
            continue
        same = h[lo:hi] == own[lo - start : hi - start]
        total = np.r_[0, np.cumsum(same)]
        if (100 * (total[window:] - total[:-window]) >= percent * window).any():
            best[t, i] = max(best.get((t, i), (0, 0)), (int(total[-1]), hi - lo))
    return ((t, i, *v) for (t, i), v in best.items())


def _find(ids: list, block: Block, window: int, percent: int, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = list(overlaps(*words(*offsets(batch["text"])), block, window, percent))
            if rows:
                t, i, same, span = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch["key"].take(pa.array(t)), pa.array([ids[x] for x in i], kind), pa.array(same, pa.int64()), pa.array(span, pa.int64())], ["key", "item", "equal", "span"])

    return run


def matches(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 12, percent: int = 80, block_items: int = 20_000) -> DataFrame:
    """(key, item, equal, span): one row per overlapping pair of a document and a test item.

    The items are a stated query set. They go to the tasks in blocks of about `block_items`, so what a task holds
    doesn't grow with the benchmark; each block is one pass over df. Null and wordless texts and items match nothing.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = df.sparkSession
    blocks = max(1, -(-benchmark.count() // block_items))
    docs = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = to_arrow_type(benchmark.schema[item].dataType)
    schema = f"key {df.schema[key].dataType.simpleString()}, item {benchmark.schema[item].dataType.simpleString()}, equal long, span long"
    out = spark.createDataFrame([], schema)
    for k in range(blocks):
        rows = benchmark.where(F.pmod(F.xxhash64(item), F.lit(blocks)) == k).select(F.col(item).alias("i"), F.col(item_text).cast("string").alias("t")).collect()  # about block_items rows
        held = Block([r["t"] for r in rows], window, percent)
        if len(held.h):
            out = out.union(docs.mapInArrow(_find([r["i"] for r in rows], held, window, percent, kind), schema))
    return out


def contaminated(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", **how) -> DataFrame:
    """One row per row of df: key, n_items, items (sorted ids of test items that overlap it), n_equal (most equal words with one), contaminated, kept.

    Null texts, texts without words and an empty benchmark: nothing found, kept. Rows that share a key share what is found
    in any of them; rows with a null key share it too. A repeated item is found under each of its ids once.
    Only key and text of df are read, whatever other columns are called. An empty table gives an empty result.
    """
    found = matches(df, benchmark, key, text, item, **how).groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"), F.max("equal").alias("equal"))
    found = found.withColumnRenamed("key", "k")
    out = df.select(F.col(key).alias("key")).join(found, F.col("key").eqNullSafe(F.col("k")), "left")
    ids = F.coalesce("items", F.array().cast(found.schema["items"].dataType))
    return out.select(F.col("key").alias(key), F.size(ids).cast("long").alias("n_items"), ids.alias("items"), F.coalesce("equal", F.lit(0)).cast("long").alias("n_equal"), F.col("items").isNotNull().alias("contaminated"), F.col("items").isNull().alias("kept"))
