"""What the operators of this subpackage share: reading, shared storage, batches of text, word hashes.

Word and shingle hashes are 64 bits wide. They are stable across machines and Python versions,
so that rows hashed by different executors meet.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and U+0009 to U+000D.
WHITE = "\t\n\x0b\x0c\r "
WORD = "[^\\x20\\x09-\\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder; a local one only where both are unset and Spark is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if held is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        held = spark.sparkContext.getCheckpointDir()
    return held.rstrip("/")


def sampled(key: Column | str, share: float) -> Column:
    """True for about `share` of the keys, by 63 bits of a hash, however small the share is."""
    h = F.xxhash64(key)
    # its lowest 20 bits count most
    place = F.shiftleft(h.bitwiseAND((1 << 20) - 1), 43).bitwiseOR(F.shiftrightunsigned(h, 21))
    return F.lit(True) if share >= 1 else place < F.lit(max(1, int(share * (1 << 63))))


#: Spark's own switch: the shuffle files of a query go when the query ends, on all executors.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, tag: str) -> DataFrame:
    """df written as a table into the shared folder and read again: lineage ends there, and any executor can read it.

    Nothing reads the write's shuffle files again, so they are removed when it ends; a lost executor's tasks can still be run again until then.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", budget: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `budget` bytes of text, so that what numpy builds for a batch stays small.

    A text above the budget is a batch of its own.
    """
    for batch in batches:
        sizes = np.diff(np.asarray(offsets(batch[column])[1]))
        ends = np.cumsum(sizes)
        start, n = 0, batch.num_rows
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + budget, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def offsets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column as one array, and where each text starts in it. Nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64 bits, after Steele and others, 2014."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = 0x5851F42D4C957F2D
BACK = pow(BASE, -1, 1 << 64)


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.multiply.accumulate(np.r_[np.uint64(1), np.full(size, b, np.uint64)]) for b in (BASE, BACK))


def words(flat: np.ndarray, off: np.ndarray, lower: bool = True, letters: bool = False, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """Hashes of all words, and where each text's words start among them.

    A word is a longest run of bytes that are no white space (space, U+0009 to U+000D) within a text; with letters, of
    ASCII letters and bytes from 0x80. lower takes A-Z as a-z. The hash is a polynomial over the word's bytes in the ring
    of 64 bits, finalised with its length. For each length in prefixes follow the hashes of the words' first bytes.
    """
    n = len(flat)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64), *(np.zeros(0, np.uint64) for _ in prefixes)
    if lower:
        flat = flat + (((flat >= 65) & (flat <= 90)).astype(np.uint8) << 5)
    solid = ((flat | 32) >= 97) & ((flat | 32) <= 122) | (flat >= 128) if letters else (flat != 32) & ((flat < 9) | (flat > 13))
    first = np.zeros(n + 1, bool)
    first[off[:-1]] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | first[1:n]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | first[1:n]
    a, b = np.flatnonzero(begin), np.flatnonzero(end) + 1
    power, back = _powers(1 << max(20, (n + 1).bit_length()))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTES[flat] * power[:n], out=total[1:])
    hashed = lambda b: mix((total[b] - total[a]) * back[a] + (b - a).astype(np.uint64))
    return hashed(b), np.searchsorted(a, off), *(hashed(np.minimum(b, a + k)) ^ np.uint64(k) for k in prefixes)


def windows(h: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words that lie in one text, and where each text's runs start.

    A text with words, but fewer than `size`, has one run: all its words. A text without words has none.
    """
    counts = np.diff(off)
    many = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    starts = np.r_[0, np.cumsum(many)].astype(np.int64)
    if starts[-1] == 0:
        return np.zeros(0, np.uint64), starts
    at = np.arange(starts[-1]) - np.repeat(starts[:-1] - off[:-1], many)
    longest = np.repeat(np.minimum(counts, size), many)
    out = longest.astype(np.uint64)
    for k in range(size):
        has = k < longest
        out = np.where(has, (out ^ h[np.minimum(at + k, len(h) - 1)]) * np.uint64(0x9FB21C651E98DF25 + 2 * k), out)
        out ^= out >> np.uint64(29)
    return mix(out), starts


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that each node of `links` can reach, as rows of the shared folder.

    Each round every node takes the smallest label among its neighbours and itself, then the label of that label;
    long chains shrink by half or more a round. A round's labels are written, so a lost executor costs one round at most.
    """
    ends = F.inline(F.array(F.struct(F.col(a).alias("x"), F.col(b).alias("y")), F.struct(F.col(b).alias("x"), F.col(a).alias("y"))))  # links are made once
    both = saved(links.select(ends).where("x <> y").distinct(), "links")
    labels = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("root")).withColumnRenamed("x", "node")
    if both.isEmpty():
        return labels
    labels = saved(labels, "labels")
    while True:
        near = both.join(labels, both.y == labels.node).groupBy("x").agg(F.min("root").alias("near"))
        step = labels.join(near, labels.node == near.x).select("node", "root", F.least("root", "near").alias("low"))
        # a node's old root also hears of the lower label, so that trees merge by their roots
        heard = step.where("low < root").groupBy(F.col("root").alias("r")).agg(F.min("low").alias("heard"))
        step = step.join(heard, step.node == heard.r, "left").select("node", "root", F.least("low", F.coalesce("heard", "low")).alias("low"))
        jump = step.select(F.col("node").alias("j"), F.col("low").alias("far"))
        new = saved(step.join(jump, step.low == jump.j, "left").select("node", "root", F.least("low", F.coalesce("far", "low")).alias("low")), "labels")
        if new.where("low < root").isEmpty():
            return new.select("node", F.col("low").alias("root"))
        labels = new.select("node", F.col("low").alias("root"))
