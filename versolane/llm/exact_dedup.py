"""Exact deduplication against an index of what is already there: a minimal perfect hash over the historical distinct digests.

The index is a table of buckets. A bucket holds the digests that its number is taken from, in slots 0 to n - 1 without gaps. A digest finds its slot
through levels of bits (after Limasset and others, 2017): on each level every digest still open claims one place; a place with one claimant is settled and
marked, the others go to the next level. The slot is the number of marks before the place. Every slot holds the full digest, the locator of the row that
wins and how many rows there are. A digest that isn't in the index may reach a slot as well, so the slot's bytes are compared with all of its own.

New digests are grouped by themselves first, with Spark's combining of counts and maxima before the shuffle, so copies never gather. Then they stream past
the bucket they belong to: those whose bytes are found add to the slot, the others stay groups of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix, saved

DIGEST = 32
ROOM = 2  # places of a level for each digest that is still open
BUCKET = 1 << 16  # digests of a bucket, about
#: A group of equal digests: the winner's key and row number, and how many rows there are.
GROUP = "digest binary, win_key long, win_row long, n long"
INDEX = "bucket long, levels array<long>, marks binary, digests binary, win_keys binary, win_rows binary, counts binary, nulls binary"


def _parts(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers of 64 bits from all bytes of each digest."""
    w = np.ascontiguousarray(digests).view("<u8").reshape(-1, DIGEST // 8)
    return mix(w[:, 0] + mix(w[:, 1])), mix(w[:, 2] + mix(w[:, 3]))


def _places(parts: tuple[np.ndarray, np.ndarray], level: int, size: int) -> np.ndarray:
    x, y = parts
    return (mix(x + y * np.uint64(2 * level + 1) + np.uint64(level)) % np.uint64(size)).astype(np.int64)


def perfect_hash(digests: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(sizes of the levels, marks of all levels, slot of each digest) of distinct digests, one row of DIGEST bytes each."""
    x, y = _parts(digests)
    open_, sizes, marks, where, base = np.arange(len(digests)), [], [], np.zeros(len(digests), np.int64), 0
    while len(open_):
        size = max(64, ROOM * len(open_))
        at = _places((x[open_], y[open_]), len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        settled = alone[at]
        where[open_[settled]] = base + at[settled]
        sizes.append(size)
        marks.append(alone)
        open_, base = open_[~settled], base + size
    bits = np.concatenate(marks) if marks else np.zeros(0, bool)
    return sizes, bits, (np.cumsum(bits) - 1)[where] if len(bits) else where


def slots(sizes: list[int], bits: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """The slot that each digest reaches, -1 if it reaches none. One that isn't in the index may reach a slot of another."""
    rank = np.cumsum(bits) - 1
    parts, out, open_, base = _parts(digests), np.full(len(digests), -1, np.int64), np.arange(len(digests)), 0
    for level, size in enumerate(sizes):
        at = _places((parts[0][open_], parts[1][open_]), level, size) + base
        hit = bits[at]
        out[open_[hit]] = rank[at[hit]]
        open_, base = open_[~hit], base + size
    return out


def bucket_of(digest: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(buckets))


def _rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, DIGEST)


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(column.fill_null(0)).astype(np.int64), np.asarray(column.is_null())


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One index row for each bucket of a partition sorted by bucket."""

    def one(bucket: int, own: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(own).combine_chunks()
        digests = _rows(rows["digest"])
        sizes, bits, slot = perfect_hash(digests)
        order = np.empty(len(slot), np.int64)
        order[slot] = np.arange(len(slot))
        keys, nulls = _numbers(rows["win_key"].combine_chunks())
        cells = [np.packbits(bits), digests[order], keys[order], *(np.asarray(rows[c]).astype(np.int64)[order] for c in ("win_row", "n")), nulls[order]]
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([sizes], pa.list_(pa.int64())), *(pa.array([x.tobytes()], pa.binary()) for x in cells)], ["bucket", "levels", "marks", "digests", "win_keys", "win_rows", "counts", "nulls"])

    held, of = [], None
    for batch in batches:
        name = np.asarray(batch["bucket"])
        for part in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(name)) + 1):
            if len(part):
                if name[part[0]] != of and held:
                    yield one(of, held)
                    held = []
                of = int(name[part[0]])
                held.append(batch.slice(int(part[0]), len(part)))
    if held:
        yield one(of, held)


def build(groups: DataFrame, buckets: int) -> DataFrame:
    """The index (INDEX) over distinct digests: groups is (digest, win_key, win_row, n), one row for each digest."""
    rows = groups.select(bucket_of(F.col("digest"), buckets).alias("bucket"), "digest", "win_key", "win_row", "n")
    return rows.repartitionById(buckets, F.col("bucket").cast("int")).sortWithinPartitions("bucket").mapInArrow(_build, INDEX)


class _Bucket:
    """An index row that new groups are looked up in."""

    def __init__(self, row: dict | None):
        self.sizes = row["levels"] if row else []
        self.bits = np.unpackbits(np.frombuffer(row["marks"], np.uint8))[: sum(self.sizes)].astype(bool) if row else np.zeros(0, bool)
        self.digests = np.frombuffer(row["digests"] if row else b"", np.uint8).reshape(-1, DIGEST)
        self.keys, self.rows, self.counts = (np.frombuffer(row[c] if row else b"", np.int64).copy() for c in ("win_keys", "win_rows", "counts"))
        self.nulls = np.frombuffer(row["nulls"] if row else b"", bool).copy()

    def add(self, digests: np.ndarray, keys: np.ndarray, nulls: np.ndarray, rows: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Adds the groups whose bytes a slot holds to that slot; true for those."""
        at = slots(self.sizes, self.bits, digests)
        found = at >= 0
        found[found] = (self.digests[at[found]] == digests[found]).all(axis=1)
        s, k, z, r = at[found], keys[found], nulls[found], rows[found]
        # a null key is under all others; of equal keys the larger row number wins. A digest comes once, so slots are distinct
        later = np.where(z | self.nulls[s], (~z & self.nulls[s]) | (z & self.nulls[s] & (r > self.rows[s])), (k > self.keys[s]) | ((k == self.keys[s]) & (r > self.rows[s])))
        self.counts[s] += n[found]
        for own, new in ((self.keys, k), (self.rows, r), (self.nulls, z)):
            own[s[later]] = new[later]
        return found

    def groups(self) -> pa.RecordBatch:
        return _groups(self.digests, self.keys, self.nulls, self.rows, self.counts)


def _groups(digests: np.ndarray, keys: np.ndarray, nulls: np.ndarray, rows: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    data = digests.tobytes()
    return pa.RecordBatch.from_arrays([pa.array([data[i : i + DIGEST] for i in range(0, len(data), DIGEST)], pa.binary()), pa.array(keys, pa.int64(), mask=nulls), pa.array(rows), pa.array(n)], ["digest", "win_key", "win_row", "n"])


def _look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition sorted by bucket, its index row first: new groups stream past it."""
    at, of = _Bucket(None), None
    for batch in batches:
        name = np.asarray(batch["bucket"])
        first = np.asarray(batch["levels"].is_valid())
        for part in np.split(np.arange(batch.num_rows), np.unique(np.r_[np.flatnonzero(np.diff(name)) + 1, np.flatnonzero(first[:-1]) + 1])):
            if not len(part):
                continue
            own = batch.slice(int(part[0]), len(part))
            if name[part[0]] != of:
                yield at.groups()
                of, at = name[part[0]], _Bucket(own.slice(0, 1).to_pylist()[0] if first[part[0]] else None)
            if not first[part[0]]:
                digests, (keys, nulls), rows, n = _rows(own["digest"]), _numbers(own["win_key"]), np.asarray(own["win_row"]), np.asarray(own["n"])
                alone = ~at.add(digests, keys, nulls, rows, n)
                yield _groups(digests[alone], keys[alone], nulls[alone], rows[alone], n[alone])
    yield at.groups()


def look_up(index: DataFrame, groups: DataFrame, buckets: int) -> DataFrame:
    """GROUP rows: every digest of the index and of groups (one row for each digest) once, with the winner and the count of both.

    buckets is the number that the index was built with. A worker holds one bucket of the index; groups only pass by, however many there are.
    """
    new = groups.select(bucket_of(F.col("digest"), buckets).alias("bucket"), "digest", "win_key", "win_row", "n")
    both = index.unionByName(new, allowMissingColumns=True)
    both = both.repartitionById(buckets, F.col("bucket").cast("int")).sortWithinPartitions("bucket", F.col("levels").isNull())
    return both.mapInArrow(_look_up, GROUP)


def grouped(rows: DataFrame) -> DataFrame:
    """GROUP rows of (digest, key, row): the largest key wins, of equal keys the largest row number."""
    win = F.max(F.struct("key", "row"))
    return rows.groupBy("digest").agg(win.alias("w"), F.count("*").alias("n")).select("digest", F.col("w.key").alias("win_key"), F.col("w.row").alias("win_row"), "n")


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text", historical: Column | None = None, bucket: int = BUCKET) -> DataFrame:
    """One row per row of df: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are, told by SHA-256; null counts as empty. Of equal texts the row with the largest key stays; of rows that repeat a key as well,
    exactly one. A null key is under all others, so keep_id is null only where all keys of a group are. `historical` says which rows the index is built over; else
    those whose key is in the lower half of the range of keys. Rows with a null `historical` are new. The result is the same for any choice.
    The key is a whole number. Only key, text and what `historical` names are read, whatever other columns are called. An empty table gives an empty result.
    Buckets hold about `bucket` digests, and there are as many as shuffle partitions at least.
    """
    digest = F.unhex(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256))
    past = F.lit(None).cast("boolean") if historical is None else historical
    rows = saved(df.select(F.col(key).cast("long").alias("key"), digest.alias("digest"), past.alias("past"), F.monotonically_increasing_id().alias("row")), "digests")
    if historical is None:
        low, high, total = rows.agg(F.min("key"), F.max("key"), F.count("*")).first()
        past = F.coalesce(F.col("key") <= F.lit((low + high) // 2 if low is not None else 0), F.lit(False))
    else:
        total, past = rows.count(), F.coalesce("past", F.lit(False))
    buckets = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket))
    index = build(grouped(rows.where(past)), buckets)
    found = look_up(index, grouped(rows.where(~past)), buckets)
    # rows meet their group by a plain join, which Spark splits where copies are many; groups of one need none
    shared = found.where("n > 1").withColumnRenamed("digest", "d")
    out = rows.join(shared, F.col("digest") == F.col("d"), "left")
    kind = df.schema[key].dataType
    return out.select(
        F.col("key").cast(kind).alias(key), F.when(F.col("d").isNull(), F.col("key")).otherwise(F.col("win_key")).cast(kind).alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("row") == F.col("win_row"), F.lit(True)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )
