"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in SQL expressions only.

A shard follows from the key and the number of shards alone. No ring table is kept, and one more shard
takes rows only into itself: of n rows about n / (shards + 1) move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MULTIPLIER = 2862933555777941757  # fixed value of the published generator
LOW = 0xFFFFFFFF


def _halves(key: Column) -> tuple[Column, Column]:
    """Upper and lower 32 bits of a long, both as longs from 0."""
    return F.shiftrightunsigned(key, 32), key.bitwiseAND(F.lit(LOW))


def _step(hi: Column, lo: Column) -> tuple[Column, Column]:
    """key * MULTIPLIER + 1 modulo 2^64, on halves: no product here leaves 63 bits, so ANSI arithmetic stays on."""
    c1, c01, c00 = MULTIPLIER >> 32, MULTIPLIER >> 16 & 0xFFFF, MULTIPLIER & 0xFFFF
    part = lo * F.lit(c01)
    low = lo * F.lit(c00) + F.shiftleft(part.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    carry = F.shiftright(low, 32) + F.shiftright(part, 16)
    high = carry + (lo * F.lit(c1)).bitwiseAND(F.lit(LOW)) + (hi * F.lit(c00)).bitwiseAND(F.lit(LOW)) + F.shiftleft((hi * F.lit(c01)).bitwiseAND(F.lit(0xFFFF)), 16)
    return high.bitwiseAND(F.lit(LOW)), low.bitwiseAND(F.lit(LOW))


def jump(key: Column, shards: int) -> Column:
    """A struct (shard, grown): the key's shard among `shards`, and among one more. Null keys count as 0."""
    hi, lo = _halves(F.coalesce(key.cast("long"), F.lit(0).cast("long")))
    start = F.struct(hi.alias("hi"), lo.alias("lo"), F.lit(0).cast("long").alias("j"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("g"))

    def leap(s: Column, _: Column) -> Column:
        h, w = _step(s["hi"], s["lo"])
        at = s["j"]
        far = F.floor((at + F.lit(1)).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(h, 1) + F.lit(1)).cast("double")))
        on = at <= F.lit(shards)
        return F.struct(
            F.when(on, h).otherwise(s["hi"]).alias("hi"), F.when(on, w).otherwise(s["lo"]).alias("lo"), F.when(on, far).otherwise(at).alias("j"),
            F.when(at < F.lit(shards), at).otherwise(s["b"]).alias("b"), F.when(on, at).otherwise(s["g"]).alias("g"),
        )

    # the j-th leap lands on j at least, so shards + 1 leaps always suffice
    return F.aggregate(F.sequence(F.lit(0), F.lit(shards)), start, leap, lambda s: F.struct(s["b"].cast("int").alias("shard"), s["g"].cast("int").alias("grown")))


def bucket(key: Column, buckets: int) -> Column:
    """One of `buckets` parts of a shard: bits of the generator's first value that hardly bear on the shard."""
    hi, _ = _step(*_halves(F.coalesce(key.cast("long"), F.lit(0).cast("long"))))
    return F.pmod(hi, F.lit(buckets)).cast("int")


OWN = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def placed(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 8, buckets: int = 1024) -> DataFrame:
    """df's rows, whole, with where they go: size, text_crc32, law, shard, slot, grown_shard. `write` puts them there.

    Slots number a shard's rows without gaps from 0. No shard is sorted as a whole: rows are numbered within
    (shard, bucket), and `shards * buckets` counts, at most that many rows, give where each bucket starts.
    Null text: size 1, crc 0. Null keys hash as 0. Repeated rows each get a slot; which gets which is open.
    Columns of df that have one of the names above are replaced; the others pass through. Those that nobody selects are not read or moved. An empty table gives an empty result.
    """
    bytes_ = F.coalesce(F.col(text), F.lit("")).cast("binary")
    kept = [c for c in df.columns if c.lower() not in OWN]
    rows = df.select(*kept, F.col(key).alias("__key"), (F.octet_length(bytes_).cast("long") + 1).alias("size"), F.crc32(bytes_).alias("text_crc32"))
    rows = rows.select("*", jump(F.col("__key"), shards).alias("__at"), bucket(F.col("__key"), buckets).alias("__bucket"))
    rows = rows.select(*kept, "__key", "size", "text_crc32", F.col("__at.shard").alias("shard"), F.col("__at.grown").alias("grown_shard"), "__bucket")
    counts = rows.groupBy("shard", "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy("shard", "__bucket").orderBy("__key", "text_crc32")
    slot = (F.col("__start") + F.col("__rank") - 1).cast("long")
    rows = rows.withColumn("__rank", F.row_number().over(within)).join(F.broadcast(starts), ["shard", "__bucket"])  # shards * buckets rows at most
    return rows.select(*kept, "size", "text_crc32", F.lit("key").alias("law"), "shard", slot.alias("slot"), "grown_shard")


def shard(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 8, buckets: int = 1024) -> DataFrame:
    """The digest of `placed`, one row per row of df: key, size, text_crc32, law, shard, slot, grown_shard. Only key and text are read."""
    return placed(df.select(F.col(key).alias("__id"), F.col(text).alias("__text")), "__id", "__text", shards, buckets).select(F.col("__id").alias(key), *OWN)


def write(df: DataFrame, out: str, key: str = "doc_id", text: str = "text", shards: int = 8, buckets: int = 1024, **parquet: str) -> None:
    """df's rows under out/shard=N, by slot within a file. A shard is dealt over tasks by ranges of slots, so a large one is no large task."""
    rows = placed(df, key, text, shards, buckets)
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.options(**parquet).partitionBy("shard").parquet(out)
