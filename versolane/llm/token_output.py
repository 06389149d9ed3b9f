"""Training-order materialisation of token ids.

Documents, each with an end id, are laid end to end and cut into sequences of fixed length. A keyed Feistel network with
cycle-walking (Black and Rogaway, 2002) permutes 0..N-1: it gives every sequence its slot in training order without
sorting or a table. Range partitions over slots write shards of equally long records: slot s is record s mod `records` of
shard s div `records`, so a reader seeks to any step of training and resumes there.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mix, saved, slices
from .packing import tokenized
from .tokens import encoder, packed, unpacked

ROUNDS = 6


def feistel(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A permutation of 0..n-1, chosen by key. Values that leave the range walk on through the network until they are back in it."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & (1 << 64) - 1))
    out = x.astype(np.uint64)
    left = np.arange(len(out))
    while len(left):
        a, b = out[left] >> np.uint64(half), out[left] & mask
        for k in keys:
            a, b = b, a ^ (mix(b + k) & mask)
        out[left] = a << np.uint64(half) | b
        left = left[out[left] >= np.uint64(n)]
    return out.astype(np.int64)


def _pieces(path: str, length: int, total: int, key: int, records: int):
    sequences = -(-total // length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, loose, squeeze = encoder(path).kind, zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
        for batch in slices(batches, "ids"):
            doc, start, place, seq, data = [], [], [], [], []
            for i, (at, raw) in enumerate(zip(batch["at"].to_pylist(), batch["ids"])):
                ids = unpacked(raw.as_buffer(), kind, loose)
                begin = 0
                while begin < len(ids):
                    take = min(len(ids) - begin, length - (at + begin) % length)
                    doc.append(i)
                    start.append(begin)
                    place.append((at + begin) % length)
                    seq.append((at + begin) // length)
                    data.append(packed(ids[begin : begin + take], squeeze))
                    begin += take
            slot = feistel(np.array(seq, np.int64), sequences, key)
            yield pa.RecordBatch.from_arrays([batch["key"].take(pa.array(doc, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, seq, place, slot, slot // records)), pa.array(data, pa.binary())], ["key", "start", "sequence_id", "offset", "slot", "shard", "ids"])

    return run


def shard_path(out: str, shard: int) -> str:
    return f"{out}/shard-{shard:08d}.bin"


def _write(path: str, out: str, length: int, records: int, pad: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(out)
        store.create_dir(root, recursive=True)
        kind, loose = encoder(path).kind, zstandard.ZstdDecompressor()
        task = TaskContext.get().taskAttemptId()
        shard, stream, slot, record = -1, None, -1, np.zeros(0, kind)

        def close() -> None:
            if stream is not None:
                stream.write(record.tobytes())
                stream.close()
                store.move(f"{root}/.{shard}-{task}", shard_path(root, shard))  # whole or not at all; a second attempt writes the same bytes

        for batch in slices(batches, "ids"):
            sizes, sums = [], []
            for s, where, at, raw in zip(batch["slot"].to_pylist(), batch["shard"].to_pylist(), batch["offset"].to_pylist(), batch["ids"]):
                ids = unpacked(raw.as_buffer(), kind, loose)
                if s != slot:
                    if where != shard:
                        close()
                        shard, stream = where, store.open_output_stream(f"{root}/.{where}-{task}")
                    else:
                        stream.write(record.tobytes())
                    slot, record = s, np.full(length, pad, kind)
                record[at : at + len(ids)] = ids
                sizes.append(len(ids))
                sums.append(zlib.crc32(ids.astype("<u4")))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("key", "start")), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), *(batch[c] for c in ("sequence_id", "offset", "slot", "shard"))], ["key", "start", "length", "ids_crc32", "sequence_id", "offset", "slot", "shard"])
        close()

    return run


def materialise(df: DataFrame, out: str, tokenizer: str, key: str = "doc_id", text: str = "text", length: int = 1024, records: int = 2048, seed: int = 20_240, end: int = 1, pad: int = 0) -> DataFrame:
    """Writes shards under `out` (a URI that pyarrow.fs opens: file, s3, gs, hdfs) and returns their manifest.

    One row per piece of a document: key, start, length, ids_crc32, sequence_id, offset, slot, shard.
    A record is `length` ids of the tokenizer's width (2 bytes up to 65,536 ids, else 4), little-endian; the last sequence is padded.
    Each row of df is a document: its ids, then `end`; null and empty texts are the end id alone. Repeated rows and null keys
    are documents like any other. Documents follow each other as the tokens table holds them, so no ids are sorted before the permutation.
    Only key and text are read, whatever other columns are called. An empty table writes nothing and gives an empty result.
    """
    kind = df.schema[key].dataType.simpleString()
    toks = tokenized(df, key, text, tokenizer, end, placed=False)
    parts = toks.groupBy("part").agg(F.sum("n").alias("sum"))
    starts = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("sum").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    total = parts.agg(F.sum("sum")).first()[0] or 0
    rows = toks.join(F.broadcast(starts), F.col("part") == F.col("p")).select("key", "ids", (F.col("start") + F.col("before")).cast("long").alias("at"))  # a row for each task
    pieces = rows.mapInArrow(_pieces(tokenizer, length, total, seed, records), f"key {kind}, start long, sequence_id long, offset long, slot long, shard long, ids binary")
    shards = max(1, -(-(-(-total // length)) // records))
    n = min(shards, 100_000)
    ranged = pieces.repartitionById(n, (F.col("shard") * n / shards).cast("int")).sortWithinPartitions("slot", "offset")
    return saved(ranged.mapInArrow(_write(tokenizer, out, length, records, pad), f"key {kind}, start long, length long, ids_crc32 long, sequence_id long, offset long, slot long, shard long"), "manifest").withColumnRenamed("key", key)


def records(spark: SparkSession, out: str, length: int, tokenizer: str) -> DataFrame:
    """(shard, record, ids) of written shards: how a trainer would read them, here as a DataFrame."""
    kind = np.dtype(encoder(tokenizer).kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch["path"].to_pylist(), batch["content"]):
                rows = np.frombuffer(data.as_buffer(), kind).reshape(-1, length).astype(np.int64)
                shard = int(os.path.basename(path)[6:14])
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(rows), pa.int64()), pa.array(range(len(rows)), pa.int64()), pa.array(list(rows), pa.list_(pa.int64()))], ["shard", "record", "ids"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.bin").load(out).select("path", "content")
    return files.mapInArrow(run, "shard long, record long, ids array<long>")
