"""Packing token sequences along a space-filling curve.

Hashed words of a document are projected to `DIMS` dimensions; the cell of that point has a place on a Hilbert curve
(Skilling's transposed form, 2004). Documents are range-sorted by it, so neighbours in a sequence are near in content,
and laid end to end into sequences of fixed length. Documents are cut where a sequence is full: only the last has padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, slices
from .tokens import encoder, packed, unpacked

DIMS, CELLS = 4, 12
#: Sequences that one task forms, about.
RANGE = 2048


def points(h: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """DIMS coordinates from 0 to 2^CELLS - 1 for each text: means of hashed signs of its words, spread by tanh. No word: the middle."""
    n = np.maximum(1, np.diff(edge))
    out = []
    for d in range(DIMS):
        sign = 2.0 * ((h >> np.uint64(11 + 13 * d)) & np.uint64(1)).astype(np.float64) - 1
        total = np.r_[0.0, np.cumsum(sign)]
        out.append(np.tanh(4 * (total[edge[1:]] - total[edge[:-1]]) / n))
    return np.minimum((np.stack(out, 1) + 1) / 2 * (1 << CELLS), (1 << CELLS) - 1).astype(np.int64)


def hilbert(x: np.ndarray) -> np.ndarray:
    """The place of each row's cell on the Hilbert curve through the cube of 2^CELLS cells a side."""
    x = x.copy()
    q = 1 << (CELLS - 1)
    while q > 1:
        for d in range(x.shape[1]):
            up = (x[:, d] & q) != 0
            swap = np.where(up, 0, (x[:, 0] ^ x[:, d]) & (q - 1))
            x[:, 0] ^= np.where(up, q - 1, swap)
            x[:, d] ^= swap
        q >>= 1
    for d in range(1, x.shape[1]):
        x[:, d] ^= x[:, d - 1]
    t = np.zeros(len(x), np.int64)
    q = 1 << (CELLS - 1)
    while q > 1:
        t ^= np.where(x[:, -1] & q, q - 1, 0)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), np.int64)
    for bit in range(CELLS - 1, -1, -1):
        for d in range(x.shape[1]):
            key = key << 1 | (x[:, d] >> bit & 1)
    return key


def tokenized(df: DataFrame, key: str, text: str, path: str, end: int, placed: bool = True) -> DataFrame:
    """(rid, key, place, n, before, part, ids) of each row, written to the shared folder: texts are tokenized once.

    rid is a row's own number; part and before say which task wrote it and how many ids that task had written before. ids end with `end`. Without `placed`, place is 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, squeeze = encoder(path), zstandard.ZstdCompressor(level=3)
        part = TaskContext.get().partitionId()
        rows = total = 0
        for batch in slices(batches):
            ids, off, (h, edge) = own.encode(batch["text"])
            m = batch.num_rows
            last = np.full(1, end, own.kind)
            data = [packed(np.concatenate([ids[off[i] : off[i + 1]], last]), squeeze) for i in range(m)]
            n = np.diff(off) + 1
            before = total + np.cumsum(n) - n
            rid = (np.int64(part) << np.int64(36)) + rows + np.arange(m)
            yield pa.RecordBatch.from_arrays([pa.array(rid), batch["key"], pa.array(hilbert(points(h, edge)) if placed else np.zeros(m, np.int64)), pa.array(n), pa.array(before), pa.array(np.full(m, part, np.int64)), pa.array(data, pa.binary())], ["rid", "key", "place", "n", "before", "part", "ids"])
            rows, total = rows + m, total + int(n.sum())

    docs = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return saved(docs.mapInArrow(run, f"rid long, key {df.schema[key].dataType.simpleString()}, place long, n long, before long, part long, ids binary"), "tokens")


def _cut(path: str, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, squeeze, loose = encoder(path).kind, zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        for batch in slices(batches, "ids"):
            doc, start, size, seq, place, data = [], [], [], [], [], []
            for i, (at, raw) in enumerate(zip(batch["at"].to_pylist(), batch["ids"])):
                ids = unpacked(raw.as_buffer(), kind, loose)
                n, begin = len(ids), 0
                while begin < n:
                    take = min(n - begin, length - (at + begin) % length)
                    doc.append(i)
                    start.append(begin)
                    size.append(take)
                    seq.append((at + begin) // length)
                    place.append((at + begin) % length)
                    data.append(packed(ids[begin : begin + take], squeeze))
                    begin += take
            take = pa.array(doc, pa.int64())
            yield pa.RecordBatch.from_arrays([batch["key"].take(take), *(pa.array(x, pa.int64()) for x in (start, size)), batch["n"].take(take), *(pa.array(x, pa.int64()) for x in (seq, place)), pa.array(data, pa.binary())], ["key", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    return run


def _form(path: str, kind: pa.DataType):
    """Pieces by sequence and offset to sequences: one row each, its ids end to end and its pieces."""
    piece = pa.struct([("key", kind), *((c, pa.int64()) for c in ("start", "length", "doc_tokens", "offset"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, loose = encoder(path).kind, zstandard.ZstdDecompressor()
        held: list[pa.RecordBatch] = []  # pieces of the open sequence

        def formed(batch: pa.RecordBatch) -> pa.RecordBatch:
            seq = batch["sequence_id"].to_numpy()
            first = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            ids = [unpacked(x.as_buffer(), width, loose) for x in batch["ids"]]
            edges = [*first.tolist(), len(seq)]
            data = pa.array([np.concatenate(ids[a:b]).astype("<u4").tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary())
            rows = pa.StructArray.from_arrays([batch[f.name] for f in piece], fields=list(piece))
            return pa.RecordBatch.from_arrays([pa.array(seq[first]), data, pa.ListArray.from_arrays(pa.array(edges, pa.int32()), rows)], ["sequence_id", "ids", "pieces"])

        for batch in slices(batches, "ids"):
            seq = batch["sequence_id"].to_numpy()
            whole = int(np.searchsorted(seq, seq[-1]))  # what comes before the last sequence of the batch is complete
            if whole:
                yield formed(pa.Table.from_batches([*held, batch.slice(0, whole)]).combine_chunks().to_batches()[0])
                held = []
            elif held and held[-1]["sequence_id"][0].as_py() != seq[0]:
                yield formed(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held = []
            held.append(batch.slice(whole))
        if held:
            yield formed(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return run


def sequences(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", length: int = 2048, end: int = 1) -> DataFrame:
    """One row per sequence: sequence_id, ids, pieces (key, start, length, doc_tokens, offset of each, in order).

    ids are little-endian numbers of 4 bytes. Each row of df is a document: its ids, then `end`. Null and empty texts are the end id alone.
    All sequences but the last hold `length` ids. Order: place on the curve, key, row; so ties, copies, repeated rows and null keys have places of their own.
    Partitions are ranges of sequences, in order. Only key and text are read, whatever other columns are called. An empty table gives an empty result.
    Ids move when they meet their offsets and when their pieces meet in a sequence; sorting and running sums are done on (place, key, n) alone.
    Sums over a range partition are one row each: they alone meet in one task.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    toks = tokenized(df, key, text, tokenizer, end)
    light = toks.select("rid", "key", "place", "n").repartitionByRange("place", "key", "rid").withColumn("pid", F.spark_partition_id())
    light = saved(light, "order")
    starts = light.groupBy("pid").agg(F.sum("n").alias("sum"))
    total = starts.agg(F.sum("sum")).first()[0] or 0
    starts = starts.select(F.col("pid").alias("p"), F.coalesce(F.sum("sum").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    within = Window.partitionBy("pid").orderBy("place", "key", "rid").rowsBetween(Window.unboundedPreceding, -1)
    at = light.withColumn("run", F.coalesce(F.sum("n").over(within), F.lit(0))).join(F.broadcast(starts), F.col("pid") == F.col("p"))  # a row for each partition
    at = at.select(F.col("rid").alias("r"), (F.col("start") + F.col("run")).cast("long").alias("at"))
    kind = df.schema[key].dataType.simpleString()
    rows = toks.select("rid", "key", "n", "ids").join(at, F.col("rid") == F.col("r")).select("key", "n", "ids", "at")
    pieces = rows.mapInArrow(_cut(tokenizer, length), f"key {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
    count = max(1, -(-total // length))
    n = min(-(-count // RANGE), 100_000)
    ranged = pieces.repartitionById(n, (F.col("sequence_id") * n / count).cast("int")).sortWithinPartitions("sequence_id", "offset")
    return ranged.mapInArrow(_form(tokenizer, to_arrow_type(df.schema[key].dataType)), f"sequence_id long, ids binary, pieces array<struct<key:{kind},start:bigint,length:bigint,doc_tokens:bigint,offset:bigint>>")


def pack(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", length: int = 2048, end: int = 1) -> DataFrame:
    """One row per piece of the sequences that `sequences` forms, in their order: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    ids are the piece's own, cut from its sequence, little-endian numbers of 4 bytes; ids_crc32 is their CRC-32.
    """
    rows = sequences(df, tokenizer, key, text, length, end).select("sequence_id", F.col("ids").alias("all"), F.inline("pieces"))
    ids = F.substring("all", F.lit(4) * F.col("offset").cast("int") + 1, F.lit(4) * F.col("length").cast("int"))
    rows = rows.select("key", "start", "length", "doc_tokens", "sequence_id", "offset", ids.alias("ids"))
    return rows.select(F.col("key").alias(key), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")
