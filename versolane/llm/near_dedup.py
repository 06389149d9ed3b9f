"""Near-duplicate documents by b-bit MinHash (Li and Koenig, 2010) with band candidates and exact confirmation.

1. Each document's set of word shingles gives `PERMS` minima. The low `BITS` bits of each are kept, packed as bit planes.
   Full minima are hashed by bands for candidate generation and dropped.
2. Documents with equal sets become one node. A node meets the leader of each of its band buckets, the node that shares most
   bands with others; the best of these pairs, by the collision-corrected estimate from bit counts, are confirmed on full sets.
   Their links join most of a group: copies link to what they were copied from, though not always to each other.
3. In rounds, the nodes of a bucket that are not of its largest component meet one node of that, another each round, until a
   round links nothing. Components with many links between them are one by then.
4. At last these nodes meet all nodes of their bucket in other components. A pair is a row only if the estimate comes near the
   threshold and if parity bitmaps of both sets allow it: the bits in which they differ are a lower bound of the shingles in
   which the sets do (Sandes and others, 2020), so no link is lost. Pairs inside a component can change nothing and are never made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, mix, offsets, saved, slices, windows, words

PERMS, BITS, BANDS, ROWS = 512, 4, 48, 5
#: Members of a bucket that one task pairs with the rest of it; leaves that one task compares with their hub.
DEAL, LEAVES = 1024, 256
#: A round that links fewer than one in so many of the nodes that met any other is the last one.
ROUND = 100
_A, _B = (mix(np.arange(1, PERMS + 1, dtype=np.uint64) * np.uint64(k)).astype(np.uint32) | np.uint32(1) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))


def sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of each text with repeats, and where each text's start."""
    return windows(*words(*offsets(texts)), size)


def minima(h: np.ndarray, starts: np.ndarray, chunk: int = 256) -> np.ndarray:
    """PERMS minima for each text, `chunk` shingles at a time: what is worked on stays in the processor's cache."""
    out = np.full((len(starts) - 1, PERMS), 0xFFFFFFFF, np.uint32)
    short = (h >> np.uint64(32)).astype(np.uint32)
    room = np.empty((2, chunk, PERMS), np.uint32)
    for i, (a, b) in enumerate(zip(starts[:-1], starts[1:])):
        for at in range(a, b, chunk):
            v = short[at : min(at + chunk, b), None]
            x, y = room[0, : len(v)], room[1, : len(v)]
            np.multiply(v, _A, out=x)
            np.right_shift(x, np.uint32(15), out=y)
            np.bitwise_xor(x, y, out=x)
            np.multiply(x, _B, out=x)
            np.minimum(out[i], x.min(axis=0), out=out[i])
    return out


def parity(own: np.ndarray) -> np.ndarray:
    """For each of two to four places a shingle, whether an odd number of the set's shingles falls on it: 64 of them in a word."""
    room = 1 << max(9, int(2 * len(own)).bit_length())
    return np.packbits(np.bincount((own & np.uint64(room - 1)).astype(np.int64), minlength=room).astype(np.uint8) & 1, bitorder="little").view(np.int64)


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            h, starts = sets(batch["text"], size)
            low = minima(h, starts)
            n = np.zeros(batch.num_rows, np.int64)
            same, odd = [], []
            for i in range(batch.num_rows):
                own = np.unique(h[starts[i] : starts[i + 1]])
                n[i] = len(own)
                same.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                odd.append(parity(own))
            band = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (batch.num_rows, 1))
            for r in range(ROWS):
                band = mix(band ^ low[:, r : BANDS * ROWS : ROWS].astype(np.uint64))
            planes = np.stack([np.packbits(low >> np.uint32(k) & 1, axis=1) for k in range(BITS)], axis=1)
            sig = np.ascontiguousarray(planes).reshape(batch.num_rows, -1).view(np.int64)
            some = n > 0
            odds = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, odd)]).astype(np.int32)), pa.array(np.concatenate(odd)))
            yield pa.RecordBatch.from_arrays(
                [batch["key"], pa.array(n), pa.array(same, pa.binary()), lists(band.view(np.int64)[some], some), lists(sig[some], some), odds], ["key", "n", "same", "bands", "sig", "odd"]
            )

    return run


def lists(rows: np.ndarray, some: np.ndarray) -> pa.Array:
    """A list column: the next row of `rows` where `some` holds, an empty list elsewhere."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(some * rows.shape[1])].astype(np.int32)), pa.array(rows.reshape(-1)))


def lanes(x: str, y: str) -> Column:
    """How many of the PERMS kept values agree: those whose bit planes all agree, by bit counts."""
    words_ = PERMS // 64
    total = F.lit(PERMS)
    for w in range(words_):
        differ = F.lit(0).cast("long")
        for p in range(BITS):
            differ = differ.bitwiseOR(F.element_at(F.col(x), p * words_ + w + 1).bitwiseXOR(F.element_at(F.col(y), p * words_ + w + 1)))
        total = total - F.bit_count(differ)
    return total


def least_lanes(percent: int) -> int:
    """Agreeing values from which a pair is confirmed: five standard deviations below what the threshold predicts.

    Two unequal minima agree in BITS bits by chance once in 2^BITS; that is the correction.
    """
    chance = 2.0**-BITS
    p = chance + (1 - chance) * percent / 100
    return int(np.floor(PERMS * p - 5 * np.sqrt(PERMS * p * (1 - p))))


def apart(x: str, y: str) -> Column:
    """A lower bound of the number of shingles in one set only: the places in which the parity bitmaps differ. The longer one is folded first."""
    x, y = F.col(x), F.col(y)
    total = lambda v: F.aggregate(v, F.lit(0), lambda s, w: s + F.bit_count(w))
    both = lambda v, w: F.zip_with(v, w, lambda i, j: i.bitwiseXOR(j))

    def folded(v: Column, m: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), (F.size(v) / m).cast("int") - 1), F.slice(v, F.lit(1), m), lambda s, k: both(s, F.slice(v, k * m + 1, m)))

    return F.when(F.size(x) == F.size(y), total(both(x, y))).when(F.size(x) > F.size(y), total(both(folded(x, F.size(y)), y))).otherwise(total(both(x, folded(y, F.size(x)))))


def _confirm(size: int, percent: int):
    """Rows of (hub, part, leaf, text) in order, a hub's own text (leaf null) first: the pairs whose sets are as alike as `percent` says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, np.uint64)
        for batch in slices(batches):
            h, starts = sets(batch["text"], size)
            keep = np.zeros(batch.num_rows, bool)
            for i, head in enumerate(batch["leaf"].is_null().to_numpy(zero_copy_only=False).tolist()):
                other = np.unique(h[starts[i] : starts[i + 1]])
                if head:
                    own = other
                    continue
                both = len(np.intersect1d(own, other, assume_unique=True))
                keep[i] = 100 * both >= percent * (len(own) + len(other) - both)
            yield pa.RecordBatch.from_arrays([batch["hub"], batch["leaf"]], ["a", "b"]).filter(pa.array(keep))

    return run


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 85) -> DataFrame:
    """One row per row of df: key, n_shingles, component_id, kept.

    A set holds the distinct runs of `size` words (A-Z as a-z); a text with fewer words has its whole sequence as one
    shingle. Two documents are linked if 100 * intersection >= percent * union, confirmed on full sets of 64-bit hashes.
    component_id is the smallest key that a document reaches; kept says that it is its own.
    Null texts and texts without words: 0 shingles, linked with nothing. Null keys: component null, kept, linked with nothing.
    Rows that share a key are one node: each is returned, and each is linked through any of them.
    Only key and text are read, whatever other columns are called. An empty table gives an empty result.
    A pair at the threshold misses all bands with probability 5e-9 at 80 per cent, and fails the estimate with about 3e-7.
    """
    kind = df.schema[key].dataType.simpleString()
    docs = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    all_ = saved(docs.mapInArrow(_sketch(size), f"key {kind}, n long, same binary, bands array<long>, sig array<long>, odd array<long>"), "sketch")
    some = all_.where("n > 0 AND key IS NOT NULL")
    nodes = some.groupBy("same").agg(F.min("key").alias("node"))
    own = some.join(nodes, (some.same == nodes.same) & (some.key == nodes.node), "left_semi").dropDuplicates(["key", "same"])

    entries = own.select("key", F.explode("bands").alias("band"))
    shared = entries.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    met = saved(entries.join(shared, "band"), "met")
    some_met = met.select("key").distinct()
    texts = saved(docs.join(some_met, "key", "left_semi").select("key", "text"), "texts")
    sized = saved(own.select("key", F.col("n").alias("size"), "sig", "odd").join(some_met, "key", "left_semi"), "sized")
    a, b = (sized.select(F.col("key").alias(k), F.col("size").alias(f"n_{k}"), F.col("sig").alias(f"sig_{k}"), F.col("odd").alias(f"odd_{k}")) for k in ("hub", "leaf"))
    near = F.least("n_hub", "n_leaf") * 100 >= F.greatest("n_hub", "n_leaf") * percent
    near &= lanes("sig_hub", "sig_leaf") >= least_lanes(percent)
    near &= apart("odd_hub", "odd_leaf") * (100 + percent) <= (F.col("n_hub") + F.col("n_leaf")) * (100 - percent)

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The links among pairs of (hub, leaf), written. A hub's text goes to each part of its leaves once."""
        many = pairs.groupBy(F.col("hub").alias("h")).agg(F.ceil(F.count("*") / LEAVES).alias("parts"))
        dealt = pairs.join(many, F.col("hub") == F.col("h")).select("hub", F.pmod(F.xxhash64("leaf"), F.col("parts")).alias("part"), "leaf")
        heads = dealt.select("hub", "part").distinct()
        rows = dealt.join(texts, F.col("leaf") == F.col("key")).select("hub", "part", "leaf", "text")
        rows = rows.union(heads.join(texts, F.col("hub") == F.col("key")).select("hub", "part", F.lit(None).cast(kind).alias("leaf"), "text"))
        rows = rows.repartition("hub", "part").sortWithinPartitions("hub", "part", F.asc_nulls_first("leaf"))
        return saved(rows.mapInArrow(_confirm(size, percent), f"a {kind}, b {kind}"), "links")

    # the text that others were copied from shares most of its bands with most of them: the busiest node leads its buckets
    busy = met.groupBy(F.col("key").alias("k")).agg(F.sum("n").alias("busy"))
    leads = met.join(busy, F.col("key") == F.col("k")).groupBy("band").agg(F.max(F.struct("busy", "key"))["key"].alias("hub"))
    star = met.join(leads, "band").where("key <> hub").select("hub", F.col("key").alias("leaf")).distinct()
    star = star.join(a, "hub").join(b, "leaf").where(near).select("hub", "leaf", lanes("sig_hub", "sig_leaf").alias("lanes"))
    best = F.row_number().over(Window.partitionBy("leaf").orderBy(F.desc("lanes"), "hub"))  # a leaf has BANDS hubs at most
    roots = components(confirmed(star.withColumn("best", best).where("best <= 2").select("hub", "leaf")))

    def placed() -> DataFrame:
        return met.select("band", "key").join(roots, F.col("key") == F.col("node"), "left").select("band", "key", F.coalesce("root", "key").alias("root"))

    # rounds only leave less to the last step, which is complete without them: one that links little is the last
    turn, open_, nodes_met = 0, True, sized.count()
    while open_:
        at = saved(placed(), "placed")
        of = at.groupBy("band", "root").agg(F.count("*").alias("n"), F.min_by("key", F.xxhash64("key", F.lit(turn))).alias("hub"))
        mains = of.groupBy("band").agg(F.max(F.struct("n", "root", "hub")).alias("main"), F.sum("n").alias("n"), F.count("*").alias("roots")).where("roots > 1").select("band", "n", "main.root", "main.hub")
        mains = mains.withColumnRenamed("root", "main")
        pairs = at.join(mains, "band").where("root <> main").select("hub", F.col("key").alias("leaf")).distinct()
        links = confirmed(pairs.join(a, "hub").join(b, "leaf").where(near).select("hub", "leaf"))
        linked = links.count()
        turn, open_ = turn + 1, linked * ROUND > nodes_met
        if linked:
            roots = joined(roots, links)

    rest = saved(at.join(mains.select("band", "main", F.ceil(F.col("n") / DEAL).alias("deals")), "band").join(sized, "key"), "rest")
    x = rest.where("root <> main").select("band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)).alias("deal"), F.col("key").alias("leaf"), F.col("root").alias("ra"), F.col("size").alias("n_leaf"), F.col("sig").alias("sig_leaf"), F.col("odd").alias("odd_leaf"))
    y = rest.select(F.col("band").alias("bucket"), F.pmod(F.xxhash64("key"), F.col("deals")).alias("dealt"), F.col("key").alias("hub"), F.col("root").alias("rb"), "main", F.col("size").alias("n_hub"), F.col("sig").alias("sig_hub"), F.col("odd").alias("odd_hub"))
    once = (F.col("rb") == F.col("main")) | (F.col("leaf") < F.col("hub"))
    cross = x.join(y, (F.col("band") == F.col("bucket")) & (F.col("deal") == F.col("dealt")) & (F.col("ra") != F.col("rb")) & once & near)
    roots = joined(roots, confirmed(saved(cross.select("hub", "leaf").distinct(), "cross")))

    # all texts without words have one digest, and need no join
    rows = all_.where("n > 0").select("key", "n", "same").join(nodes, "same", "left").join(roots, "node", "left").select("key", "n", F.coalesce("root", "node").alias("part"))
    rows = rows.union(all_.where("n = 0").select("key", "n", "key"))
    rows = rows.select(F.col("key"), F.col("n").alias("n_shingles"), F.when(F.col("key").isNotNull(), F.col("part")).alias("component_id"))
    return rows.select(F.col("key").alias(key), "n_shingles", "component_id", F.coalesce(F.col("key") == F.col("component_id"), F.lit(True)).alias("kept"))


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after more links: they join components whole, so only roots are linked."""
    ra, rb = (roots.select(F.col("node").alias(k), F.col("root").alias(f"root_{k}")) for k in ("a", "b"))
    links = links.join(ra, "a", "left").join(rb, "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    tops = components(links).select(F.col("node").alias("root"), F.col("root").alias("top"))
    return saved(roots.join(tops, "root", "full").select(F.coalesce("node", "root").alias("node"), F.coalesce("top", "root").alias("root")), "roots")
