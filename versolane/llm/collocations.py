"""Phrase collocation mining by marginalising the longest windows.

Each word of a piece leads one window: itself and the words behind it, up to `SIZE`, padded with null where the window ends. Only these windows are
counted. Spark's ROLLUP over the lead columns then sums them to every shorter prefix: a phrase's count is the sum of all windows that start with it, a word's
and a language's likewise. No phrase length is exploded on its own.

Most windows occur once, and their phrases are under the bar. So a first pass counts hashes of neighbouring words, and those over the bar set bits of a
filter of fixed size; a window ends before a pair that the filter doesn't know. A phrase over the bar has no such pair, so its count stays exact; a wrong
answer of the filter costs a longer window and no more.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, saved, slices

SIZE = 5
LEAD = [f"w{k}" for k in range(1, SIZE + 1)]
#: Words are cut at white space, pieces at these marks; A-Z count as a-z. Pieces are lines for the code.
MARKS = b".,;:!?\n\x0b\x0c\r"
FOLD = bytes(10 if c in MARKS else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bits of the pair filter: 16 MB in a worker, at most 2 million rows of 64 bits on their way there. Two bits a pair.
FILTER_BITS = 27
BATCH = 1 << 21
#: As many languages are sent to all workers; with more, their totals are joined by a shuffle.
LANGUAGES = 10_000


class _Text:
    """The words of some texts of one language: number of each, distinct words by number, and whether a word is the last of its piece."""

    def __init__(self, texts: list[bytes]):
        seen: dict[bytes, int] = {}
        numbers, ends, total = [], [], 0
        for text in texts:
            for piece in text.translate(FOLD).split(b"\n"):
                own = piece.split()
                if own:
                    numbers.append(np.fromiter(map(seen.setdefault, own, count(total)), np.int64, len(own)))
                    total += len(own)
                    ends.append(total - 1)
        # numbers are first places; now 0, 1, ... in order of these
        self.words = list(seen)
        first = np.fromiter(seen.values(), np.int64, len(seen))
        raw = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        self.at = np.searchsorted(first, raw)
        self.last = np.zeros(total, bool)
        self.last[ends] = True

    def pairs(self, lang: str) -> np.ndarray:
        """A hash for each word and the one behind it; meaningless at the end of a piece."""
        seed = xxhash.xxh3_64_intdigest(lang.encode())
        h = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in self.words), np.uint64, len(self.words))[self.at]
        return mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + mix(h[1:])) if len(h) else h


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, _Text]]:
    for batch in slices(batches, budget=BATCH):
        texts: dict[str, list[bytes]] = {}
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
            texts.setdefault(lang, []).append(text)
        for lang, own in texts.items():
            yield lang, _Text(own)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lang, text in _by_language(batches):
        h, n = np.unique(text.pairs(lang)[~text.last[:-1]], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["pair", "n"])


def _bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << FILTER_BITS) - 1)
    return (h & mask).astype(np.int64), (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def pair_filter(texts: DataFrame, least: int) -> np.ndarray:
    """Bytes of the filter: two bits for each pair of neighbouring words that occurs `least` times in a language, by hash."""
    often = texts.mapInArrow(_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    low, high = F.col("pair").bitwiseAND((1 << FILTER_BITS) - 1), F.shiftrightunsigned("pair", 64 - FILTER_BITS)
    cell = often.select(F.explode(F.array(low, high)).alias("bit")).groupBy(F.shiftright("bit", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
    got = saved(cell, "pairs").toArrow()  # 2 ** (FILTER_BITS - 6) rows at most, whatever the input; once written, the pairs' shuffle files go
    out = np.zeros(1 << FILTER_BITS - 6, np.int64)
    out[np.asarray(got["cell"].combine_chunks())] = np.asarray(got["bits"].combine_chunks())
    return out.view(np.uint8)


def _windows(known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = known.value

        def has(place: np.ndarray) -> np.ndarray:
            return (bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)

        for lang, text in _by_language(batches):
            n = len(text.at)
            if not n:
                continue
            on = np.zeros(n + SIZE, bool)  # whether the window goes on behind a word
            inner = np.flatnonzero(~text.last[:-1])
            low, high = _bits(text.pairs(lang)[inner])
            on[inner[has(low) & has(high)]] = True
            lead, alive = np.full((n, SIZE), -1, np.int32), np.ones(n, bool)
            lead[:, 0] = text.at
            for k in range(1, SIZE):
                alive &= on[k - 1 : k - 1 + n]
                at = np.flatnonzero(alive)
                lead[at, k] = text.at[at + k]
            single = lead[:, 1] < 0
            often = np.bincount(lead[single, 0], minlength=len(text.words))
            one = np.flatnonzero(often)
            many = np.flatnonzero(~single)
            same = lead[many, 0].astype(np.int64)
            for k in range(1, SIZE):
                _, same = np.unique(same * (len(text.words) + 1) + lead[many, k] + 1, return_inverse=True)
            _, at, times = np.unique(same, return_index=True, return_counts=True)
            more = lead[many[at]]
            words = pa.array(text.words, pa.binary()).cast(pa.string())
            empty = np.full(len(one), -1)
            columns = [np.concatenate([one if k == 0 else empty, more[:, k]]) for k in range(SIZE)]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(columns[0]), pa.string()), *(words.take(pa.array(c, pa.int64(), mask=c < 0)) for c in columns), pa.array(np.concatenate([often[one], times]).astype(np.int64))], ["lang", *LEAD, "n"])

    return run


def counted(df: DataFrame, text: str = "text", lang: str = "lang", least: int = 100) -> DataFrame:
    """(lang, size, words, n): every phrase of 1 to SIZE words that occurs `least` times in its language, and each language itself with size 0 and the count of all its words."""
    texts = df.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    known = df.sparkSession.sparkContext.broadcast(pair_filter(texts, least))
    windows = texts.mapInArrow(_windows(known), f"lang string, {', '.join(f'{w} string' for w in LEAD)}, n long").groupBy("lang", *LEAD).agg(F.sum("n").alias("n"))
    sums = windows.rollup("lang", *LEAD).agg(F.sum("n").alias("n"), F.grouping_id().alias("level"))
    # a prefix of k words leaves the last SIZE - k columns out: its grouping id is 2 ** (SIZE - k) - 1
    size = F.lit(SIZE) - F.round(F.log2(F.col("level") + 1)).cast("int")
    words = F.array(*LEAD)
    # padding is no word: a prefix that ends in it was counted as a shorter one
    sums = sums.where((F.col("level") < (1 << SIZE)) & ((F.col("level") == (1 << SIZE) - 1) | (F.col("n") >= least))).withColumn("size", size)
    return sums.where((F.col("size") == 0) | F.get(words, F.col("size") - 1).isNotNull()).select("lang", "size", F.slice(words, 1, F.col("size")).alias("words"), "n")


def score(a: Column, n: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000 a n / (l r)) in exact decimals of 38 digits."""
    wide = lambda c: c.cast("decimal(17,0)")
    return F.call_function("div", wide(a) * wide(n) * F.lit(1000).cast("decimal(4,0)"), wide(l) * wide(r)).cast("long")


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases of 2 to SIZE words by score, then count, both descending, then phrase in byte order.

    Texts are cut into pieces at . , ; : ! ? and line ends, pieces into words at spaces and tabs; A-Z count as a-z. n counts the language's words, a the phrase's occurrences
    within pieces, overlaps included. A phrase needs a >= least. Cut after its first k words, its parts occur l and r times, and its score is the lowest floor(1000 a n / (l r)) over k, that of
    the smallest k among equals. A phrase goes if a longer one over the bar holds its words side by side and occurs as often. Null languages count as `und`, null texts as empty.
    Only text and lang are read, whatever other columns are called; repeated rows count each. An empty table gives an empty result.
    """
    sums = saved(counted(df, text, lang, least), "phrases")
    total = sums.where("size = 0").select(F.col("lang").alias("of"), F.col("n").alias("total"))
    if total.limit(LANGUAGES + 1).count() <= LANGUAGES:
        total = F.broadcast(total)  # a row for each language
    known = sums.where("size > 0").select("lang", F.array_join("words", " ").alias("part"), "n")
    phrases = sums.where("size > 1").select("lang", "size", "words", F.array_join("words", " ").alias("phrase"), F.col("n").alias("a"))
    cuts = phrases.select("lang", "phrase", "a", F.explode(F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.struct(k.alias("k"), F.array_join(F.slice("words", 1, k), " ").alias("head"), F.array_join(F.slice("words", k + 1, F.col("size") - k), " ").alias("tail")))).alias("c")).select("lang", "phrase", "a", "c.*")
    heads, tails = known.select("lang", F.col("part").alias("head"), F.col("n").alias("l")), known.select("lang", F.col("part").alias("tail"), F.col("n").alias("r"))
    cuts = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(total, F.col("lang") == F.col("of"))
    lowest = F.min(F.struct(score(F.col("a"), F.col("total"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r"))
    scored = cuts.groupBy("lang", "phrase", "a", F.col("total").alias("n")).agg(lowest.alias("low")).select("lang", "phrase", "a", "n", "low.score", "low.l", "low.r")
    inside = phrases.where("size > 2").select("lang", "a", "size", "words", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m"))
    inside = inside.select("lang", "a", F.explode(F.transform(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1), lambda i: F.array_join(F.slice("words", i, F.col("m")), " "))).alias("phrase"))
    longer = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = scored.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < 100 * F.col("a")))
    # the best of each of 64 parts of a language first, so no task ranks a whole language
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = left.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("rank") <= top).drop("part", "rank")
    out = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
