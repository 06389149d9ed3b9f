"""Periodic runs of words, from Lyndon arrays that the first phase of Baier's suffix sorter yields under an order and its reverse.

Baier (2016) sorts suffixes in two phases. The first groups them by their longest Lyndon prefix: groups are taken from the highest down, each
finds for its members the nearest place to the left that stands in a lower group, and a place found l times has its prefix followed by l copies
of the group's. So its context grows by l contexts, and when all groups are done, the length of a place's context is its Lyndon array entry.
By the runs theorem (Bannai and others, 2017) each run has a Lyndon root of its period under the order or under its reverse; roots are extended
to both sides by longest common extensions of a place and the place one period on.

Texts are independent, so nothing is shuffled. Two exact steps keep the work small: words are numbered by first occurrence, and only stretches
that can hold a run of four periods are grouped at all. From its fourth word on at the latest, each three-word window of such a run stands one
period before as well, so the distances to the window's last occurrence stay within a third of the stretch.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, slices

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def lyndon_array(ranks: list[int], kinds: int) -> list[int]:
    """For each place the length of the longest Lyndon word that starts there, for letters 0 to kinds - 1: phase one of Baier's sorter."""
    n = len(ranks)
    group, length, left, done = list(ranks), [1] * n, list(range(-1, n - 1)), bytearray(n)
    members: list[list[int]] = [[] for _ in range(kinds)]
    for i, r in enumerate(ranks):
        members[r].append(i)
    under, over = list(range(-1, kinds - 1)), [*range(1, kinds), -1]
    g = kinds - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        members[g] = []
        for i in own:
            done[i] = 1
        hits: dict[int, int] = {}
        for i in own:
            # the nearest place to the left in a lower group; places passed by point to it from now on
            j = left[i]
            if j >= 0 and done[j]:
                path = [i]
                while j >= 0 and done[j]:
                    path.append(j)
                    j = left[j]
                for x in path:
                    left[x] = j
            if j >= 0:
                hits[j] = hits.get(j, 0) + 1
        if hits:
            step = length[own[0]]
            parts: dict[tuple[int, int], list[int]] = {}
            for j, times in hits.items():
                parts.setdefault((times, group[j]), []).append(j)
            for times, old in sorted(parts, reverse=True):
                moved, new = parts[times, old], len(members)
                for j in moved:
                    group[j] = new
                    length[j] += times * step
                members.append(moved)
                above = over[old]
                under.append(old)
                over.append(above)
                over[old] = new
                if above >= 0:
                    under[above] = new
        g = under[g]
    return length


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of the stretches outside which no run of at least four periods and six words can lie. Equal hashes of unlike windows only add to them."""
    n = len(ids)
    if n < 6:
        return []
    h = ids.astype(np.uint64)
    h = mix(mix(h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1]) + h[2:])
    order = np.argsort(h, kind="stable")
    far = np.full(n - 2, n, np.int64)  # distance to the same window's last occurrence
    same = h[order[1:]] == h[order[:-1]]
    far[order[1:][same]] = (order[1:] - order[:-1])[same]
    near = far < n
    while True:
        edge = np.flatnonzero(np.diff(np.r_[False, near, False].astype(np.int8)))
        begin, end = edge[::2], edge[1::2]
        most = (end - begin + 2) // 3  # a run's windows from its second period on, 3 q - 2 of them or more
        keep = far[near] <= np.repeat(most, end - begin)
        if keep.all():
            break
        near[np.flatnonzero(near)[~keep]] = False
    out: list[tuple[int, int]] = []
    for a, b, q in zip(begin.tolist(), end.tolist(), most.tolist()):
        if b - a >= 3:
            a, b = max(0, a - q), min(n, b + 2)
            while out and a < out[-1][1]:  # a later stretch of long periods may reach back over several
                c, d = out.pop()
                a, b = min(a, c), max(b, d)
            out.append((a, b))
    return out


def extension(ids: np.ndarray, i: int, j: int) -> int:
    """How many words from i and from j > i on are equal: compared in steps that double."""
    k, step, n = 0, 16, len(ids)
    while j + k < n:
        m = min(step, n - j - k)
        same = ids[i + k : i + k + m] == ids[j + k : j + k + m]
        if not same.all():
            return k + int(same.argmin())
        k += m
        step *= 2
    return k


def runs(ids: np.ndarray, words: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of all runs of at least `words` words and `times` periods, in order. times is 4 or more."""
    n, back = len(ids), ids[::-1]
    found: dict[tuple[int, int], int] = {}
    for a, b in stretches(ids):
        kinds, ranks = np.unique(ids[a:b], return_inverse=True)
        for r in (ranks, len(kinds) - 1 - ranks):
            q = np.array(lyndon_array(r.tolist(), len(kinds)), np.int64)
            i = np.arange(a, b)
            # behind a run's first root stand two periods more
            fits = i + 3 * q <= n
            i, q = i[fits], q[fits]
            fits = ids[i] == ids[i + q]
            i, q = i[fits], q[fits]
            fits = (ids[i + q - 1] == ids[i + 2 * q - 1]) & (ids[i + 2 * q - 1] == ids[i + 3 * q - 1]) & (ids[i + q] == ids[i + 2 * q])
            ends: dict[int, int] = {}
            for x, p in zip(i[fits].tolist(), q[fits].tolist()):
                if x + 2 * p <= ends.get(p, 0):
                    continue  # a later root of the same run
                start = x - extension(back, n - x - p, n - x)
                end = x + p + extension(ids, x, x + p)
                ends[p] = end
                if end - start >= max(words, times * p):
                    found[start, p] = end - start
    return sorted((s, length, p) for (s, p), length in found.items())


def numbered(words: list[bytes]) -> np.ndarray:
    """Each word's number: the place of its first occurrence."""
    seen: dict[bytes, int] = {}
    return np.fromiter(map(seen.setdefault, words, count()), np.int64, len(words))


def periodic_runs(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 6, times: int = 4) -> DataFrame:
    """One row per row of df: key, n_words, n_runs, start, length, period, runs, collapsed.

    A run is a longest stretch of consecutive words that are equal to those one smallest period on, with at least `words` words and `times` periods.
    runs lists (start, length, period) by start, then period; start, length and period are those of the longest run, of equal ones the first, of these
    the one with the smallest period; null without a run. collapsed is the text's words, joined by one space, without those that a run holds behind its first period.
    Words are compared byte by byte. Null and empty texts have no words. Null and repeated keys are returned as they are. Only key and text are read,
    whatever other columns are called. An empty table gives an empty result. A worker's memory grows with its longest text.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, budget=1 << 20):
            counts, found, rest = [], [], []
            for data in batch["text"].to_pylist():
                own = (data or b"").split()
                have = runs(numbered(own), words, times)
                if have:
                    change = np.zeros(len(own) + 1, np.int32)
                    for s, length, p in have:
                        change[s + p] += 1
                        change[s + length] -= 1
                    stays = np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()
                    rest.append(b" ".join([own[i] for i in stays]))
                else:
                    rest.append(b" ".join(own))
                counts.append(len(own))
                found.append([{"start": s, "length": length, "period": p} for s, length, p in have])
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(counts, pa.int64()), pa.array(found, pa.list_(RUN)), pa.array(rest, pa.binary()).cast(pa.string())], ["key", "n_words", "runs", "collapsed"])

    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").cast("binary").alias("text"))
    rows = rows.mapInArrow(run, f"key {kind}, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    rows = rows.withColumn("best", F.when(F.size("runs") > 0, best))
    return rows.select(F.col("key").alias(key), "n_words", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.n")).alias("length"), F.col("best.period").alias("period"), "runs", "collapsed")
