"""Removal of repeated byte strings by a sparse suffix array, built by common-prefix-aware distributed merge sort.

The merge sort is that of Bingmann, Sanders and Schimek (2020): sorted runs are exchanged front-coded, and a loser tree that
knows the common prefixes merges them without comparing known prefixes again. What is sorted is kept small in two exact ways:

1. Anchors. Each window of `SPAN` bytes has an anchor, the place in it whose `GRAM` bytes have the least hash (as in winnowing,
   Schleimer and others, 2003). Equal windows have equal anchors at equal places, so one suffix for each anchor, with as much
   text on either side as its windows reach, stands for all of them.
2. Duplicate detection before the exchange. Only anchors whose GRAM bytes occur in two documents are sorted at all. Hashes travel
   sorted and delta-coded, about three bytes each, and come back as bits.

So what is sorted are suffixes from sampled places, cut where their windows end. Each is written from its anchor on, then the text
before the anchor backwards, at most WIDTH bytes: a context. Sorting brings equal anchors together, and
the common prefix lengths that the merge yields tell groups of equal anchors and equal contexts without looking at the strings.
A context whose equal stands in an earlier document is removed whole. Where a group's contexts differ, their windows are compared.
Anchors of more than `HOT` documents are sorted window by window instead and dealt by the window, so no group gathers in a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, BYTES, _powers, mix, offsets, saved, slices

SPAN, GRAM = 50, 24
REACH = SPAN - GRAM  # bytes on either side of the anchor's GRAM that a window can have
WIDTH = GRAM + 2 * REACH + 2  # anchor, text after it, text before it backwards, both lengths
BLOCK = 1 << 22
PLACE = (1 << 18) - 1  # bits of a hash that give way to its place in a chunk
HOT = 512
LAST = (1 << 63) - 1  # stands for a null key: after all others
MANY = 512  # hashes, or numbers of removals, from which a piece is packed
TAILS = 1 << 11  # bytes of suffixes from which a piece is packed
UNITS = 1 << 16  # suffixes of a block that are sorted at once, about


def _squeeze(x: np.ndarray) -> bytes:
    """Bytes of like weight together, so that small numbers in wide fields cost little."""
    return zstandard.compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes(), 3) if len(x) else b""


def _loose(data: bytes, kind: type) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _plain(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 3)


def _bytes(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), np.uint8)


def _cells(values: np.ndarray, counts: np.ndarray, packed: np.ndarray, pack: Callable[[np.ndarray], bytes]) -> pa.Array:
    """A binary cell for each piece of values: packed, or its bytes as they are. Small pieces are many, so they are never handled one by one."""
    ends, raw, size = np.r_[0, np.cumsum(counts)], np.ascontiguousarray(values).tobytes(), values.itemsize
    if not packed.any():
        return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer((ends * size).astype(np.int32).tobytes()), pa.py_buffer(raw)])
    return pa.array([pack(values[a:b]) if p else raw[a * size : b * size] for a, b, p in zip(ends[:-1].tolist(), ends[1:].tolist(), packed.tolist())], pa.binary())


def _values(cells: pa.Array, packed: np.ndarray, kind: type, unpack: Callable[[bytes], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """What _cells has put away and how many values each cell has: packed cells first, see _order."""
    some = [unpack(x) for x in cells.filter(pa.array(packed)).to_pylist()] if packed.any() else []
    flat, off = offsets(cells.filter(pa.array(~packed)) if packed.any() else cells)
    size = np.dtype(kind).itemsize
    return np.concatenate([*some, np.frombuffer(flat.tobytes(), kind)]), np.r_[np.array([len(x) for x in some], np.int64), np.diff(off) // size]


def _order(packed: np.ndarray) -> np.ndarray:
    return np.r_[np.flatnonzero(packed), np.flatnonzero(~packed)]


def _flags(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy(), bool)


def units(flat: np.ndarray, off: np.ndarray, chunk: int = 1 << 17) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window, hash) of each run of windows that share an anchor. No window crosses the edge of a text.

    Windows are taken `chunk` at a time, so a long text needs no more memory than a short one. A run may be cut where a chunk ends.
    """
    n = len(flat)
    doc = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(off))
    out = []
    for begin in range(0, n - SPAN + 1, chunk):
        b = flat[begin : begin + chunk + SPAN - 1].astype(np.uint64)
        m = len(b) - SPAN + 1
        x, s = b, 1
        while s < 8:  # eight bytes from each place
            x = x[:-s] | x[s:] << np.uint64(8 * s)
            s *= 2
        k = len(b) - GRAM + 1
        h = np.zeros(k, np.uint64)
        for o in range(0, GRAM, 8):
            h = (h ^ x[o : o + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        low, span = h & ~np.uint64(PLACE) | np.arange(k, dtype=np.uint64), 1
        while span <= REACH + 1:  # the least of 2, 4, 8, ... places, then of REACH + 1; of equal hashes the leftmost
            step = min(span, REACH + 1 - span)
            if step == 0:
                break
            low = np.minimum(low[step:], low[:-step])
            span += step
        at = (low & np.uint64(PLACE)).astype(np.int32)
        fits = doc[begin : begin + m] == doc[begin + SPAN - 1 : begin + SPAN - 1 + m]
        edge = np.ones(m + 1, bool)
        edge[1:m] = (at[1:m] != at[: m - 1]) | (fits[1:] != fits[:-1]) | (doc[begin + 1 : begin + m] != doc[begin : begin + m - 1])
        cut = np.flatnonzero(edge)
        first, last = cut[:-1], cut[1:] - 1
        own = fits[first]
        first, last = first[own], last[own]
        out.append((at[first].astype(np.int64) + begin, first + begin, last + begin, mix(h[at[first]])))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


def _blocks(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        for batch in slices(batches, budget=block):
            flat, off = offsets(batch["text"])
            keys = np.asarray(batch["key"].fill_null(LAST))
            yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + k], pa.int64()), pa.array([len(flat)], pa.int64()), *(pa.array([zstandard.compress(x.tobytes(), 3)], pa.binary()) for x in (keys, off, flat))], ["bid", "size", "keys", "off", "data"])
            k += 1

    return run


def _opened(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(bid, keys, offsets, bytes, row) of each block."""
    for i in range(batch.num_rows):
        keys, off, data = (zstandard.decompress(batch[c][i].as_buffer()) for c in ("keys", "off", "data"))
        yield batch["bid"][i].as_py(), np.frombuffer(keys, np.int64), np.frombuffer(off, np.int64), np.frombuffer(data, np.uint8), i


def _prints(anchor: np.ndarray, g: np.ndarray, off: np.ndarray, radixes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct anchor hashes of a block in order of radix and their lower 32 bits: radix, bits, in how many texts (255 at most), and of each unit its place among them."""
    radix = ((g >> np.uint64(32)) % np.uint64(radixes)).astype(np.uint64)
    name = radix << np.uint64(32) | (g & np.uint64(0xFFFFFFFF))
    doc = np.searchsorted(off, anchor, side="right").astype(np.int64)
    u, at = np.unique(name, return_inverse=True)
    pair = np.sort(at.astype(np.int64) << np.int64(32) | doc)
    pair = pair[np.r_[True, pair[1:] != pair[:-1]]] if len(pair) else pair
    texts = np.minimum(255, np.bincount(pair >> 32, minlength=len(u))).astype(np.uint8)
    return (u >> np.uint64(32)).astype(np.int64), u.astype(np.uint32), texts, at


def _send_prints(radixes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bid, _, off, flat, _ in _opened(batch):
                anchor, _, _, g = units(flat, off)
                radix, low, texts, _ = _prints(anchor, g, off, radixes)
                own, start = np.unique(radix, return_index=True)
                n = np.diff(np.r_[start, len(radix)])
                packed = n >= MANY
                cells = _cells(low, n, packed, lambda x: _squeeze(np.diff(x, prepend=np.uint32(0)))), _cells(texts, n, packed, _plain)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), bid, np.int64)), pa.array(packed), *cells], ["radix", "bid", "packed", "low", "count"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[tuple[int, pa.Table]]:
    """Rows of a sorted partition, one group at a time."""
    key, held = None, []
    for batch in batches:
        name = np.asarray(batch[by])
        edge = [0, *(np.flatnonzero(np.diff(name)) + 1).tolist(), len(name)]
        for a, b in zip(edge[:-1], edge[1:]):
            if a < b:
                if held and name[a] != key:
                    yield key, pa.Table.from_batches(held)
                    held = []
                key = int(name[a])
                held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held)


def _judge_prints(hot: int):
    """For each block's hashes of a radix: 0 if in one text only, 1 if in more, 2 if in over `hot`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for radix, rows in _groups(batches, "radix"):
            packed = _flags(rows["packed"])
            low, n = _values(rows["low"], packed, np.uint32, lambda x: np.cumsum(_loose(x, np.uint32), dtype=np.uint32))
            counts, _ = _values(rows["count"], packed, np.uint8, _bytes)
            u, at = np.unique(low, return_inverse=True)
            total = np.bincount(at, counts)
            verdict = ((total > 1).astype(np.uint8) + (total > hot))[at].astype(np.uint8)
            order = _order(packed)
            cells = _cells(verdict, n, packed[order], _plain)
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(rows["bid"])[order]), pa.array(np.full(len(order), radix, np.int64)), pa.array(packed[order]), cells], ["bid", "radix", "packed", "verdict"])

    return run


def _verdicts(told: pa.Array | None) -> np.ndarray:
    """A block's verdicts, radix by radix."""
    if told is None or not len(told):
        return np.zeros(0, np.uint8)
    packed = _flags(told.field("packed"))
    got, n = _values(told.field("verdict"), packed, np.uint8, _bytes)
    start, by = np.cumsum(n) - n, np.argsort(np.asarray(told.field("radix"))[_order(packed)])
    n = n[by]
    return got[np.repeat(start[by] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def contexts(flat: np.ndarray, anchor: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """One row of WIDTH bytes for each unit; equal rows mean equal contexts, and rows sort by anchor, text after, text before."""
    after, before = last + SPAN - anchor - GRAM, anchor - first
    row = np.zeros((len(anchor), WIDTH), np.uint8)
    top = len(flat) - 1
    for j in range(GRAM):
        row[:, j] = flat[anchor + j]
    for j in range(REACH):
        row[:, GRAM + j] = np.where(j < after, flat[np.minimum(anchor + GRAM + j, top)], 0)
        row[:, GRAM + REACH + j] = np.where(j < before, flat[np.maximum(anchor - 1 - j, 0)], 0)
    row[:, -2], row[:, -1] = after, before
    return row


RUN = ["part", "bid", "packed", "lcp", "tails", "keys", "firsts"]


def _runs(radixes: int, parts: int):
    """Sorted, front-coded runs of a block's suffixes, one for each part that has any; and what the block decides by itself: a row without lcp, for any part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bid, keys, off, flat, i in _opened(batch):
                anchor, first, last, g = units(flat, off)
                verdict = _verdicts(batch["verdicts"][i].values)[_prints(anchor, g, off, radixes)[3]]
                cold, hot = verdict == 1, verdict == 2
                n = (last - first + 1)[hot]
                single = np.repeat(first[hot] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                power, back = _powers(1 << max(18, (len(flat) + 1).bit_length()))
                total = np.zeros(len(flat) + 1, np.uint64)
                np.cumsum(BYTES[flat] * power[: len(flat)], out=total[1:])
                deal = np.concatenate([mix(g[cold]), mix((total[single + SPAN] - total[single]) * back[single])])
                part = (deal >> np.uint64(20)) % np.uint64(parts)
                anchor, first, last = np.concatenate([anchor[cold], np.repeat(anchor[hot], n)]), np.concatenate([first[cold], single]), np.concatenate([last[cold], single])
                if not len(anchor):
                    continue
                key = keys[np.searchsorted(off, anchor, side="right") - 1]
                gone_a, gone_b = [], []
                order = np.argsort(part, kind="stable")
                heads = np.flatnonzero(np.r_[True, part[order[1:]] != part[order[:-1]]])
                cuts = heads[np.minimum(np.searchsorted(heads, np.arange(UNITS, len(order), UNITS)), len(heads) - 1)]
                for own in np.split(order, np.unique(cuts)):
                    if not len(own):
                        continue
                    # all parts of these units at once: sorted by context, then by part
                    rows = contexts(flat, anchor[own], first[own], last[own])
                    rank = np.argsort(rows.view(f"S{WIDTH}").reshape(-1), kind="stable")
                    rank = rank[np.argsort(part[own[rank]], kind="stable")]
                    own, rows = own[rank], rows[rank]
                    new = np.r_[True, (rows[1:] != rows[:-1]).any(axis=1) | (part[own[1:]] != part[own[:-1]])]
                    group = np.cumsum(new) - 1
                    least = np.minimum.reduceat(key[own], np.flatnonzero(new))[group]
                    stays = key[own] == least
                    gone_a.append(first[own[~stays]])
                    gone_b.append(last[own[~stays]])
                    own, rows = own[stays], rows[stays]
                    fresh = np.r_[True, part[own[1:]] != part[own[:-1]]]
                    differ = rows[1:] != rows[:-1]
                    lcp = np.r_[0, np.where(differ.any(axis=1), differ.argmax(axis=1), WIDTH)].astype(np.uint8)
                    lcp[fresh] = 0
                    tails = rows[np.arange(WIDTH) >= lcp[:, None]]
                    head = np.flatnonzero(fresh)
                    n, size = np.diff(np.r_[head, len(own)]), np.add.reduceat(WIDTH - lcp.astype(np.int64), head)
                    packed = size >= TAILS
                    cells = _cells(lcp, n, packed, _plain), _cells(tails, size, packed, _plain), _cells(key[own], n, packed, _squeeze), _cells(first[own].astype(np.uint32), n, packed, _squeeze)
                    yield pa.RecordBatch.from_arrays([pa.array(part[own[head]].astype(np.int64)), pa.array(np.full(len(head), bid, np.int64)), pa.array(packed), *cells], RUN)
                a, b = (pa.array([_squeeze(np.concatenate(x).astype(np.uint32))], pa.binary()) for x in (gone_a, gone_b))
                nothing = pa.array([None], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([bid % parts], pa.int64()), pa.array([bid], pa.int64()), pa.array([True]), nothing, nothing, a, b], RUN)

    return run


def merged(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """(run, place in it, common prefix with what came before) of all strings in order: a loser tree that knows common prefixes.

    runs: for each its sorted strings, all of one length, and each one's common prefix with the string before it.
    Against the last winner, the string with the longer common prefix is the smaller; only on a tie are bytes compared, from the known prefix on.
    """
    size = 1
    while size < len(runs):
        size *= 2
    place = [0] * len(runs)
    head = [r[0][0] if r[0] else None for r in runs] + [None] * (size - len(runs))
    loser, known = [0] * size, [0] * size
    number = int.from_bytes

    def play(a: int, b: int, h: int) -> tuple[int, int, int]:
        """Winner, loser, common prefix of both; h bytes are known to be equal. An ended run loses."""
        x, y = head[a], head[b]
        if x is None or y is None:
            return (b, a, -1) if x is None else (a, b, -1)
        p, q = x[h:], y[h:]
        if p == q:
            return a, b, len(x)
        d = len(p) - ((number(p) ^ number(q)).bit_length() + 7) // 8
        return (a, b, h + d) if p[d] < q[d] else (b, a, h + d)

    best = list(range(size))
    nodes = {size + i: i for i in best}
    for node in range(size - 1, 0, -1):
        nodes[node], loser[node], known[node] = play(nodes[2 * node], nodes[2 * node + 1], 0)
    s, h = nodes[1], 0
    while head[s] is not None:
        k = place[s]
        yield s, k, h
        k += 1
        place[s] = k
        strings, common = runs[s]
        if k < len(strings):
            head[s], h = strings[k], common[k]
        else:
            head[s], h = None, -1
        node = (size + s) >> 1
        while node:
            c = known[node]
            if c > h:
                loser[node], s = s, loser[node]
                known[node], h = h, c
            elif c == h and h >= 0:
                s, loser[node], known[node] = play(s, loser[node], h)
            node >>= 1


def _cuts(rows: np.ndarray, group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first window, last window) to remove, of contexts (WIDTH bytes each) in groups of one anchor: windows that a smaller key of the group has too.

    A window is told by the bytes it has before the anchor and after it. Windows meet by hashes of these; what would go is compared byte by byte.
    """
    after, before = rows[:, -2].astype(np.int64), rows[:, -1].astype(np.int64)
    n = after + before - REACH + 1
    row = np.repeat(np.arange(len(rows)), n)
    j = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    p = before[row] - j
    own, place = key[row], np.arange(REACH)
    for salt in count(1):
        sides = []
        for begin in (GRAM, GRAM + REACH):
            h = np.empty((REACH + 1, len(rows)), np.uint64)
            h[0] = mix(group.astype(np.uint64) + np.uint64(salt << 40))
            for t in range(REACH):
                h[t + 1] = (h[t] ^ rows[:, begin + t]) * np.uint64(0x9FB21C651E98DF25)
                h[t + 1] ^= h[t + 1] >> np.uint64(29)
            sides.append(h)
        w = mix(sides[0][REACH - p, row] * np.uint64(BASE) + sides[1][p, row])
        order = np.argsort(w)
        new = np.r_[True, w[order[1:]] != w[order[:-1]]]
        least = np.minimum.reduceat(own[order], np.flatnonzero(new))
        at = np.cumsum(new) - 1
        first = own[order] == least[at]
        known = np.empty(len(least), np.int64)
        known[at[first]] = order[first]
        gone, kept = order[~first], known[at[~first]]
        x, y, q = rows[row[gone]], rows[row[kept]], p[gone, None]
        same = ((x[:, GRAM : GRAM + REACH] == y[:, GRAM : GRAM + REACH]) | (place >= REACH - q)).all() and ((x[:, GRAM + REACH : -2] == y[:, GRAM + REACH : -2]) | (place >= q)).all()
        if same and (p[gone] == p[kept]).all() and (group[row[gone]] == group[row[kept]]).all():
            break
    late = np.zeros(len(row), bool)
    late[gone] = True
    starts = np.flatnonzero(late & ((j == 0) | ~np.r_[False, late[:-1]]))
    ends = np.flatnonzero(late & ((j == n[row] - 1) | ~np.r_[late[1:], False]))
    return row[starts], j[starts], j[ends]


def _strings(common: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Front-coded runs, one behind the other, as rows of bytes."""
    full = np.zeros((len(common), WIDTH), np.uint8)
    own = np.arange(WIDTH) >= common[:, None]
    full[own] = data
    # a byte under the common prefix is that of the last row whose own bytes reach so far up
    return full[np.maximum.accumulate(np.where(own, np.arange(len(common), dtype=np.int32)[:, None], 0), axis=0), np.arange(WIDTH)]


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, rows in _groups(batches, "part"):
        done = np.asarray(rows["lcp"].is_null())
        if done.any():
            yield rows.filter(pa.array(done)).select(["bid", "packed", "keys", "firsts"]).rename_columns(["bid", "packed", "a", "b"]).combine_chunks().to_batches()[0]
            rows = rows.filter(pa.array(~done))
        if not rows.num_rows:
            continue
        packed = _flags(rows["packed"])
        common, n = _values(rows["lcp"], packed, np.uint8, _bytes)
        full = _strings(common, _values(rows["tails"], packed, np.uint8, _bytes)[0])
        key, _ = _values(rows["keys"], packed, np.int64, lambda x: _loose(x, np.int64))
        first, _ = _values(rows["firsts"], packed, np.uint32, lambda x: _loose(x, np.uint32))
        bids, ends = np.asarray(rows["bid"])[_order(packed)], np.r_[0, np.cumsum(n)]
        data, lcps = full.tobytes(), common.tolist()
        runs = [([data[i : i + WIDTH] for i in range(a * WIDTH, b * WIDTH, WIDTH)], lcps[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        order = np.fromiter((s << 40 | k << 8 | h for s, k, h in merged(runs)), np.int64)
        s, k, h = order >> 40, order >> 8 & 0xFFFFFFFF, order & 0xFF
        del runs, data, lcps
        at = ends[s] + k
        key, first = key[at], first[at].astype(np.int64)
        head = np.flatnonzero(np.r_[True, h[1:] < GRAM])  # where another anchor begins
        many = np.diff(np.r_[head, len(s)])
        alike = np.minimum.reduceat(np.where(h < GRAM, WIDTH, h), head) == WIDTH
        # contexts that are all equal: those of later documents go whole
        least = np.repeat(np.where(alike, np.minimum.reduceat(key, head), LAST), many)
        late = np.flatnonzero(key > least)
        out = [(s[late], first[late], first[late] + full[at[late], -2:].sum(axis=1, dtype=np.int64) - REACH)]
        mixed = np.flatnonzero(np.repeat(~alike, many))
        group = np.repeat(np.arange(len(head)), many)[mixed]
        edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else group
        cuts = edges[np.minimum(np.searchsorted(edges, np.arange(1 << 14, len(mixed), 1 << 14)), len(edges) - 1)] if len(edges) else []
        for part in np.split(np.arange(len(mixed)), np.unique(cuts)):
            if len(part):
                own = mixed[part]
                row, a, b = _cuts(full[at[own]], group[part], key[own])
                out.append((s[own[row]], first[own[row]] + a, first[own[row]] + b))
        run, a, b = (np.concatenate(x) for x in zip(*out))
        if len(run):
            by = np.argsort(bids[run], kind="stable")
            of = bids[run][by]
            head = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            n = np.diff(np.r_[head, len(of)])
            packed = n >= MANY
            yield pa.RecordBatch.from_arrays([pa.array(of[head]), pa.array(packed), *(_cells(x[by].astype(np.uint32), n, packed, _squeeze) for x in (a, b))], ["bid", "packed", "a", "b"])


def _kept(texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, keys, off, flat, i in _opened(batch):
                change = np.zeros(len(flat) + 1, np.int32)
                gone = batch["gone"][i].values
                if gone is not None:
                    a, b = (_values(gone.field(c), _flags(gone.field("packed")), np.uint32, lambda x: _loose(x, np.uint32))[0].astype(np.int64) for c in ("a", "b"))
                    np.add.at(change, a, 1)
                    np.add.at(change, b + SPAN, -1)
                cover = np.cumsum(change[:-1]) > 0
                edge = cover.copy()
                edge[1:] &= ~cover[:-1]
                edge[off[:-1][off[:-1] < len(flat)]] |= cover[off[:-1][off[:-1] < len(flat)]]
                removed, spans = (np.r_[0, np.cumsum(x)][off] for x in (cover, edge))
                stays = flat[~cover].tobytes()
                left = off - removed
                rest = [stays[a:b] for a, b in zip(left[:-1], left[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, mask=keys == LAST), pa.array(np.diff(off)), pa.array(np.diff(removed)), pa.array(np.diff(spans)),
                        pa.array(rest, pa.binary()) if texts else pa.array([hashlib.sha256(x).hexdigest() for x in rest], pa.string()),
                    ], ["key", "n_bytes", "n_removed", "n_spans", "kept" if texts else "kept_sha256"]
                )

    return run


def _removals(blocks: DataFrame, radixes: int, parts: int, hot: int) -> DataFrame:
    """(bid, a, b): first and last windows to remove of each block, written to the shared folder."""
    prints = blocks.select("bid", "keys", "off", "data").mapInArrow(_send_prints(radixes), "radix long, bid long, packed boolean, low binary, count binary")
    judged = prints.repartitionById(radixes, F.col("radix").cast("int")).sortWithinPartitions("radix").mapInArrow(_judge_prints(hot), "bid long, radix long, packed boolean, verdict binary")
    verdicts = judged.groupBy("bid").agg(F.collect_list(F.struct("radix", "packed", "verdict")).alias("verdicts")).withColumnRenamed("bid", "b")
    # a block's verdicts and removals are bounded by the block
    told = blocks.join(verdicts, F.col("bid") == F.col("b")).select("bid", "keys", "off", "data", "verdicts")
    runs = told.mapInArrow(_runs(radixes, parts), "part long, bid long, packed boolean, lcp binary, tails binary, keys binary, firsts binary")
    return saved(runs.repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("part").mapInArrow(_merge, "bid long, packed boolean, a binary, b binary"), "removals")


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", texts: bool = False, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """One row per row of df: key, n_bytes, n_removed, n_spans, kept_sha256 (or, with texts, the kept bytes themselves as kept).

    Removed is each byte that a string of 50 bytes covers which also starts in a row with a smaller key. Strings are judged on the input.
    The key is a whole number under 2 ** 63 - 1; a null key counts as larger than all others. Rows with the same key don't remove from each other.
    Null texts are empty: 0 bytes. Texts under 50 bytes lose nothing. Only key and text are read, whatever other columns are called.
    An empty table gives an empty result. Blocks hold about `block` bytes of text; a longer text is a block of its own. What is exchanged: hashes of anchors, suffixes of anchors found twice, and each block of text twice.
    """
    docs = df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    blocks = saved(docs.mapInArrow(_blocks(block), "bid long, size long, keys binary, off binary, data binary"), "blocks")
    total = blocks.agg(F.sum("size")).first()[0] or 0
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    gone = _removals(blocks, max(width, total >> 24), max(width, total >> 23), hot)  # about a million hashes a radix, 200,000 suffixes a part
    gone = gone.groupBy("bid").agg(F.collect_list(F.struct("packed", "a", "b")).alias("gone")).withColumnRenamed("bid", "g")
    last = blocks.join(gone, F.col("bid") == F.col("g"), "left").select("bid", "keys", "off", "data", "gone")
    out = last.mapInArrow(_kept(texts), f"key long, n_bytes long, n_removed long, n_spans long, {'kept binary' if texts else 'kept_sha256 string'}")
    return out.withColumnRenamed("key", key)
