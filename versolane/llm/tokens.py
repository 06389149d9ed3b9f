"""Token ids of many texts by a public tokenizer file, each distinct piece of text encoded once in a worker.

The tokenizer is opened by its path on the executor. What it does to a word doesn't depend on the words around it, as it
splits at white space and drops it; so texts are cut into units, and units that a worker has seen come from its table.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard

from .common import BYTES, _powers, mix, offsets

#: Units and ids that a worker keeps: about 20 bytes for a unit and two or four for an id, some 15 MB in all. Beyond either it starts anew.
KEPT, KEPT_IDS = 1 << 19, 1 << 21
#: Units that the tokenizer is given at once: what it returns for one takes some hundred bytes.
GIVEN = 2048


def units(flat: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each unit begins and ends, and its hash.

    A unit is a run of letters (a-z, A-Z, and those of U+00C0 to U+00FF), a run of ASCII punctuation, or one digit: the tokenizer's own
    split falls on all these edges. A word with any other character, an apostrophe or "<" is one unit, hashed with its case.
    """
    n = len(flat)
    first = np.zeros(n + 1, bool)
    first[off[:-1]] = True
    low = flat | 32
    lead = flat == 0xC3
    tail = np.zeros(n, bool)
    tail[1:] = lead[:-1] & (flat[1:] >= 0x80) & (flat[1:] != 0x97) & (flat[1:] != 0xB7)
    both = tail.copy()
    both[:-1] |= tail[1:]
    letter = ((low >= 97) & (low <= 122)) | both
    white = (flat == 32) | ((flat >= 9) & (flat <= 13))
    digit = (flat >= 48) & (flat <= 57)
    kind = np.where(letter, 1, np.where(white, 0, np.where(digit, 2, 3))).astype(np.uint8)
    odd = ((flat >= 0x80) & ~letter) | (flat == 39) | (flat == 60)
    case = (flat >= 65) & (flat <= 90)
    if odd.any():
        start = ~white
        start[1:] &= white[:-1] | first[1:n]
        word = np.cumsum(start)
        bad = np.zeros(int(word[-1]) + 1, bool)
        bad[word[odd]] = True
        whole = bad[word] & ~white
        kind[whole] = 4
        case &= ~whole
    begin = kind != 0
    begin[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 2) | first[1:n]
    end = kind != 0
    end[:-1] &= (kind[1:] != kind[:-1]) | (kind[1:] == 2) | first[1:n]
    a, b = np.flatnonzero(begin), np.flatnonzero(end) + 1
    power, back = _powers(1 << max(18, (n + 1).bit_length()))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTES[flat + (case.astype(np.uint8) << 5)] * power[:n], out=total[1:])
    return a, b, mix((total[b] - total[a]) * back[a] + (b - a).astype(np.uint64))


class Encoder:
    """The ids that tokenizers' encode(text, add_special_tokens=False) gives, for word_bpe_49k.json and files that split alike."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, np.uint64)  # hashes of units, ascending
        self.at, self.size = np.zeros(0, np.int32), np.zeros(0, np.int32)  # where each one's ids start, and how many they are
        self.ids = np.zeros(0, self.kind)

    def add(self, hashes: np.ndarray, texts: list[str]) -> None:
        """Learns units that aren't known yet; hashes ascend."""
        # a run of ASCII letters is lower-cased and nothing else before the model has it
        plain = [x.isascii() and x.isalpha() for x in texts]
        ids = [[y.id for y in self.model.tokenize(x.lower())] if p else None for x, p in zip(texts, plain)]
        rest = [i for i, p in enumerate(plain) if not p]
        for k in range(0, len(rest), GIVEN):
            for i, e in zip(rest[k : k + GIVEN], self.tokenizer.encode_batch_fast([texts[i] for i in rest[k : k + GIVEN]], add_special_tokens=False), strict=True):
                ids[i] = e.ids
        own = np.fromiter(map(len, ids), np.int32, len(ids))
        at = len(self.ids) + np.cumsum(own, dtype=np.int32) - own
        place = np.searchsorted(self.known, hashes)
        self.known, self.at, self.size = (np.insert(x, place, y) for x, y in ((self.known, hashes), (self.at, at), (self.size, own)))
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(ids), self.kind)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all texts, where each text's start, and the hashes of units with each text's count behind them."""
        flat, off = offsets(texts)
        if len(flat) == 0:
            return np.zeros(0, self.kind), np.zeros(len(off), np.int64), (np.zeros(0, np.uint64), np.zeros(len(off), np.int64))
        a, b, h = units(flat, off)
        if len(self.known) > KEPT or len(self.ids) > KEPT_IDS:
            self.clear()
        u, where, at = np.unique(h, return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, u)
        seen = place < len(self.known)
        seen[seen] = self.known[place[seen]] == u[seen]
        if not seen.all():
            data = flat.tobytes()
            self.add(u[~seen], [data[a[j] : b[j]].decode("utf-8", "replace") for j in where[~seen].tolist()])
            place = np.searchsorted(self.known, u)
        slot = place[at]
        n = self.size[slot].astype(np.int64)
        ends = np.cumsum(n)
        ids = self.ids[np.repeat(self.at[slot] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        edge = np.searchsorted(a, off)
        return ids, np.r_[0, ends][edge], (h, edge)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each path in a Python worker; it stays while the worker does."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def packed(ids: np.ndarray, squeeze: zstandard.ZstdCompressor) -> bytes:
    return squeeze.compress(ids.tobytes())


def unpacked(data: bytes, kind: type, loose: zstandard.ZstdDecompressor) -> np.ndarray:
    return np.frombuffer(loose.decompress(data), kind)
