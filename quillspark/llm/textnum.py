"""Words and shingles of whole Arrow text columns as numpy hashes, without a Python object per word.

A word's hash is a polynomial over its bytes (letters A-Z count as a-z) in 64-bit arithmetic, taken from
running sums over a chunk of texts, then mixed. Two different words share a hash with a chance near 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text taken at once: eight bytes a character stay in a core's cache.
CHUNK_BYTES = 1 << 18
_rng = np.random.Generator(np.random.PCG64(20240229))
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[65:91] = _VALUE[97:123]
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The six separators of a word: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: For bags of words: all ASCII but letters and digits separates.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = np.full(max(n, CHUNK_BYTES), base, np.uint64)
            have[0] = 1
            have = np.cumprod(have, dtype=np.uint64)
        if n <= 4 * CHUNK_BYTES:
            _powers[name] = have
    return have[:n]


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `limit` bytes each; a longer text is a chunk of its own."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    at, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > at and total + size > limit:
            yield at, i
            at, total = i, 0
        total += size
    if at < len(sizes):
        yield at, len(sizes)


class WordTable:
    """Word hashes in an open-addressed numpy table: whole arrays are looked up and added at once."""

    def __init__(self, bits: int):
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key = np.zeros(1 << bits, np.uint64)  # 0 is free
        self.count = 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 for those not held."""
        place = (h >> self.shift).astype(np.int64)
        held = self.key[place]
        open_ = np.flatnonzero((held != h) & (held != 0))
        out = np.where(held == h, place, -1)
        at = place[open_]
        while len(open_):
            at = (at + 1) & self.mask
            held = self.key[at]
            hit = held == h[open_]
            out[open_[hit]] = at[hit]
            on = ~hit & (held != 0)
            open_, at = open_[on], at[on]
        return out

    def add(self, h: np.ndarray) -> np.ndarray:
        """Places for distinct hashes that aren't held."""
        place = (h >> self.shift).astype(np.int64)
        open_ = np.arange(len(h))
        while len(open_):
            at = place[open_]
            free = self.key[at] == 0
            self.key[at[free]] = h[open_[free]]  # of several at one place, one stays
            lost = open_[self.key[at] != h[open_]]
            place[lost] = (place[lost] + 1) & self.mask
            open_ = lost
        self.count += len(h)
        return place


@dataclass
class Words:
    """Of a chunk: for each word its text (row in the chunk), hash, and byte range; `data` holds the bytes."""

    n_texts: int
    text: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray
    sums: np.ndarray

    def prefixes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of the first `size` bytes of each longer word."""
        w = np.flatnonzero(self.end - self.start > size)
        start = self.start[w]
        with np.errstate(over="ignore"):
            return self.text[w], mix((self.sums[start + size] - self.sums[start]) * _power("down", _R_INVERSE, len(self.data))[start], size)

    def counts(self) -> np.ndarray:
        return np.bincount(self.text, minlength=self.n_texts)

    def strings(self, rows: np.ndarray, lower: bool = False) -> pa.Array:
        """The bytes of the words in `rows`, A-Z lower-cased if asked, as large_binary."""
        size = self.end[rows] - self.start[rows]
        ends = np.cumsum(size)
        raw = self.data[np.arange(int(size.sum())) + np.repeat(self.start[rows] - (ends - size), size)]
        return pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(np.append(0, ends)), pa.py_buffer(_LOWER[raw] if lower else raw)])


def words(texts: pa.Array, separators: np.ndarray = SPACES) -> Words:
    """Words of each text; null counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1 + texts.offset)[texts.offset :]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    none = np.zeros(0, np.int64)
    if not len(data):
        return Words(n, none, none.astype(np.uint64), none, none, data, none.astype(np.uint64))
    inside = ~separators[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | first[1:])) + 1
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUE[data] * _power("up", _R, len(data)), out=sums[1:])
        hashed = mix((sums[end] - sums[start]) * _power("down", _R_INVERSE, len(data))[start])
    text = np.searchsorted(offsets, start, "right") - 1
    return Words(n, text, hashed, start, end, data, sums)


def shingles(w: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of each text, sorted by text and hash. A text of fewer words than
    `size`, but at least one, has its whole sequence as its only shingle; a text without words has none."""
    counts = w.counts()
    first = np.concatenate(([0], np.cumsum(counts)))
    with np.errstate(over="ignore"):
        full = np.zeros(max(0, len(w.hash) - size + 1), np.uint64)
        for j in range(size):
            full += w.hash[j : j + len(full)] * _PLACE[j]
        whole = w.text[: len(full)] == w.text[size - 1 :] if len(full) else np.zeros(0, bool)
        text, value = w.text[: len(full)][whole], mix(full[whole], 5)
        short = np.flatnonzero((counts > 0) & (counts < size))
        if len(short):
            some = np.zeros(len(short), np.uint64)
            for j in range(size - 1):
                has = counts[short] > j
                some[has] += w.hash[first[short[has]] + j] * _PLACE[j]
            text = np.concatenate((text, short))
            value = np.concatenate((value, mix(some, 11) + counts[short].astype(np.uint64)))
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    return text[new], value[new]
