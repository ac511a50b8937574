"""Elias-Fano coded sequences and tries of them, as flat files that are mapped and searched in place.

All searches take arrays of queries. A sequence of n values up to u takes about 2 + log2(u / n) bits a value: the
low bits stand packed, the high bits are a bit vector with a one per value and a zero per step. Selecting the i-th one gives a value, selecting
zeros gives the bucket of a value, in which its low bits are searched.
"""

from __future__ import annotations

import uuid
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs

U = np.uint64
#: Queries that one step answers.
STEP = 1 << 16
#: Files that a task holds whole where they can't be mapped.
FETCHED = 4
_ONES, _TOPS = U(0x0101010101010101), U(0x8080808080808080)
#: Place of the i-th one of a byte, by i * 256 + byte.
_IN_BYTE = np.array([next((p for p in range(8) if b >> p & 1 and (b & (1 << p) - 1).bit_count() == i), 8) for i in range(8) for b in range(256)], np.int64)


def _ones_upto(x: np.ndarray) -> np.ndarray:
    """In each byte of a word, the ones of it and all lower bytes."""
    x = x - (x >> U(1) & U(0x5555555555555555))
    x = (x & U(0x3333333333333333)) + (x >> U(2) & U(0x3333333333333333))
    return (x + (x >> U(4)) & U(0x0F0F0F0F0F0F0F0F)) * _ONES


def _in_word(x: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the one of a word that has so many ones below it."""
    upto, r = _ones_upto(x), rank.astype(U)
    byte = np.bitwise_count(((r * _ONES) | _TOPS) - upto & _TOPS).astype(U) << U(3)
    r -= upto << U(8) >> byte & U(255)
    return byte.view(np.int64) + _IN_BYTE[((r << U(8)) | (x >> byte & U(255))).view(np.int64)]


class Monotone:
    """A non-decreasing sequence of integers from 0 to 2^63 - 1."""

    @staticmethod
    def encode(values: np.ndarray) -> np.ndarray:
        values = np.asarray(values, np.int64)
        n, last = len(values), int(values[-1]) if len(values) else 0
        width = max(0, (last // n).bit_length() - 1) if n else 0
        lows = np.zeros(n * width // 64 + 2, U)
        bits = np.zeros(-(-(n + (last >> width) + 1) // 64) * 64, bool)
        for s in range(0, n, STEP):     # the low bits of a step fill whole words
            part = values[s:s + STEP]
            i = np.arange(s, s + len(part))
            bits[(part >> width) + i] = True
            if width:
                at = i * width
                word, shift, low = at >> 6, (at & 63).astype(U), (part & ((1 << width) - 1)).astype(U)
                first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
                lows[word[first]] |= np.bitwise_or.reduceat(low << shift, first)
                over = (at & 63) + width > 64
                lows[word[over] + 1] |= low[over] >> (U(64) - shift[over])
        high = np.packbits(bits, bitorder="little").view(U)
        ones = np.r_[0, np.cumsum(np.bitwise_count(high), dtype=np.int64)[:-1], np.zeros(len(high) % 2, np.int64)]
        # Ones before each word, in 32 bits where that is enough.
        ones = ones.astype(np.uint32).view(U) if n < 1 << 32 else ones[:len(high)].astype(U)
        return np.concatenate([np.array([n, width, last, len(lows), len(high)], U), lows, high, ones])

    def __init__(self, words: np.ndarray):
        self.n, self.width, self.last, n_low, n_high = (int(x) for x in words[:5])
        self.lows = words[5:5 + n_low]
        self.high = words[5 + n_low:5 + n_low + n_high]
        ones = words[5 + n_low + n_high:]
        self.ones = ones.view(np.uint32)[:n_high] if self.n < 1 << 32 else ones.view(np.int64)

    @cached_property
    def zeros(self) -> np.ndarray:
        return (np.arange(len(self.ones)) * 64 - self.ones).astype(self.ones.dtype)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.int64)
        at = i * self.width
        word, shift = at >> 6, (at & 63).astype(U)
        # A shift by 64 is none in hardware: the upper part goes in two steps.
        x = (self.lows[word] >> shift) | (self.lows[word + 1] << U(1) << (U(63) - shift))
        return (x & U((1 << self.width) - 1)).view(np.int64)

    def _select(self, rank: np.ndarray, flip: bool) -> np.ndarray:
        """Bit position of the one (with ``flip``: the zero) with so many before it."""
        ahead = self.zeros if flip else self.ones
        word = np.searchsorted(ahead, rank.astype(ahead.dtype), "right") - 1
        x = ~self.high[word] if flip else self.high[word]
        return word * 64 + _in_word(x, rank - ahead[word])

    def _next(self, at: np.ndarray, rank: np.ndarray, flip: bool) -> np.ndarray:
        """Bit position of the next one (zero) after the one at ``at``, which has ``rank`` before it."""
        word = at >> 6
        x = (~self.high[word] if flip else self.high[word]) >> (at & 63).astype(U) >> U(1)
        out = at + 1 + np.bitwise_count((x & (~x + U(1))) - U(1))
        far = np.flatnonzero(x == 0)
        if len(far):
            out[far] = self._select(rank[far] + 1, flip)
        return out

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at the positions ``i``."""
        out = np.empty(len(i), np.int64)
        for s in range(0, len(i), STEP):
            p = i[s:s + STEP]
            out[s:s + STEP] = (self._select(p, False) - p << self.width) | self._low(p)
        return out

    def spans(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at ``i`` and at the next position."""
        one, two = np.empty(len(i), np.int64), np.empty(len(i), np.int64)
        for s in range(0, len(i), STEP):
            p = i[s:s + STEP]
            at = self._select(p, False)
            one[s:s + STEP] = (at - p << self.width) | self._low(p)
            two[s:s + STEP] = (self._next(at, p, False) - p - 1 << self.width) | self._low(p + 1)
        return one, two

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position of the first value >= x, whether it equals x)."""
        at, hit = np.full(len(x), self.n, np.int64), np.zeros(len(x), bool)
        for s in range(0, len(x), STEP):
            inside = np.flatnonzero(x[s:s + STEP] <= self.last) + s if self.n else []
            if len(inside):
                at[inside], hit[inside] = self._find(x[inside])
        return at, hit

    def _find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        top, low = x >> self.width, x & ((1 << self.width) - 1)
        lo = np.zeros(len(x), np.int64)
        some, end = np.flatnonzero(top), np.empty(len(x), np.int64)
        before = top[some] - 1
        at = self._select(before, True)
        lo[some], end[some] = at - before, self._next(at, before, True) - before - 1
        if len(some) < len(x):
            none = np.flatnonzero(top == 0)
            end[none] = self._select(top[none], True)
        # Most buckets hold one value or two: the first is looked at, the others are searched.
        hit, open_ = np.zeros(len(x), bool), np.flatnonzero(lo < end)
        first, asked = self._low(lo[open_]), low[open_]
        hit[open_] = first == asked
        open_ = open_[first < asked]
        lo[open_] += 1
        open_ = rest = open_[lo[open_] < end[open_]]
        hi = end.copy()
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < low[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        rest = rest[lo[rest] < end[rest]]
        hit[rest] = self._low(lo[rest]) == low[rest]
        return lo, hit


class Children:
    """A level of a trie: pointers to the first child of each parent, and the children's numbers, ascending by parent. A
    child is stored relative to its context: on top of the last value of the parent before, so that the level is one
    monotone sequence."""

    @staticmethod
    def encode(counts: np.ndarray, children: np.ndarray) -> list[np.ndarray]:
        ends = np.cumsum(counts)
        some = counts > 0
        spans = np.zeros(len(counts), np.int64)
        spans[some] = children[ends[some] - 1] + 1
        bases = np.cumsum(spans) - spans
        values = np.repeat(bases, counts)
        values += children
        return [Monotone.encode(np.r_[0, ends]), Monotone.encode(values)]

    def __init__(self, pointers: np.ndarray, values: np.ndarray):
        self.pointers, self.values = Monotone(pointers), Monotone(values)

    def size(self, parents: np.ndarray) -> np.ndarray:
        first, end = self.pointers.spans(parents)
        return end - first

    def find(self, parents: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, found) of a child under a parent: a successor search from where its context begins. Equal
        parents that stand together are looked up once."""
        if not len(parents):
            return np.zeros(0, np.int64), np.zeros(0, bool)
        new = np.flatnonzero(np.r_[True, parents[1:] != parents[:-1]])
        own = parents[new]
        first, end = self.pointers.spans(own)
        base, later = np.zeros(len(own), np.int64), np.flatnonzero(first)
        base[later] = self.values.access(first[later] - 1) + 1
        times = np.diff(np.r_[new, len(parents)])
        at, hit = self.values.find(np.repeat(base, times) + children)
        return at, hit & (at < np.repeat(end, times))


def write_file(folder: str, name: str, parts: list[np.ndarray]) -> None:
    """Write arrays as one file in a folder that all executors share. The file appears whole or not at all, and
    a task that runs again writes the same."""
    fs, root = pa.fs.FileSystem.from_uri(folder)
    sizes = np.array([len(parts), *[p.nbytes for p in parts]], U)
    draft = f"{root}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(draft) as out:
        for part in (sizes, *parts):
            out.write(part.tobytes())
            out.write(bytes(-part.nbytes % 8))
    fs.move(draft, f"{root}/{name}")


def make_folder(folder: str) -> None:
    fs, root = pa.fs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)


@lru_cache(256)
def _mapped(path: str) -> tuple[np.ndarray, ...]:
    return _arrays(pa.memory_map(path).read_buffer())


@lru_cache(FETCHED)
def _fetched(folder: str, name: str) -> tuple[np.ndarray, ...]:
    fs, root = pa.fs.FileSystem.from_uri(folder)
    with fs.open_input_file(f"{root}/{name}") as f:
        return _arrays(f.read_buffer())


def read_file(folder: str, name: str) -> tuple[np.ndarray, ...]:
    """The arrays of a file, mapped into memory where the shared folder is mounted. Where it is not, the file is read, and a
    task holds the last few."""
    fs, root = pa.fs.FileSystem.from_uri(folder)
    return _mapped(f"{root}/{name}") if isinstance(fs, pa.fs.LocalFileSystem) else _fetched(folder, name)


def _arrays(data: pa.Buffer) -> tuple[np.ndarray, ...]:
    raw = np.frombuffer(data, np.uint8)
    n = int(raw[:8].view(U)[0])
    at, out = 8 * (n + 1), []
    for size in raw[8:8 * (n + 1)].view(U).tolist():
        out.append(raw[at:at + size])
        at += -(-size // 8) * 8
    return tuple(out)
