"""Vectorised byte kernels shared by the Arrow-based operators.

Everything here works on one Arrow batch at a time with numpy: texts stay UTF-8 bytes in one buffer, and words, word
hashes and shingles are arrays of positions and 64-bit integers. No Python object is made for each word.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The separators of words: blank, tab, newline, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_rng = np.random.default_rng(20_240_229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)
_MIX = [U64(x) for x in (_rng.integers(1, 2**62, 64, dtype=np.int64) * 2 + 1).tolist()]
_powers: list[np.ndarray] = []


def give_back() -> None:
    """Return freed memory to the system: a worker process waits for the next stage beside the executor's JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only where the C library has it
    if trim:
        trim(0)


def fmix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), so that equal inputs are the only cause of equal outputs."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash base and its inverse modulo 2**64, raised to 0..n-1."""
    if not _powers or len(_powers[0]) < n:
        m = max(n, 1 << 20)
        both = []
        for base in (_BASE, _BASE_INV):
            p = np.full(m, U64(base))
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers[:] = both
    return _powers[0][:n], _powers[1][:n]


def text_slices(column: pa.Array | pa.ChunkedArray, limit: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of about `limit` bytes: (first row, end row, bytes, bounds).

    A null text counts as empty. A single text longer than the limit makes a run of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=n + 1, offset=8 * column.offset)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Hashes of the lower-cased words of a run of texts, and where each text's words begin.

    Returns (hashes, word bounds by text, (starts, ends) in bytes). A word is a maximal run of bytes that are no separators.
    """
    n = len(buf)
    if not n:
        return np.zeros(0, U64), np.zeros(len(bounds), np.int64), (np.zeros(0, np.int64), np.zeros(0, np.int64))
    low = LOWER[buf]
    word = ~SPACE[buf]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:n]))
    after = np.zeros(n, bool)
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    up, down = powers(n)
    total = np.empty(n + 1, U64)
    total[0] = 0
    np.cumsum(_BYTE[low] * up, out=total[1:])
    h = fmix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))
    return h, np.searchsorted(starts, bounds).astype(np.int64), (starts, ends)


def shingle_sets(hashes: np.ndarray, word_bounds: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct n-word shingle hashes of each text; with fewer words the whole sequence is one shingle."""
    total = len(hashes)
    if total >= n:
        acc = np.full(total - n + 1, _MIX[0], U64)
        for k in range(n):
            acc += hashes[k : total - n + 1 + k] * _MIX[k + 1]
        grams = fmix(acc)
    else:
        grams = np.zeros(0, U64)
    out = []
    for a, b in zip(word_bounds[:-1].tolist(), word_bounds[1:].tolist()):
        if b - a >= n:
            s = np.sort(grams[a : b - n + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            acc = U64(b - a)
            with np.errstate(over="ignore"):
                for k in range(b - a):
                    acc = acc + hashes[a + k] * _MIX[k + 32]
            out.append(fmix(np.array([acc], U64)))
        else:
            out.append(np.zeros(0, U64))
    return out


def digest(values: np.ndarray) -> int:
    """A signed 64-bit digest of an array's bytes."""
    return int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8).digest(), "little", signed=True)


def distinct_counts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each occurs."""
    if not len(values):
        return values, np.zeros(0, np.int64)
    s = np.sort(values)
    at = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    return s[at], np.diff(np.concatenate((at, [len(s)])))


class Counter:
    """Counts of 64-bit keys that come in many runs; pending runs merge once they outweigh what has been merged."""

    def __init__(self) -> None:
        self.keys, self.counts = np.zeros(0, U64), np.zeros(0, np.int64)
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        if counts is None:
            keys, counts = distinct_counts(keys)
        self.runs.append((keys, counts))
        self.waiting += len(keys)
        if self.waiting > max(1 << 20, len(self.keys)):
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if self.runs:
            keys = np.concatenate([self.keys, *(k for k, _ in self.runs)])
            counts = np.concatenate([self.counts, *(c for _, c in self.runs)])
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
            self.keys, self.counts = keys[at], np.add.reduceat(counts, at) if len(at) else counts
            self.runs, self.waiting = [], 0
        return self.keys, self.counts


class Table:
    """An open-addressing hash table over distinct 64-bit keys: find() gives each query's index, or -1."""

    EMPTY = U64(0xFFFFFFFFFFFFFFFF)

    def __init__(self, keys: np.ndarray | None = None) -> None:
        self.keys = np.zeros(0, U64)
        self.bits = 0
        self.add(np.zeros(0, U64) if keys is None else np.asarray(keys, U64))

    def add(self, keys: np.ndarray) -> None:
        """Put in further distinct keys, which get the next indices."""
        first, self.keys = len(self.keys), np.concatenate((self.keys, keys))
        bits = max(4, int(np.ceil(np.log2(max(1, len(self.keys)) * 1.6))))
        if bits > self.bits:
            self.bits, first = bits, 0
            self.slots = np.full(1 << bits, self.EMPTY, U64)
            self.index = np.full(1 << bits, -1, np.int32)
        left = np.arange(first, len(self.keys), dtype=np.int32)
        at = self._home(self.keys[first:])
        while len(left):
            free = self.index[at] < 0
            self.index[at[free]] = left[free]
            lost = self.index[at] != left
            self.slots[at[~lost]] = self.keys[left[~lost]]
            left, at = left[lost], (at[lost] + 1) & (len(self.slots) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U64(_BASE)) >> U64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        got = self.slots[at]
        out = np.where(got == keys, self.index[at], np.int32(-1))
        left = np.flatnonzero((got != keys) & (got != self.EMPTY))
        at = at[left]
        while len(left):
            at = (at + 1) & (len(self.slots) - 1)
            q, got = keys[left], self.slots[at]
            hit = got == q
            out[left[hit]] = self.index[at[hit]]
            go = ~hit & (got != self.EMPTY)
            left, at = left[go], at[go]
        return out


def signed(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as Spark's signed longs."""
    return values.view(np.int64)


def list_column(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column of numpy arrays without Python objects for the elements."""
    sizes = np.fromiter((len(a) for a in arrays), np.int64, len(arrays))
    offsets = np.zeros(len(arrays) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat).cast(kind))
