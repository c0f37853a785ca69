"""Periodic runs of words in documents, by masking with repeated k-grams and Main-Lorentz on what is left.

A run of length L and period q has words equal q apart, and L >= max(m, 2q) for the least length m. Its first L - q words
return q words later, and L - q >= max(m - q, q) >= m / 2. So every word of a run lies in a k-gram, k = ceil(m / 2), that
occurs twice in the document; all other words are masked, and a run lies within one of the segments between them.

In the segments runs are found as Main and Lorentz do: a segment is halved again and again, and a run is found where it
crosses the middle of a part and lies within it. A run over a middle M covers the q words before M or the q words from M
on, so for each q two extensions, forwards and backwards, tell it. All parts of a level of all segments of a batch are
done together in numpy. Extensions go by names of stretches of 1, 2, 4, ... words, equal names standing for equal
stretches, so nothing rests on hashes. The work is n log(n) for the middles and log(n) for each that may hold a run.

Every document is a task's own matter, so nothing is shuffled; a lost executor costs its own tasks again.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import give_back


def pair_names(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Names 0, 1, ... of pairs of names: equal ones for equal pairs."""
    width = int(right.max()) + 1
    return np.unique(left.astype(np.int64) * width + right, return_inverse=True)[1]


def gram_names(ids: np.ndarray, k: int) -> np.ndarray:
    """Names of the k-grams that begin at places 0..n-k."""
    have, names = 1, ids
    while have < k:
        step = min(have, k - have)  # two overlapping or adjoining stretches make up the longer one
        names, have = pair_names(names[:-step], names[step:]), have + step
    return names


def covered(ids: np.ndarray, owner: np.ndarray, k: int) -> np.ndarray:
    """Which words lie in a k-gram that occurs twice or more in their document. owner: non-decreasing document numbers."""
    n = len(ids)
    out = np.zeros(n, bool)
    if n < k + 1:
        return out
    names = gram_names(ids, k)
    inside = owner[: n - k + 1] == owner[k - 1 :]
    at = np.flatnonzero(inside)
    if not len(at):
        return out
    key = pair_names(owner[at], names[at])
    twice = np.bincount(key)[key] > 1
    edge = np.zeros(n + 1, np.int64)
    edge[at[twice]] += 1
    np.subtract.at(edge, at[twice] + k, 1)
    return np.cumsum(edge[:n]) > 0


class Extensions:
    """How far two places of a sequence go on alike, forwards and backwards. The last element must be unlike all others."""

    def __init__(self, ids: np.ndarray, longest: int) -> None:
        self.names, n = [ids], len(ids)
        while (1 << len(self.names)) <= longest:
            step = 1 << (len(self.names) - 1)
            name = self.names[-1]
            name = pair_names(name, name[np.minimum(np.arange(n) + step, n - 1)])
            if name.max() == n - 1:  # no longer stretch occurs twice
                break
            self.names.append(name.astype(np.int32))

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The length of the longest stretch from each a that is also the one from b."""
        got, end = np.zeros(len(a), np.int64), len(self.names[0]) - 1
        for level in range(len(self.names) - 1, -1, -1):
            name = self.names[level]
            go = True
            while go:  # more than once on the highest level only, where that is less than the longest stretch
                same = (name[np.minimum(a + got, end)] == name[np.minimum(b + got, end)]) & (np.maximum(a, b) + got < end)
                got += same * (1 << level)
                go = level == len(self.names) - 1 and bool(same.any())
        return got

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The length of the longest stretch up to before each a that is also the one up to before b."""
        got = np.zeros(len(a), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            name, step = self.names[level], 1 << level
            go = True
            while go:
                left, right = a - got - step, b - got - step
                same = (np.minimum(left, right) >= 0) & (name[np.maximum(left, 0)] == name[np.maximum(right, 0)])
                got += same * step
                go = level == len(self.names) - 1 and bool(same.any())
        return got


def middles(starts: np.ndarray, ends: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(middle, periods to try on each side) of the parts of these segments, level by level; no part is shorter than a run."""
    while len(starts):
        big = ends - starts >= least
        starts, ends = starts[big], ends[big]
        mid = (starts + ends) // 2
        yield mid, np.maximum(mid - starts, ends - mid)
        starts, ends = np.concatenate((starts, mid)), np.concatenate((mid, ends))


def segment_runs(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int, size: int = 1 << 20) -> np.ndarray:
    """Runs (start, end, period) within segments of a sequence, whose end elements are unlike all others, sorted.

    The period is the smallest of the run, and no run can be extended. `size` bounds the pairs looked at together.
    """
    reach = Extensions(ids, int((ends - starts).max(initial=1)))
    found = [np.zeros((0, 3), np.int64)]
    half = (least - least // 2 + 1) // 2  # an extension of a run's at least ceil(least / 2) words that is surely this long
    probe = gram_names(ids, half) if len(ids) > half else np.zeros(0, np.int64)

    def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok = (a >= 0) & (b >= 0) & (a < len(probe)) & (b < len(probe))
        return ok & (probe[np.where(ok, a, 0)] == probe[np.where(ok, b, 0)])

    for mid, most in middles(starts, ends, least):
        for lo, hi in cuts(most, size):
            m = np.repeat(mid[lo:hi], most[lo:hi])
            q = np.arange(len(m)) - np.repeat(np.cumsum(most[lo:hi]) - most[lo:hi], most[lo:hi]) + 1
            for a, b in ((m - q, m), (m, m + q)):  # the run covers a..b, so it goes from before a to after b
                # of the max(q, least - q) or more words that are equal q apart, some lie before a and the others from a on
                at = np.flatnonzero((a >= 0) & (b < len(ids)))
                at = at[alike(a[at], b[at]) | alike(a[at] - half, b[at] - half)]
                x, y = a[at], b[at]
                before, after = reach.backward(x, y), reach.forward(x, y)
                run = before + after >= np.maximum(q[at], least - q[at])
                x, y, before, after = x[run], y[run], before[run], after[run]
                found.append(least_periods(np.stack((x - before, y + after, y - x), axis=1)))
    return least_periods(np.concatenate(found))


def least_periods(runs: np.ndarray) -> np.ndarray:
    """Of runs (start, end, period) over the same stretch, which have periods that are multiples of its own, the least."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    return runs[first]


def cuts(sizes: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Cut rows into runs of rows whose sizes add up to about `size`; a larger row makes a run of its own."""
    edges, lo = np.concatenate(([0], np.cumsum(sizes))), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + size, "right")) - 1)
        yield lo, hi
        lo = hi


def runs_of(ids: np.ndarray, bounds: np.ndarray, least: int = 12) -> list[np.ndarray]:
    """The runs (start, length, period) of each document, by start and period. bounds: where the documents' words begin."""
    n, count = len(ids), len(bounds) - 1
    none = np.zeros((0, 3), np.int64)
    out = [none] * count
    if n < least:
        return out
    owner = np.repeat(np.arange(count), np.diff(bounds))
    on = covered(ids, owner, least - least // 2)
    joined = on[1:] & on[:-1] & (owner[1:] == owner[:-1])
    starts = np.flatnonzero(on & ~np.concatenate(([False], joined)))
    ends = np.flatnonzero(on & ~np.concatenate((joined, [False]))) + 1
    long = ends - starts >= least
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return out
    # the segments end to end, each closed by an element that occurs nowhere else
    sizes = ends - starts
    put = np.cumsum(sizes + 1) - sizes - 1
    place = np.arange(int((sizes + 1).sum()))
    of = np.repeat(np.arange(len(sizes)), sizes + 1)
    inner = place - put[of] < sizes[of]
    text = np.where(inner, ids[np.minimum(starts[of] + place - put[of], n - 1)], int(ids.max()) + 1 + of)
    runs = segment_runs(np.unique(text, return_inverse=True)[1].astype(np.int32), put, put + sizes, least)
    segment = np.searchsorted(put, runs[:, 0], "right") - 1
    start = runs[:, 0] - put[segment] + starts[segment]
    rows = np.stack((start, runs[:, 1] - runs[:, 0], runs[:, 2]), axis=1)
    doc = owner[start]
    rows[:, 0] -= bounds[doc]
    order = np.lexsort((rows[:, 2], rows[:, 0], doc))
    rows, doc = rows[order], doc[order]
    for i, lo, hi in zip(*(x.tolist() for x in (np.unique(doc), *at_edges(doc)))):
        out[i] = rows[lo:hi]
    return out


def at_edges(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the stretches of equal keys begin and end."""
    new = np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))
    return new, np.concatenate((new[1:], [len(sorted_keys)]))


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which words stay when of every run only its first period does."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.subtract.at(edge, runs[:, 0] + runs[:, 1], 1)
    return np.cumsum(edge[:n]) == 0


FOUND = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("collapsed", T.StringType()),
    T.StructField("runs", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))),
])


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 12, origin: Column | None = None, period: Column | None = None) -> DataFrame:
    """(key, n_words, runs, collapsed) of every row, with every maximal run of at least `least` words and two periods.

    Words are `[^\\x20\\x09-\\x0D]+`, numbered from 0. `runs` is an array of (start, length, smallest period) by start, then
    period; `collapsed` is the text's words, joined by one blank, without those that a run holds after its first period.
    `origin` and `period` (columns of docs' key) replace each word i >= a = origin % n by the word a + (i - a) % p with
    p = 1 + floor((n - a) / period) first, which plants a run; where origin is null a text is taken as it is.

    Null and empty texts and such without words have no runs and an empty `collapsed`. Rows with a null or repeated key are
    rows like any other, no rows give no rows, further columns of any name are left out. A text is held by one task.
    """
    kind = docs.schema[key].dataType
    none = F.lit(None).cast("long")
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), (none if origin is None else origin).alias("origin"), (none if period is None else period).alias("period"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                yield from found(part, least)
        give_back()

    out = rows.mapInArrow(run, T.StructType([T.StructField("key", kind), *FOUND]))
    return out.select(F.col("key").alias(key), *FOUND.names)


def parts(batch: pa.RecordBatch, size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about `size` bytes of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    for lo, hi in cuts(sizes.astype(np.int64), size):
        yield batch.slice(lo, hi - lo)


def found(batch: pa.RecordBatch, least: int) -> Iterator[pa.RecordBatch]:
    words = [(x or "").encode().split() for x in batch.column(1).to_pylist()]
    for i, (origin, period) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
        n = len(words[i])
        if origin is not None and n:
            a = origin % n
            p = 1 + (n - a) // period
            words[i] = words[i][:a] + (words[i][a : a + p] * (1 + (n - a) // p))[: n - a]
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    bounds = np.concatenate(([0], np.cumsum([len(w) for w in words])))
    ids = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), np.int32, int(bounds[-1]))
    runs = runs_of(ids, bounds, least)
    collapsed = []
    for w, r in zip(words, runs):
        if len(r):
            w = [w[i] for i in np.flatnonzero(kept_words(len(w), r)).tolist()]
        collapsed.append(b" ".join(w).decode())
    flat = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(r) for r in runs]))), pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"]))
    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds), pa.int64()), pa.array(collapsed, pa.string()), lists], ["key", *FOUND.names])
