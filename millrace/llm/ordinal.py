"""Ordinal quality classifier: a cumulative-link (proportional odds) regression on graded ratings (McCullagh 1980).

One weight vector over hashed text features is shared by all grades; ordered thresholds cut its score into grades, so
P(grade > k) = sigmoid(w x - threshold_k). The expected grade is the sum of these, the tail probability is one of them.

Features of a text are the hashed words that it has (each one over the root of their number), the square roots of the
shares of its hashed byte 3-grams (case kept, so that shouting and symbols show), and the share of words that repeat the
one before. The likelihood with a quadratic penalty is convex, and is fitted by L-BFGS (Liu and Nocedal 1989).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import fresh, release
from .kernel import U64, give_back, text_slices, words


class Dims:
    """Where each kind of feature has its columns: words, byte 3-grams, repeats and the constant."""

    def __init__(self, words: int, bytes_: int) -> None:
        self.words, self.bytes, self.width = words, bytes_, words + bytes_ + 2


def features(buf: np.ndarray, bounds: np.ndarray, dims: Dims) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of the features of a run of texts, by row; an empty text has only the constant."""
    rows = len(bounds) - 1
    parts = [(np.arange(rows), np.full(rows, dims.width - 1), np.ones(rows))]
    h, by, _ = words(buf, bounds)
    n = np.diff(by)
    if len(h):
        doc = np.repeat(np.arange(rows), n)
        key = np.unique(doc * dims.words + ((h >> U64(20)) & U64(dims.words - 1)).astype(np.int64))
        r = key // dims.words
        parts.append((r, key % dims.words, 1 / np.sqrt(np.bincount(r, minlength=rows)[r])))
        again = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        share = np.bincount(doc[1:][again], minlength=rows) / np.maximum(n, 1)
        r = np.flatnonzero(share)
        parts.append((r, np.full(len(r), dims.width - 2), np.sqrt(share[r])))
    if len(buf) > 2:
        size = np.diff(bounds)
        b = buf.astype(np.uint32)
        code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
        at = ((code * np.uint32(2654435761)) >> np.uint32(15)) & np.uint32(dims.bytes - 1)
        doc = np.repeat(np.arange(rows), size)
        inside = doc[:-2] == doc[2:]
        counts = np.bincount(doc[:-2][inside] * dims.bytes + at[inside], minlength=rows * dims.bytes)
        key = np.flatnonzero(counts)
        parts.append((key // dims.bytes, key % dims.bytes + dims.words, np.sqrt(counts[key] / (size[key // dims.bytes] - 2))))
    row, column, value = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(row, kind="stable")
    return row[order], column[order], value[order].astype(np.float32)


class Model:
    """Weights and ordered thresholds: the most likely ones under a quadratic penalty on the weights."""

    def __init__(self, blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]], grade: np.ndarray, grades: int, dims: Dims, least: int = 3, penalty: float = 3e-6, rounds: int = 120, tolerance: float = 1e-5) -> None:
        """blocks of texts: (features of each text, their columns, their values); each text has the constant."""
        width, n = dims.width, len(grade)
        often, total, square = (np.zeros(width) for _ in range(3))
        for _, column, value in blocks:
            often += np.bincount(column, minlength=width)
            total += np.bincount(column, value, width)
            square += np.bincount(column, value.astype(float) ** 2, width)
        # features of fewer than `least` texts tell nothing about others; the constant stays, with weight 0: thresholds do its work
        used = often >= least
        used[-1] = True
        # rare features count for more: each is divided by the root of its deviation, of a word that of whether it occurs
        variance = square / n - (total / n) ** 2
        share = often[: dims.words] / n
        variance[: dims.words] = share * (1 - share)
        scale = 0.1 / np.sqrt(np.maximum(np.sqrt(np.maximum(variance, 0)), 1e-4))
        self.blocks = []
        for sizes, column, value in blocks:
            keep = used[column]
            row = np.repeat(np.arange(len(sizes)), sizes)[keep]
            own = column[keep].astype(np.int32)
            self.blocks.append((np.searchsorted(row, np.arange(len(sizes))), own, (value[keep] * scale[own]).astype(np.float32)))
        self.n, self.grade, self.penalty = n, grade, penalty
        above = np.stack([(grade > k).mean() for k in range(grades - 1)]).clip(0.01, 0.99)
        start = np.sort(-np.log(above / (1 - above)))
        x = self.fitted(np.concatenate((np.zeros(width), start[:1], np.log(np.maximum(np.diff(start), 1e-2)))), width, rounds, tolerance)
        self.w, self.cuts = (x[:width] * scale).astype(np.float32), thresholds(x[width:])
        del self.blocks, self.grade

    def loss(self, x: np.ndarray, width: int) -> tuple[float, np.ndarray]:
        """The mean negative log likelihood with the penalty, and its gradient."""
        w, cuts = x[:width].astype(np.float32), thresholds(x[width:])
        f = np.concatenate([np.add.reduceat(value * w[column], begin, dtype=np.float64) for begin, column, value in self.blocks])
        tail = 1 / (1 + np.exp(-np.clip(f[:, None] - cuts, -30, 30)))
        padded = np.concatenate([np.ones((self.n, 1)), tail, np.zeros((self.n, 1))], axis=1)
        at = np.arange(self.n)
        p = np.maximum(padded[at, self.grade] - padded[at, self.grade + 1], 1e-12)
        slope = padded * (1 - padded)
        up, down = slope[at, self.grade] / p / self.n, slope[at, self.grade + 1] / p / self.n
        g, first = self.penalty * x[:width], 0
        for begin, column, value in self.blocks:
            own = (down - up)[first : first + len(begin)].astype(np.float32)
            g += np.bincount(column, value * np.repeat(own, np.diff(np.append(begin, len(column)))), width)
            first += len(begin)
        g[-1] = 0
        k = len(cuts)
        step = np.bincount(self.grade, up, k + 2)[1 : k + 1] - np.bincount(self.grade + 1, down, k + 2)[1 : k + 1]
        gaps = np.exp(x[width + 1 :])
        inner = np.concatenate(([step.sum()], np.cumsum(step[::-1])[::-1][1:] * gaps))
        return float(-np.log(p).mean() + 0.5 * self.penalty * (x[:width] @ x[:width])), np.concatenate((g, inner))

    def fitted(self, x: np.ndarray, width: int, rounds: int, tolerance: float, memory: int = 8) -> np.ndarray:
        """L-BFGS with steps halved until the loss falls; it ends when the loss falls by less than a share of `tolerance`."""
        value, g = self.loss(x, width)
        steps: list[tuple[np.ndarray, np.ndarray, float]] = []
        for _ in range(rounds):
            q, a = g.copy(), []
            for s, y, rho in reversed(steps):
                a.append(rho * (s @ q))
                q -= a[-1] * y
            if steps:
                s, y, _ = steps[-1]
                q *= (s @ y) / (y @ y)
            for (s, y, rho), alpha in zip(steps, reversed(a)):
                q += (alpha - rho * (y @ q)) * s
            size = 1.0 if steps else 1 / max(1.0, float(np.abs(g).sum()))
            while size > 1e-10:
                new = x - size * q
                now, ng = self.loss(new, width)
                if now <= value - 1e-4 * size * (g @ q):
                    break
                size /= 2
            else:
                break
            s, y = new - x, ng - g
            if s @ y > 1e-12:
                steps = [*steps[1 - memory :], (s, y, 1 / (s @ y))]
            done = value - now < tolerance * abs(value)
            x, value, g = new, now, ng
            if done:
                break
        return x

    def tails(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
        """P(grade > k) for each text and threshold."""
        f = np.bincount(row, value * self.w[column], rows)
        return 1 / (1 + np.exp(-np.clip(f[:, None] - self.cuts, -30, 30)))


def thresholds(x: np.ndarray) -> np.ndarray:
    """Ordered thresholds from the first one and the logarithms of the gaps."""
    return np.cumsum(np.concatenate((x[:1], np.exp(x[1:]))))


def grade_documents(docs: DataFrame, ratings: DataFrame, grades: int, sample: int = 6144, word_dims: int = 1 << 16, byte_dims: int = 2048, key: str = "doc_id", text: str = "text", grade: str = "grade") -> DataFrame:
    """Add expected_grade and tail (the probability of the highest grade) to every row of docs.

    ratings has rows (key, grade) with grades 0..grades-1; nulls and others are left out, and a key rated more than once
    counts with each rating. The model is fitted on at most `sample` ratings, those of smallest hashed key; it reads
    whole texts, and only their features go to the driver. Without ratings all rows get the highest grade. A null text
    is an empty one; an empty table gives no rows. Rows and columns of docs are kept as they are; an added column whose
    name docs has gets underscores behind its name (see `added`).
    """
    spark = docs.sparkSession
    rated = ratings.where(F.col(grade).between(0, grades - 1) & F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(grade).cast("int").alias("_grade"))
    chosen = rated.orderBy(F.xxhash64("_key"), "_key", "_grade").limit(sample)
    known = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), F.col("_id") == F.col("_key")).select("_grade", "_text")

    dims = Dims(word_dims, byte_dims)

    def cuts(column, step: int = 256) -> Iterator[tuple[int, int, tuple[np.ndarray, ...]]]:
        for lo, hi, buf, bounds in text_slices(column, 1 << 20):
            for a in range(0, hi - lo, step):
                cut = bounds[a : min(a + step, hi - lo) + 1]
                yield lo + a, len(cut) - 1, features(buf[cut[0] : cut[-1]], cut - cut[0], dims)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n, (row, column, value) in cuts(batch.column(1)):
                edge = np.searchsorted(row, np.arange(n + 1))
                lists = [pa.array([x[a:z].astype(kind).tobytes() for a, z in zip(edge[:-1], edge[1:])], pa.binary()) for x, kind in ((column, np.uint32), (value, np.float16))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), *lists], ["_grade", "at", "x"])

    # the limit only cuts where docs repeat a rated key
    fit = known.mapInArrow(measure, "_grade int, at binary, x binary").limit(2 * sample).toArrow()
    model = None
    if len(fit):
        blocks = []
        for a in range(0, len(fit), 512):  # so that no copy of all features is made
            columns, values = ([np.frombuffer(b.as_buffer(), kind) for b in fit.column(c).slice(a, 512)] for c, kind in ((1, np.uint32), (2, np.float16)))
            blocks.append((np.array([len(c) for c in columns]), np.concatenate(columns).astype(np.int32), np.concatenate(values).astype(np.float32)))
        grade_of = fit.column(0).to_numpy()
        del fit
        release(spark)  # the driver's Python is at its largest here, so its JVM needn't be
        model = Model(blocks, grade_of, grades, dims)
        del blocks
    shared = spark.sparkContext.broadcast(model)
    names, new = docs.columns, added(docs)
    place = names.index(text)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at, n, x in cuts(batch.column(place)):
                tails = model.tails(*x, n) if model is not None else np.ones((n, grades - 1))
                yield pa.RecordBatch.from_arrays([*(c.slice(at, n) for c in batch.columns), pa.array(tails.sum(1)), pa.array(tails[:, -1])], [*names, *new])
        give_back()

    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, T.DoubleType()) for c in new]])
    return docs.mapInArrow(rate, schema)


def added(docs: DataFrame) -> list[str]:
    """The names of the two columns that `grade_documents` adds to docs: the expected grade and the tail probability."""
    return [fresh(c, docs.columns) for c in ("expected_grade", "tail")]


def accept(tail: str = "tail", least: float = 0.7) -> Column:
    """Whether a row is selected: the probability of the highest grade is at least `least`."""
    return F.col(f"`{tail}`") >= least
