"""Language identification by error-correcting output codes (Dietterich and Bakiri 1995; Escalera et al. 2010).

Every language gets a codeword of bits. One linear classifier for each bit, over hashed byte n-grams, says which side of
the bit a text is on; decoding picks the codeword with the smallest loss, each bit's loss weighted by how well its
classifier does on the training rows. Where the two best codewords lose nearly the same the row is flagged ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernel import LOWER, text_slices

#: A text without a letter has no language.
LETTER = r"\p{L}"


def codewords(n: int, seed: int = 5, most: int = 63) -> np.ndarray:
    """(n, bits) of -1 and 1: all splits into two sides up to seven languages, else the best of random codes."""
    if n <= 2:
        return np.array([[1.0], [-1.0]])[:n]
    if 2 ** (n - 1) - 1 <= most:
        columns = [(1, *c) for c in product((1, -1), repeat=n - 1) if -1 in c]
        return np.array(columns, float).T
    rng, bits, best, found = np.random.default_rng(seed), max(15, int(10 * np.log2(n))), -1, None
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, bits))
        apart = (bits - code @ code.T) / 2 + np.eye(n) * bits
        if apart.min() > best and (np.abs(code.sum(0)) < n).all():
            best, found = apart.min(), code
    return found


def profiles(buf: np.ndarray, bounds: np.ndarray, dims: int) -> np.ndarray:
    """Square roots of the shares of hashed byte 1-, 2- and 3-grams of lower-cased texts, each text of length one."""
    n, rows = len(buf), len(bounds) - 1
    out = np.zeros((rows, dims), np.float32)
    if not n:
        return out
    b = LOWER[buf].astype(np.uint32)
    doc = np.repeat(np.arange(rows), np.diff(bounds))
    code = np.zeros(n, np.uint32)
    for k in range(3):
        code = code[: n - k] * np.uint32(257) + b[k:] if k else b + np.uint32(1)
        if not len(code):
            break
        at = ((code * np.uint32(2654435761) + np.uint32(k * 977)) >> np.uint32(16)) & np.uint32(dims - 1)
        first, last = doc[: n - k], doc[k:]
        inside = first == last
        key = first[inside] * dims + at[inside]
        out += np.bincount(key, minlength=rows * dims).reshape(rows, dims)
    np.sqrt(out, out=out)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


class Model:
    """Codewords, bit classifiers and bit weights, fitted on profiles of labelled texts."""

    def __init__(self, x: np.ndarray, langs: list[str], rounds: int = 150, decay: float = 1e-4) -> None:
        self.langs = sorted(set(langs))
        y = np.array([self.langs.index(v) for v in langs])
        self.code = codewords(len(self.langs))
        side = self.code[y]
        x, side = x.astype(np.float32), side.astype(np.float32)
        self.w, self.b = np.zeros((x.shape[1], side.shape[1]), np.float32), np.zeros(side.shape[1], np.float32)
        share = np.bincount(y)[y].astype(float)
        weight = (1 / share / len(self.langs))[:, None].astype(np.float32)
        m, v = np.zeros_like(self.w), np.zeros_like(self.w)
        for t in range(1, rounds + 1):
            p = -side * weight / (1 + np.exp(np.clip(side * (x @ self.w + self.b), -30, 30), dtype=np.float32))
            g = x.T @ p + decay * self.w
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            self.w -= np.float32(0.3) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            self.b -= 2.0 * p.sum(0)
        right = ((np.sign(x @ self.w + self.b) == side) * weight).sum(0)
        self.weights = np.maximum(right - 0.5, 0.01)
        self.weights /= self.weights.sum()

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language, its share of exp(-loss), its lead over the second)."""
        f = (x @ self.w + self.b).astype(np.float64)
        loss = np.stack([(np.log1p(np.exp(-np.clip(c * f, -30, 30))) * self.weights).sum(1) for c in self.code], axis=1)
        e = np.exp(-8 * (loss - loss.min(1, keepdims=True)))
        e /= e.sum(1, keepdims=True)
        top = np.sort(e, axis=1)[:, ::-1]
        return e.argmax(1), top[:, 0], top[:, 0] - (top[:, 1] if e.shape[1] > 1 else 0)


def identify(docs: DataFrame, train: Column, dims: int = 2048, sample: int = 4096, ambiguous: float = 0.2, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, held_out, lang_pred, score, ambiguous) of every row, learned from rows where `train` holds and lang is given.

    Training takes at most `sample` rows, those of smallest hash of their key among rows with a letter; their profiles
    (dims floats each) and not their texts go to the driver. Prediction reads the whole text and nothing else. A null
    text or one without a letter is `und` with score 0, and so is any text where no row could be learned from. score is
    from 0 to 1; a lead over the second language below `ambiguous` raises the flag. Rows are kept as they are, repeated
    ones too. held_out is the opposite of `train` (a null key counts as held out).
    """
    spark = docs.sparkSession
    known = docs.where(train & F.col(lang).isNotNull() & F.col(text).rlike(LETTER)).select(F.col(key).alias("_key"), F.col(lang).alias("_lang"), F.xxhash64(F.col(key).cast("string")).alias("_order"))
    chosen = known.orderBy("_order", "_key").limit(sample).select("_key").distinct()
    rows = docs.where(train & F.col(lang).isNotNull()).join(F.broadcast(chosen), docs[key] == chosen["_key"], "left_semi").select(lang, text)

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, bounds in text_slices(batch.column(1), 1 << 20):
                for a in range(0, hi - lo, 512):
                    cut = bounds[a : min(a + 512, hi - lo) + 1]
                    x = profiles(buf[cut[0] : cut[-1]], cut - cut[0], dims).astype(np.float16)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo + a, len(x)), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "x"])

    # the limit only cuts where docs repeat a chosen key
    fit = rows.mapInArrow(profile, "lang string, x binary").limit(2 * sample).toArrow()
    model = None
    if len(fit):
        x = np.empty((len(fit), dims), np.float32)
        for i, b in enumerate(fit.column(1)):
            x[i] = np.frombuffer(b.as_buffer(), np.float16)
        model = Model(x, fit.column(0).to_pylist())
        del fit, x
    shared = spark.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            has = batch.column(3).to_numpy(zero_copy_only=False)
            for lo, hi, buf, bounds in text_slices(batch.column(2), 1 << 20):
                for a in range(0, hi - lo, 512):
                    cut = bounds[a : min(a + 512, hi - lo) + 1]
                    n = len(cut) - 1
                    letters = has[lo + a : lo + a + n]
                    name, score, lead = np.full(n, "und", object), np.zeros(n), np.zeros(n)
                    if model is not None:
                        at, s, d = model.decode(profiles(buf[cut[0] : cut[-1]], cut - cut[0], dims))
                        name[letters], score[letters], lead[letters] = np.array(model.langs, object)[at][letters], s[letters], d[letters]
                    keep = [batch.column(0).slice(lo + a, n), batch.column(1).slice(lo + a, n)]
                    yield pa.RecordBatch.from_arrays([*keep, pa.array(name, pa.string()), pa.array(score), pa.array(lead < ambiguous)], ["_key", "held_out", "lang_pred", "score", "ambiguous"])

    kind = dict(docs.dtypes)[key]
    out = docs.select(F.col(key).alias("_key"), F.coalesce(~train, F.lit(True)).alias("held_out"), F.col(text).alias("_text"), F.coalesce(F.col(text).rlike(LETTER), F.lit(False)).alias("_letters"))
    return out.mapInArrow(predict, f"_key {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean").withColumnRenamed("_key", key)
