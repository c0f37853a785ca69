"""Maximum inner product search by score-aware anisotropic product quantisation (Guo et al. 2020).

A vector is cut into subspaces, each coded by one of 16 centres (four bits). Codes are chosen to minimise a loss in
which the part of the residual that is parallel to the vector weighs `eta` times the orthogonal part: for a query that
ranks the vector high, it is the parallel part that spoils the score. A search looks up 16 scores for each subspace and
query (the table), adds them up along the codes of all vectors (the scan), and takes exact inner products of the best.

Vectors are dealt into candidate blocks and queries into query blocks, and each pair of blocks is one group of one
cogrouped job; both block sizes are parameters, so no task and no broadcast grows with the input. The codebook is
fitted on a bounded, documented sample; every row is coded and scanned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import bucket

CENTRES = 16


def kmeans(x: np.ndarray, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), CENTRES, replace=len(x) < CENTRES)].astype(np.float64)
    for _ in range(rounds):
        near = ((x[:, None, :] - c[None]) ** 2).sum(2).argmin(1)
        for k in range(CENTRES):
            if (near == k).any():
                c[k] = x[near == k].mean(0)
    return c


class Codebook:
    """Centres of each subspace, fitted to the anisotropic loss by alternating coding and weighted least squares."""

    def __init__(self, sample: np.ndarray, width: int = 2, eta: float = 4.0, rounds: int = 4) -> None:
        self.dim, self.width, self.eta = sample.shape[1], width, eta
        self.spans = [(a, min(a + width, self.dim)) for a in range(0, self.dim, width)]
        self.centres = [kmeans(sample[:, a:b], 7 + a) for a, b in self.spans]
        for _ in range(rounds):
            codes = self.encode(sample)
            self.refit(sample, codes)

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes by coordinate descent on |r|^2 + (eta - 1) <r, x/|x|>^2, r being the whole residual."""
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        unit = x / np.where(norm > 0, norm, 1)
        codes = np.empty((len(x), len(self.spans)), np.uint8)
        square, along = [], []
        parallel = np.zeros(len(x))
        for m, (a, b) in enumerate(self.spans):
            r = x[:, None, a:b] - self.centres[m][None]
            square.append((r**2).sum(2))
            along.append(np.einsum("nkd,nd->nk", r, unit[:, a:b]))
            codes[:, m] = square[m].argmin(1)
            parallel += along[m][np.arange(len(x)), codes[:, m]]
        rows = np.arange(len(x))
        for _ in range(sweeps):
            for m in range(len(self.spans)):
                rest = parallel - along[m][rows, codes[:, m]]
                codes[:, m] = (square[m] + (self.eta - 1) * (rest[:, None] + along[m]) ** 2).argmin(1)
                parallel = rest + along[m][rows, codes[:, m]]
        return codes

    def refit(self, x: np.ndarray, codes: np.ndarray) -> None:
        """Centres that minimise the loss for fixed codes, one subspace at a time (a small linear system each)."""
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        unit = x / np.where(norm > 0, norm, 1)
        residual = x - self.decode(codes)
        for m, (a, b) in enumerate(self.spans):
            own = self.centres[m][codes[:, m]]
            rest = (residual * unit).sum(1) - ((x[:, a:b] - own) * unit[:, a:b]).sum(1)
            for k in range(CENTRES):
                at = codes[:, m] == k
                if at.sum() < 2:
                    continue
                u, v = unit[at, a:b], x[at, a:b]
                left = at.sum() * np.eye(b - a) + (self.eta - 1) * u.T @ u
                right = v.sum(0) + (self.eta - 1) * (u * (rest[at] + (u * v).sum(1))[:, None]).sum(0)
                self.centres[m][k] = np.linalg.solve(left, right)
            residual[:, a:b] = x[:, a:b] - self.centres[m][codes[:, m]]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.centres[m][codes[:, m]] for m in range(len(self.spans))], axis=1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Scores of each query with each centre: (queries, subspaces, 16)."""
        return np.stack([q[:, a:b] @ self.centres[m].T for m, (a, b) in enumerate(self.spans)], axis=1).astype(np.float32)


def scan(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Approximate scores (queries, vectors): one table entry for each subspace, two subspaces at a time as one byte."""
    out = np.zeros((len(tables), len(codes)), np.float32)
    for m in range(0, tables.shape[1], 2):
        if m + 1 < tables.shape[1]:
            pair = (tables[:, m, :, None] + tables[:, m + 1, None, :]).reshape(len(tables), -1)
            out += pair[:, codes[:, m].astype(np.int64) * CENTRES + codes[:, m + 1]]
        else:
            out += tables[:, m][:, codes[:, m]]
    return out


def usable(vector: str) -> Column:
    """Neither null nor empty nor all zero, and without null or non-finite components."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0)


def block_top(book: Codebook, queries: tuple, members: tuple, k: int, rerank: int) -> pd.DataFrame:
    """The k best members of one candidate block for each query of one query block.

    Equal vectors are scanned once: of those the k + 1 smallest ids stand for all, as no others can be among the k best
    (the one more is for a query that is itself one of them).
    """
    qid, q = queries
    vid, x, codes = members
    order = np.argsort(vid, kind="stable")
    vid, x = vid[order], x[order]
    _, first, group = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1])))[:, 0], return_index=True, return_inverse=True)
    by = np.argsort(group, kind="stable")
    edge = np.concatenate(([0], np.cumsum(np.bincount(group))))
    distinct = x[first]
    codes = codes[order][first]
    parts = []
    for lo in range(0, len(q), 64):
        part = q[lo : lo + 64]
        approx = scan(book.tables(part), codes)
        n = min(rerank, len(distinct))
        best = np.argpartition(-approx, n - 1, axis=1)[:, :n]
        for i in range(len(part)):
            exact = distinct[best[i]] @ part[i]
            keep = np.flatnonzero(exact >= -np.partition(-exact, min(k, n - 1))[min(k, n - 1)])
            ids, scores = [], []
            for j in keep.tolist():
                g = best[i, j]
                own = vid[by[edge[g] : min(edge[g + 1], edge[g] + k + 1)]]
                ids.append(own)
                scores.append(np.full(len(own), exact[j]))
            ids, scores = np.concatenate(ids), np.concatenate(scores)
            other = ids != qid[lo + i]
            ids, scores = ids[other], scores[other]
            top = np.lexsort((ids, -scores))[:k]
            parts.append(pd.DataFrame({"query_id": np.full(len(top), qid[lo + i]), "vec_id": ids[top], "score": scores[top]}))
    return pd.concat(parts) if parts else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, rerank: int = 20, width: int = 2, eta: float = 4.0, sample: int = 8192, block: int = 16384, query_block: int = 2048, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Each query's k rows of largest inner product: (query_id, rank, vec_id, score), from rank 1, ties to smaller id.

    queries has the columns of vectors; a row that has a query's id is no candidate of that query. `rerank` times k
    distinct vectors of each candidate block, those that the scan ranks first, get exact scores, in double precision on
    the original vectors; of a block of 16,384 that is 2.4 % for k = 20. Every vector is coded once. The codebook is
    fitted on the `sample` rows of smallest hashed id. Vectors that are null, empty, zero, or hold null or non-finite
    components take no part on either side, and so don't vectors of another length than the sample's first. Equal
    vectors tie by id; repeated ids stay apart as rows. With fewer candidates a query gets all. Empty tables give none.
    """
    spark = vectors.sparkSession
    x = vectors.where(usable(vector)).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    q = queries.where(usable(vector)).select(F.col(vec_id).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("v"))
    schema = "query_id long, vec_id long, score double"
    fit = x.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    if not len(fit):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = len(fit["v"].iloc[0])
    fit = fit[fit["v"].map(len) == dim]
    book = spark.sparkContext.broadcast(Codebook(np.stack(fit["v"].to_numpy()), width, eta))
    x, q = x.where(F.size("v") == dim), q.where(F.size("v") == dim)
    n_x, n_q = x.count(), q.count()
    blocks, query_blocks = max(1, -(-n_x // block)), max(1, -(-n_q // query_block))
    ids = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.withColumn("qb", bucket("query_id", buckets=query_blocks)).withColumn("xb", ids(blocks))

    def coded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(codes=[c.tobytes() for c in book.value.encode(np.stack(f["v"].to_numpy()))]) if len(f) else f.assign(codes=b"")

    once = x.mapInPandas(coded, "vec_id long, v array<double>, codes binary")
    right = once.withColumn("xb", bucket("vec_id", buckets=blocks)).withColumn("qb", ids(query_blocks))

    def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        codes = np.stack([np.frombuffer(c, np.uint8) for c in b["codes"]])
        return block_top(book.value, (a["query_id"].to_numpy(), np.stack(a["v"].to_numpy())), (b["vec_id"].to_numpy(), np.stack(b["v"].to_numpy()), codes), k, rerank * k)

    found = left.groupBy("qb", "xb").cogroup(right.groupBy("qb", "xb")).applyInPandas(pair, schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
