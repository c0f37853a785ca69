"""Embedding of texts by an injected function, in batches of bounded rows and tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def embed(df: DataFrame, key: str, text: str, function: Callable[[list[str]], list[list[float]]], batch: int = 64, most_tokens: int = 240_000) -> DataFrame:
    """(key, vector) by an injected function over lists of texts, at most `batch` and about so many tokens at a time.

    A text of more tokens than that goes by itself. Tokens are estimated as in `chunks.embedding_batches`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = [t or "" for t in rows.column(1).to_pylist()]
            start, total = 0, 0
            for i in range(len(texts) + 1):
                n = max(1, (len(texts[i]) + 3) // 4) if i < len(texts) else 0
                if i > start and (i == len(texts) or i - start == batch or total + n > most_tokens):
                    vectors = function(texts[start:i])
                    yield pa.RecordBatch.from_arrays([rows.column(0).slice(start, i - start), pa.array(vectors, pa.list_(pa.float32()))], [key, "vector"])
                    start, total = i, 0
                total += n

    return df.select(key, text).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, vector array<float>")
