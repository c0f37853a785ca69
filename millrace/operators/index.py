"""A stored inverted index of texts: postings by term with block maxima, and the statistics of the corpus.

Texts are dealt into blocks of at most BLOCK_ROWS, each within one scope (a value of every column in `by`). A row of the
index is a block's list for one term (places in the block, counts, the largest count and the shortest text), or, with a
null term, the block itself (ids in order, sizes, labels), from which come the statistics. The table is one of versions:
to index a scope anew replaces its blocks in one step and touches no other. Rows lie in files by buckets of terms, so a
search reads only the buckets of the words it asks for.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tokenize
from . import versions

#: A block ends with this many rows, or with so many words.
BLOCK_ROWS, BLOCK_WORDS = 1024, 1 << 20
#: Buckets of terms by which postings are kept apart; the rows of blocks themselves have bucket -1.
BUCKETS = 64
LISTS = "token string, block string, n int, words long, sizes array<int>, labels array<string>, places array<int>, counts array<int>, most int, least int"


def bucket_of(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def entries(chunks: DataFrame, item: str, text: str, by: list[str], label: Column | None) -> DataFrame:
    """The rows of the index for these chunks: a task makes blocks of the rows that it reads, scope by scope."""
    kind = chunks.schema[item].dataType
    schema = T.StructType([*[T.StructField(c, chunks.schema[c].dataType) for c in by], *T._parse_datatype_string(LISTS).fields, T.StructField("ids", T.ArrayType(kind))])
    words = F.coalesce(tokenize(F.col(text)), F.array().cast("array<string>"))
    rows = chunks.select(*by, F.col(item).alias("_id"), words.alias("_words"), (F.lit(None).cast("string") if label is None else label).alias("_label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix, made = f"{uuid.uuid4().hex[:12]}-{TaskContext.get().partitionId()}", 0
        open_: dict[tuple, list] = {}
        total = 0

        def close(scope: tuple) -> Iterator[pa.RecordBatch]:
            nonlocal made, total
            parts = open_.pop(scope)
            table = pa.Table.from_batches(parts)
            total -= words_of(table)
            made += 1
            yield from invert(table, scope, by, f"{prefix}-{made}")

        for batch in batches:
            for scope, part in by_scope(batch, by):
                for start in range(0, len(part), BLOCK_ROWS):
                    piece = part.slice(start, BLOCK_ROWS)
                    if scope in open_ and sum(map(len, open_[scope])) + len(piece) > BLOCK_ROWS:
                        yield from close(scope)
                    open_.setdefault(scope, []).append(piece)
                    total += words_of(piece)
                    if words_of(pa.Table.from_batches(open_[scope])) > BLOCK_WORDS:
                        yield from close(scope)
            while total > 4 * BLOCK_WORDS:
                yield from close(max(open_, key=lambda s: words_of(pa.Table.from_batches(open_[s]))))
        for scope in list(open_):
            yield from close(scope)

    return rows.mapInArrow(run, schema)


def words_of(rows: pa.Table | pa.RecordBatch) -> int:
    return pc.sum(pc.list_value_length(rows.column("_words"))).as_py() or 0


def by_scope(batch: pa.RecordBatch, by: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The rows of each scope in a batch."""
    if not by:
        yield (), batch
        return
    number: dict[tuple, int] = {}
    of = np.array([number.setdefault(k, len(number)) for k in zip(*(batch.column(c).to_pylist() for c in by))], np.int64)
    for scope, i in number.items():
        yield scope, batch.filter(pa.array(of == i))


def invert(table: pa.Table, scope: tuple, by: list[str], name: str) -> Iterator[pa.RecordBatch]:
    """The index rows of one block: itself, with its rows by id, and a list for each of its terms."""
    table = table.take(pc.sort_indices(table, sort_keys=[("_id", "ascending")])).combine_chunks()
    words = table.column("_words").combine_chunks()
    sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = words.flatten().dictionary_encode()
    codes, terms = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.dictionary
    key, counts = np.unique(codes * len(sizes) + np.repeat(np.arange(len(sizes)), sizes), return_counts=True)
    code, place = key // max(1, len(sizes)), key % max(1, len(sizes))
    first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else np.zeros(0, np.int64)
    edges = np.append(first, len(code))
    n = len(first)
    most = np.maximum.reduceat(counts, first) if n else counts
    least = np.minimum.reduceat(sizes[place], first) if n else counts
    ids, labels = table.column("_id").combine_chunks(), table.column("_label").combine_chunks()

    def column(values: pa.Array, kind: pa.DataType, at: str) -> pa.Array:
        """One value for the block and none for the terms, or the other way round."""
        other = pa.nulls(n if at == "block" else 1, kind)
        return pa.concat_arrays([values, other] if at == "block" else [other, values])

    def one(values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    ints, text = pa.list_(pa.int32()), pa.string()
    columns = [pa.array([v] * (n + 1), kind) for v, kind in zip(scope, (table.schema.field(c).type for c in by))]
    columns += [
        column(terms.take(pa.array(code[first])).cast(text), text, "terms"), pa.array([name] * (n + 1), text), pa.array(np.concatenate(([len(sizes)], np.diff(edges))), pa.int32()),
        pa.array(np.concatenate(([sizes.sum()], np.zeros(n, np.int64)))), column(one(pa.array(sizes, pa.int32())), ints, "block"), column(one(labels.cast(text)), pa.list_(text), "block"),
        column(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(place, pa.int32())), ints, "terms"), column(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(counts, pa.int32())), ints, "terms"),
        column(pa.array(most, pa.int32()), pa.int32(), "terms"), column(pa.array(least, pa.int32()), pa.int32(), "terms"), column(one(ids), pa.list_(ids.type), "block"),
    ]
    names = [*by, *[f.split()[0] for f in LISTS.split(", ")], "ids"]
    whole = pa.RecordBatch.from_arrays(columns, names)
    for start in range(0, n + 1, 20_000):
        yield whole.slice(start, 20_000)


def write(chunks: DataFrame, path: str, item: str = "chunk_id", text: str = "text", by: list[str] | None = None, label: Column | None = None, scope: dict | None = None) -> int:
    """Index chunks (item, text, the columns of `by`), in place of what the index at `path` has of their scopes and of `scope`.

    `label` is what searches may filter by. A null text has no words but counts as a text; ids are unique and not null. Returns
    the version. Blocks are made from stable files, and a lost task is made again before any reader sees its rows.
    """
    by = by or []
    if by:  # rows of a scope together, a large scope in parts, so that blocks are full
        parts = max(1, chunks.count() // (64 * BLOCK_ROWS))
        tasks = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        chunks = chunks.repartition(tasks, *by, F.pmod(F.xxhash64(item), F.lit(parts)))
    made = entries(chunks, item, text, by, label)
    folder = f"{path}/making-{uuid.uuid4().hex}"
    spark = chunks.sparkSession
    try:  # names of blocks are made up by tasks, so rows are dealt to buckets only once they are written
        made.write.parquet(folder)
        bucket = F.when(F.col("token").isNull(), -1).otherwise(bucket_of(F.col("token"))).alias("bucket")
        rows = spark.read.schema(made.schema).parquet(folder).select("*", bucket).repartition(*by, "bucket").sortWithinPartitions("bucket", "token")
        return versions.publish(rows, path, by, scope)
    finally:
        fs, where = versions.file_system(spark, folder)
        fs.delete(where, True)


def read(spark: SparkSession, path: str, scope: dict | None = None) -> DataFrame:
    """The rows of the index, or of some scopes."""
    return versions.current(spark, path, scope)


def fingerprint(table: DataFrame) -> str:
    """A name for the state of the files that a table is read from."""
    import hashlib

    spark = table.sparkSession
    said = []
    for name in sorted(table.inputFiles()):
        fs, where = versions.file_system(spark, name)
        status = fs.getFileStatus(where)
        said.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(said).encode()).hexdigest()[:24]
