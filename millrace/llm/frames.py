"""DataFrame helpers of the training-data operators: checkpoints, gapless ranks and connected components.

All of it is DataFrame code. What cuts a lineage goes to the shared folder of `spark.checkpoint.dir`, so a lost executor
costs a recomputation of its tasks and never the result.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Only where none is set and driver and executors are one process (a local master, as in tests) a temporary one is made.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="millrace-checkpoint-"))
    return context.getCheckpointDir()


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder in whichever store it is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def written(df: DataFrame) -> Iterator[DataFrame]:
    """df as a Parquet table in the shared folder, which is deleted at the end; smaller than a checkpoint of many rows."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    try:
        df.write.parquet(folder)
        yield spark.read.schema(df.schema).parquet(folder)
    finally:
        remove(spark, folder)


def settle(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there.

    What df was made of is let go: a loop of many small jobs else fills the driver's heap with plans and metrics that are done with.
    """
    spark = df.sparkSession
    shared_folder(spark)
    out = df.checkpoint(eager=True)
    del df
    release(spark)
    return out


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and broadcasts of what is done with, which it does when the driver drops its handles."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def only(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns, so that further columns of any name can't clash with those an operator adds."""
    return df.select(*names)


def fresh(name: str, taken: list[str]) -> str:
    """The name, with as many underscores behind it as make it differ (without regard to case) from those taken."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name


def is_scan(df: DataFrame) -> bool:
    """Whether df is columns and rows of one table of files and nothing more, so that files and places in them name its rows."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    return node.nodeName().startswith(("LogicalRelation", "Relation"))


def numbered(docs: DataFrame) -> DataFrame:
    """(row, doc) of every row: a number that the row has whenever it is read, and its columns as one struct.

    Rows of files are named by file and place in it. Rows of anything else may come in another order when they are made
    again, so they are written to the checkpoint folder with their numbers.
    """
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    if is_scan(docs):
        try:
            place = docs.metadataColumn("_metadata")
            return docs.select(F.xxhash64(place["file_path"], place["row_index"]).alias("row"), doc)
        except AnalysisException:  # a format without places
            pass
    return settle(docs.select(F.monotonically_increasing_id().alias("row"), doc))


def in_file_order(docs: DataFrame, *columns: str) -> DataFrame:
    """(position, columns): the place of every row in the order of its files, from 0 without gaps.

    What isn't a table of files is numbered by its partitions, with gaps between them, and written to the checkpoint folder.
    """
    if is_scan(docs):
        try:
            place = docs.metadataColumn("_metadata")
            rows = docs.select(*[F.col(f"`{c}`") for c in columns], place["file_path"].alias("_file"), place["row_index"].alias("_place"))
            sizes = rows.groupBy("_file").agg((F.max("_place") + 1).alias("_rows"))  # a row for each file
            before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
            starts = sizes.select(F.col("_file").alias("_own"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
            joined = rows.join(F.broadcast(starts), F.col("_file") == F.col("_own"))
            return joined.select((F.col("_start") + F.col("_place")).alias("position"), *[F.col(f"`{c}`") for c in columns])
        except AnalysisException:
            pass
    return settle(docs.select(F.monotonically_increasing_id().alias("position"), *[F.col(f"`{c}`") for c in columns]))


def bucket(*columns: Column | str, buckets: int) -> Column:
    """A hash bucket in 0..buckets-1."""
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")


def gapless_rank(df: DataFrame, keys: list[str], order: list[str], buckets: int, name: str) -> DataFrame:
    """Add a rank from 0 without gaps within each key, though one key may hold most rows. Keys are never null.

    Rows of a key are dealt into hash buckets of `order` and ranked there; a key's buckets are laid end to end by a
    running sum over counts (one row for a key and bucket). The rank is by (bucket, order). Where `order` has ties the
    rows in question are equal in `order`, and either may come first. df must have no columns of the names used here.
    """
    dealt = df.withColumn("_bucket", bucket(*order, buckets=buckets))
    sizes = dealt.groupBy(*keys, "_bucket").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    joined = dealt.withColumn("_own", F.row_number().over(own) - 1).join(starts, [*keys, "_bucket"])
    return joined.select(*df.columns, (F.col("_own") + F.col("_start")).cast("long").alias(name))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): a row (node, root) for each node, root being the smallest node.

    Alternating large and small stars (Kiveris et al. 2014): each round links the neighbours of a node to the smallest
    of them, until nothing changes. Both steps are joins and aggregates on one node column; a node with very many
    neighbours only makes a skewed join side, which adaptive execution splits. Nothing is gathered on the driver but
    two sums a round. No edges give no rows.
    """
    now = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    # few edges need few tasks: one for each 100,000, as many as there are partitions at most
    tasks = min(partitions(edges.sparkSession), 1 + now.count() // 100_000)
    now = now.coalesce(tasks)
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if not state[0] or state == seen:
            break
        seen = state
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = settle(small.union(least.select("a", F.col("m").alias("b"))).distinct().coalesce(tasks))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def most_frequent(counts: DataFrame, most: int) -> tuple:
    """The keys and counts of rows (k, c) with the highest counts, at most `most`, highest first, as numpy arrays.

    The cut is made between classes of counts (sixteen to a power of two), whose sizes are all that the driver sees
    first; so fewer than `most` may come back, and none if one class alone is larger.
    """
    scale = F.floor(F.log2("c") * 16)
    sizes = counts.groupBy(scale.alias("s")).agg(F.count("*").alias("n")).collect()
    cut, total = float("inf"), 0
    for s, n in sorted(((r["s"], r["n"]) for r in sizes), reverse=True):
        total += n
        if total > most:
            break
        cut = s
    rows = counts.where(scale >= F.lit(cut)).select("k", "c").toArrow()
    k, c = rows.column(0).to_numpy(), rows.column(1).to_numpy()
    by = np.lexsort((k, -c))
    return k[by], c[by]
