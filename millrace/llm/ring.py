"""Sharding on a consistent-hash ring with virtual nodes and bounded loads (Mirrokni, Thorup and Zadimoghaddam 2018).

A shard owns the arcs that end at its virtual nodes. A key belongs to the arc that its hash falls on; where the arc's
shard is full, the key goes on clockwise to the next virtual node whose shard has room. Which keys move on is settled
for arcs and not for rows: the driver sees one count for each arc (virtual nodes x shards numbers, whatever the input),
walks the ring once, and gives every arc a list of segments (first rank, shard, first slot). Rows find their segment by
their rank within the arc. So the only work over rows is one shuffle by arc.

`load_factor` bounds a shard's rows by load_factor x mean. At 1.0 each shard's room is the mean rounded down or up, and
counts are at most one apart; the default of 1.05 moves fewer rows when shards come or go.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import only

#: The ring has 2**16 cells. A virtual node stands at a cell, so that a table of cells (fixed size) maps keys to arcs.
CELLS = 1 << 16
#: Copies of a row that one task makes at once.
RUN = 1 << 16


def ring(shards: int, replicas: int) -> list[tuple[int, int]]:
    """(cell, shard) of each virtual node, clockwise. Two on one cell: the smaller shard number stands first."""
    at = lambda s, r: int(hashlib.md5(f"{s}/{r}".encode()).hexdigest()[:4], 16)
    return sorted((at(s, r), s) for s in range(shards) for r in range(replicas))


def capacities(total: int, shards: int, load_factor: float) -> list[int]:
    """Rows that each shard may hold."""
    if load_factor <= 1:
        return [total // shards + (s < total % shards) for s in range(shards)]
    return [math.ceil(load_factor * total / shards)] * shards


def segments(nodes: list[tuple[int, int]], counts: dict[int, int], room: list[int]) -> list[tuple[int, int, int, int]]:
    """(arc, first rank, shard, first slot): first each shard takes from its own arcs, then what is over goes clockwise."""
    room, filled, out, over = list(room), [0] * len(room), [], []

    def give(arc: int, start: int, n: int, shard: int) -> int:
        n = min(n, room[shard])
        if n:
            out.append((arc, start, shard, filled[shard]))
            room[shard] -= n
            filled[shard] += n
        return n

    for arc, (_, shard) in enumerate(nodes):
        n = counts.get(arc, 0)
        took = give(arc, 0, n, shard)
        if took < n:
            over.append((arc, took, n - took))
    for arc, start, n in over:
        at = arc
        while n:
            at = (at + 1) % len(nodes)
            took = give(arc, start, n, nodes[at][1])
            start, n = start + took, n - took
    return out


def text_size(text: Column, extra: int = 8) -> Column:
    """UTF-8 bytes of a text (null: none) plus a fixed overhead for the row."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + extra).cast("long")


def shard_rows(docs: DataFrame, shards: int, replicas: int = 128, load_factor: float = 1.05, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Deal every row to a shard: (key, size, text_crc32, shard, slot); slot counts from 0 in each shard without gaps.

    Defined for any table: a null key has a hash like any other, a null text has size 8 and the crc32 of nothing (0).
    Rows that are equal in key, size and checksum are counted together before the shuffle (so a key that a third of all
    rows share is one row there) and dealt out again at the end. Other columns are ignored. An empty table gives no row.
    """
    base = docs.select(F.col(key).alias("_key"), text_size(F.col(text)).alias("size"), F.crc32(F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b""))).alias("text_crc32"))
    cell = F.conv(F.substring(F.md5(F.coalesce(F.col("_key").cast("string"), F.lit("")).cast("binary")), 1, 4), 16, 10).cast("int")
    rows = base.groupBy("_key", "size", "text_crc32").agg(F.count("*").alias("_n")).withColumn("_cell", cell)
    nodes = ring(shards, replicas)
    cells, last = [c for c, _ in nodes], len(nodes)
    spark = docs.sparkSession
    arcs = spark.createDataFrame([(c, bisect_left(cells, c) % last) for c in range(CELLS)], "_cell int, _arc int")
    on_arc = rows.join(F.broadcast(arcs), "_cell")
    counts = {r[0]: r[1] for r in on_arc.groupBy("_arc").agg(F.sum("_n")).collect()}
    plan = segments(nodes, counts, capacities(sum(counts.values()), shards, load_factor))
    steps: dict[int, list[tuple[int, int, int]]] = {}
    for arc, start, shard, slot in plan:
        steps.setdefault(arc, []).append((start, shard, slot))
    table = spark.createDataFrame([(a, sorted(s)) for a, s in steps.items()], "_arc int, _steps array<struct<start:long,shard:int,slot:long>>")
    order = Window.partitionBy("_arc").orderBy(F.xxhash64("_key"), "_key", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    ranked = only(on_arc, "_key", "size", "text_crc32", "_arc", "_n").withColumn("_first", F.coalesce(F.sum("_n").over(order), F.lit(0)))
    # copies are made again in runs of at most RUN, which are dealt to all tasks
    runs = ranked.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / RUN)))).repartition("_key", "_run")
    single = runs.withColumn("_copy", F.explode(F.sequence(F.col("_run") * RUN, F.least(F.col("_n"), (F.col("_run") + 1) * RUN) - 1))).withColumn("_rank", F.col("_first") + F.col("_copy"))
    placed = single.join(F.broadcast(table), "_arc").withColumn("_step", F.element_at(F.filter("_steps", lambda s: s["start"] <= F.col("_rank")), -1))
    slot = F.col("_step.slot") + F.col("_rank") - F.col("_step.start")
    return placed.select(F.col("_key").alias(key), "size", "text_crc32", F.col("_step.shard").alias("shard"), slot.alias("slot"))
