"""Operators over rows in an order, without a window over a whole table: as-of joins, exact quantiles, joins by prefix and greedy
batches.

Where a window would put a table or a hot key into one task, rows are cut into segments of the order. Each segment is worked
on by itself and sums up what the others need of it in few rows, which are then put together.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .versions import shared_folder


def next_at(left: DataFrame, right: DataFrame, at: str, by: list[str], width: int = 7 * 86_400, name: str = "found") -> DataFrame:
    """left with `name`, a struct of the first row of right with the same `by` that is not before it in `at` (a date or time).

    Both sides are merged within buckets of `width` seconds; a row without a match in its bucket takes the first one of a later
    bucket, of which there is one for each key and bucket. Of several rows of right at one time the least counts; rows of left
    with a null in `by` or `at`, or after all of right, get null. Rows of left all stay, repeated ones too.
    """
    first = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / width)
    mine = left.select(*by, F.col(at).alias("_at"), first(at).alias("_bucket"), F.struct(*left.columns).alias("_row"))
    theirs = right.dropna(subset=[*by, at]).select(*by, F.col(at).alias("_at"), first(at).alias("_bucket"), F.struct(at, *[c for c in right.columns if c != at]).alias("_found"))
    both = mine.withColumn("_found", F.lit(None).cast(theirs.schema["_found"].dataType)).unionByName(theirs.withColumn("_row", F.lit(None).cast(mine.schema["_row"].dataType)))
    # backwards in time: what was seen last is the next one, and of equal times right comes before left, the least row last
    back = Window.partitionBy(*by, "_bucket").orderBy(F.desc("_at"), F.col("_row").isNotNull(), F.desc("_found"))
    near = both.withColumn("_near", F.last("_found", ignorenulls=True).over(back)).where("_row is not null")
    starts = theirs.groupBy(*by, "_bucket").agg(F.min("_found").alias("_first"))
    slots = near.select(*by, "_bucket").distinct().join(starts, [*by, "_bucket"], "full")
    later = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(1, Window.unboundedFollowing)
    after = slots.select(*by, "_bucket", F.first("_first", ignorenulls=True).over(later).alias("_later"))
    known = reduce(lambda a, b: a & b, [F.col(f"_row.{c}").isNotNull() for c in [*by, at]])
    out = near.join(after, [*by, "_bucket"], "left").withColumn(name, F.when(known, F.coalesce("_near", "_later")))
    return out.select("_row.*", name)


def nearest_rank(values: DataFrame, value: str, by: list[str], share: float = 0.9, name: str = "p90", bins: int = 4096) -> DataFrame:
    """The value at 0-based rank floor(n x share) of each group, exactly: by histograms of ever narrower ranges.

    A round counts the rows of each of a group's `bins` and goes on with the bin that has the rank, so no group is sorted or
    gathered, and windows are over bins. Numbers are compared as doubles; null ones don't count, and a group of nulls has no row.
    """
    own = values.where(F.col(value).isNotNull()).select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], F.col(value).alias("_v"))
    keys = [f"_g{i}" for i in range(len(by))]
    state = own.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.floor(F.count("*") * F.lit(share)).alias("_rank"))
    shared_folder(values.sparkSession)
    state = state.checkpoint()  # a row for each group
    while state.where("_lo <> _hi").limit(1).count():
        ranges = state.where("_lo <> _hi")
        open_ = own.alias("o").join(ranges.alias("s"), _same("o", "s", keys)).where("_v between _lo and _hi")
        lo, hi = F.col("_lo").cast("double"), F.col("_hi").cast("double")
        at = F.least(F.floor((F.col("_v").cast("double") - lo) / (hi - lo) * bins), F.lit(bins - 1))
        counted = open_.select(*[F.col(f"o.{k}").alias(k) for k in keys], "_v", "_rank", at.alias("_bin")).groupBy(*keys, "_bin").agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.first("_rank").alias("_rank"))
        upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bin"))
        chosen = counted.withColumn("_before", upto - F.col("_n")).where((F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_before") + F.col("_n")))
        state = state.where("_lo = _hi").unionByName(chosen.select(*keys, "_lo", "_hi", (F.col("_rank") - F.col("_before")).alias("_rank"))).checkpoint()
    return state.select(*[F.col(k).alias(c) for k, c in zip(keys, by)], F.col("_lo").alias(name))


def _same(a: str, b: str, keys: list[str]) -> Column:
    """Equal in all keys, nulls included."""
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys], F.lit(True))


def prefix_links(links: DataFrame, sources: DataFrame, link: str = "link", source: str = "source") -> DataFrame:
    """(link, longest, begins) of every distinct link: the longest source that it begins with, and whether some source begins with it.

    Each side is exploded to its beginnings, of those lengths only that the other side has, and met by equality; no pairs of a link
    with all sources are made. Case matters; null and empty ones are left out.
    """
    texts = lambda df, c: df.select(F.col(c).alias("_t")).where("_t <> ''").distinct()
    a, b = texts(links, link), texts(sources, source)

    def beginnings(df: DataFrame, of: DataFrame) -> DataFrame:
        """(_t, _p): the beginnings of texts of the lengths that occur in `of`: at most as many as the longest text has letters."""
        lengths = of.agg(F.collect_set(F.length("_t")).alias("_lengths"))
        some = df.crossJoin(F.broadcast(lengths))  # one row
        return some.select("_t", F.explode(F.transform(F.filter("_lengths", lambda n: n <= F.length("_t")), lambda n: F.substring("_t", 1, n))).alias("_p"))

    longest = beginnings(a, b).join(b.withColumnRenamed("_t", "_p"), "_p", "left_semi").groupBy("_t").agg(F.max_by("_p", F.length("_p")).alias("longest"))
    begun = beginnings(b, a).select(F.col("_p").alias("_t")).distinct().withColumn("begins", F.lit(True))
    out = a.join(longest, "_t", "left").join(begun, "_t", "left")
    return out.select(F.col("_t").alias(link), "longest", F.coalesce("begins", F.lit(False)).alias("begins"))


# Greedy batches


def exits(sizes: np.ndarray, most_rows: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For a batch that begins at each row of a segment: how far beyond the segment the first batch that leaves it begins at least.

    Returns (rows, total) of the batch that is open at the segment's end, if a batch begins at this row.
    """
    n = len(sizes)
    upto = np.concatenate(([0], np.cumsum(sizes)))
    rows, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(n - 1, -1, -1):
        end = min(i + most_rows, max(i + 1, int(np.searchsorted(upto, upto[i] + most, "right")) - 1))
        if end < n:
            rows[i], total[i] = rows[end], total[end]
        else:
            rows[i], total[i] = n - i, upto[n] - upto[i]
    return rows, total


def passed(rows: int, total: int, segments: list[tuple], most_rows: int, most: int) -> list[tuple[int, int]]:
    """The open batch (rows, total) before each of these segments in turn and behind the last. segments: (head, rows, totals)."""
    out = [(rows, total)]
    for head, after, sums in segments:
        for i, s in enumerate(head):
            if not rows or rows == most_rows or total + s > most:
                rows, total = int(after[i]), int(sums[i])  # a batch begins here, which decides the rest
                break
            rows, total = rows + 1, total + int(s)
        out.append((rows, total))
    return out


def greedy_batches(df: DataFrame, key: str, size: str, most_rows: int, most: int, width: int = 4096, together: int = 1024) -> DataFrame:
    """(key, size, batch): rows in the order of an integer key, in batches of at most so many rows and so large a sum, numbered from 0.

    A batch closes at the row that would exceed a limit, as a single pass over all rows would close it; a larger row is a batch of
    its own. Keys are not null and distinct, or nearly so. Segments are ranges of `width` keys. Of the batch that is open when a
    segment begins it only matters which of the segment's first most_rows + 1 rows is the first that can't join it: so a segment
    is a table from these rows to the batch that is open at its end, `together` segments in a row make up such a table again, and
    only those, one row for some millions of keys, are gone through in order.
    """
    own = df.select(F.col(key).alias("_k"), F.col(size).cast("long").alias("_s")).withColumn("_seg", F.floor(F.col("_k") / width).cast("long"))
    many = F.floor(F.col("_seg") / together).cast("long")
    lists = "head array<long>, rows array<long>, total array<long>"

    def of_rows(pdf: pd.DataFrame) -> pd.DataFrame:
        s = pdf.sort_values("_k", kind="stable")["_s"].to_numpy()
        rows, total = exits(s, most_rows, most)
        n = most_rows + 1
        return pd.DataFrame({"_seg": [pdf["_seg"].iloc[0]], "head": [s[:n].tolist()], "rows": [rows[:n].tolist()], "total": [total[:n].tolist()]})

    def in_order(pdf: pd.DataFrame, by: str) -> list[tuple]:
        pdf = pdf.sort_values(by)
        return list(zip(pdf["head"], pdf["rows"], pdf["total"]))

    def of_segments(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = in_order(pdf, "_seg")
        head, rows, total = [], [], []
        for j, (first, after, sums) in enumerate(parts):
            for i, s in enumerate(first):
                if len(head) <= most_rows:
                    r, t = passed(int(after[i]), int(sums[i]), parts[j + 1 :], most_rows, most)[-1]
                    head.append(int(s)), rows.append(r), total.append(t)
            if len(head) > most_rows:
                break
        return pd.DataFrame({"_many": [pdf["_many"].iloc[0]], "head": [head], "rows": [rows], "total": [total]})

    def through_all(batches):
        state = (0, 0)
        for pdf in batches:
            seen = passed(*state, in_order(pdf, "_many"), most_rows, most)
            state = seen[-1]
            yield pd.DataFrame({"_many": sorted(pdf["_many"]), "_rows": [r for r, _ in seen[:-1]], "_total": [t for _, t in seen[:-1]]})

    def through_segments(segments: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        seen = passed(int(state["_rows"].iloc[0]), int(state["_total"].iloc[0]), in_order(segments, "_seg"), most_rows, most)
        return pd.DataFrame({"_seg": sorted(segments["_seg"]), "_rows": [r for r, _ in seen[:-1]], "_total": [t for _, t in seen[:-1]]})

    def number(rows: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_k", kind="stable")
        n, total, batch, out = int(state["_rows"].iloc[0]), int(state["_total"].iloc[0]), 0, []
        for s in rows["_s"].tolist():
            if not n or n == most_rows or total + s > most:
                batch, n, total = batch + 1, 0, 0
            n, total = n + 1, total + s
            out.append(batch)
        return rows.assign(_own=out)[["_k", "_s", "_seg", "_own"]]

    segments = own.groupBy("_seg").applyInPandas(of_rows, f"_seg long, {lists}").withColumn("_many", many).persist()
    runs = segments.groupBy("_many").applyInPandas(of_segments, f"_many long, {lists}")
    entries = runs.repartition(1).sortWithinPartitions("_many").mapInPandas(through_all, "_many long, _rows long, _total long")
    states = segments.groupBy("_many").cogroup(entries.groupBy("_many")).applyInPandas(through_segments, "_seg long, _rows long, _total long")
    cut = own.groupBy("_seg").cogroup(states.groupBy("_seg")).applyInPandas(number, "_k long, _s long, _seg long, _own long")
    begun = cut.groupBy("_seg").agg(F.max("_own").alias("_begun")).withColumn("_many", many)
    so_far = lambda w: F.coalesce(F.sum("_begun").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = begun.select("_seg", "_many", so_far(Window.partitionBy("_many").orderBy("_seg")).alias("_inner"))
    outer = begun.groupBy("_many").agg(F.sum("_begun").alias("_begun")).select("_many", so_far(Window.orderBy("_many")).alias("_outer"))
    starts = within.join(outer, "_many").select("_seg", (F.col("_inner") + F.col("_outer")).alias("_start"))
    return cut.join(starts, "_seg").select(F.col("_k").cast(df.schema[key].dataType).alias(key), F.col("_s").alias(size), (F.col("_start") + F.col("_own") - 1).alias("batch"))
