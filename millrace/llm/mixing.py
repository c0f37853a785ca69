"""Mixing sources to target weights by Pfair scheduling (Baruah et al. 1996).

Every source is cut into blocks of rows. With weight w, the i-th block of a source is released at slot floor((i-1)/w) and
due by slot ceil(i/w); at each slot the released block with the earliest deadline goes next. That is feasible whenever
weights add up to one, so at every slot a source is less than one block ahead of or behind its weight.

Weights are exact fractions, so rounding never adds up. Where they are whole shares of a period the schedule repeats
with it, and one period is all that is simulated; else all blocks of the phase are (a heap of one entry a source).
When a source is used up, the weights of the others are scaled up and a new phase begins; a plan has at most as many
phases as there are sources. Rows find their block from their rank in their source. The driver sees one count for each
source and holds the plan, a row for each block; all else is DataFrame code.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import fresh, gapless_rank, partitions

NONE = "\u0000none"


def shares(weights: dict[str, float], period: int) -> dict[str, int]:
    """Whole shares of a period, at least one each, by largest remainder (ties by name)."""
    period = max(period, 2 * len(weights))
    total = sum(weights.values())
    exact = {s: w / total * period for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(weights, key=lambda s: (out[s] - exact[s], s))
    while (short := period - sum(out.values())) > 0:
        for s in order[:short]:
            out[s] += 1
    while sum(out.values()) > period:
        out[max(out, key=lambda s: (out[s] - exact[s] if out[s] > 1 else -period, s))] -= 1
    return out


def period_slots(share: dict[str, int]) -> dict[str, list[int]]:
    """The slots of each source's blocks in one period, by earliest deadline among the released blocks."""
    period = sum(share.values())
    done, slots = dict.fromkeys(share, 0), {s: [] for s in share}
    for t in range(period):
        ready = [(-(-(done[s] + 1) * period // q), s) for s, q in share.items() if done[s] < q and done[s] * period // q <= t]
        s = min(ready)[1]
        slots[s].append(t)
        done[s] += 1
    return slots


def whole(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the proportions of the weights."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    unit = math.lcm(*(w.denominator for w in exact.values()))
    return {s: int(w * unit) for s, w in exact.items()}


def until_used_up(left: dict[str, int], share: dict[str, int]) -> dict[str, list[int]]:
    """The slots of each source's blocks, as in `period_slots`, until the first source has had its last block."""
    total, slots, t = sum(share.values()), {s: [] for s in share}, 0
    waiting, ready = [(0, s) for s in sorted(share)], []
    while True:
        while waiting and waiting[0][0] <= t:
            s = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(len(slots[s]) + 1) * total // share[s]), s))
        s = heapq.heappop(ready)[1]
        slots[s].append(t)
        t += 1
        if len(slots[s]) == left[s]:
            return slots
        heapq.heappush(waiting, (len(slots[s]) * total // share[s], s))


def phases(blocks: dict[str, int], weights: dict[str, float], period: int) -> dict[str, list[tuple[int, int, int, list[int]]]]:
    """For each source its phases: (first block, first slot, period, slots of its blocks in a period)."""
    left, used, base = dict(blocks), dict.fromkeys(blocks, 0), 0
    out: dict[str, list] = {s: [] for s in blocks}
    while any(left.values()):
        live = {s: weights[s] for s, n in left.items() if n}
        exact, share = whole(live), shares(live, period)
        size, total = sum(share.values()), sum(exact.values())
        if all(share[s] * total == exact[s] * size for s in live):
            slots = period_slots(share)
            # the phase lasts until the first source has had its last block
            end = min(size * ((left[s] - 1) // q) + slots[s][(left[s] - 1) % q] + 1 for s, q in share.items())
        else:
            slots = until_used_up(left, exact)
            end = size = sum(map(len, slots.values()))
        for s in live:
            out[s].append((used[s], base, size, slots[s]))
            n = end // size * len(slots[s]) + sum(x < end % size for x in slots[s])
            used[s] += n
            left[s] -= n
        base += end
    return out


def plan_rows(plan: dict[str, list[tuple[int, int, int, list[int]]]], blocks: dict[str, int], weights: dict[str, float]) -> pa.Table:
    """(_name, _of (its number), _release, _deadline, _slot) of every block of a plan."""
    columns: tuple[list, ...] = ([], [], [], [], [])
    live: dict[int, list[str]] = {}
    for s, own in plan.items():
        for p in own:
            live.setdefault(p[1], []).append(s)
    exact = {base: whole({s: weights[s] for s in names}) for base, names in live.items()}
    total = {base: sum(e.values()) for base, e in exact.items()}
    for s, own in plan.items():
        ends = [*(p[0] for p in own[1:]), blocks[s]]
        for (start, base, size, slots), end in zip(own, ends):
            q, all_ = exact[base][s], total[base]
            for i in range(end - start):
                row = (s, start + i, i * all_ // q, -(-(i + 1) * all_ // q), base + i // len(slots) * size + slots[i % len(slots)])
                for column, x in zip(columns, row):
                    column.append(x)
    kinds = [pa.string(), *[pa.int64()] * 4]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], ["_name", "_of", "_release", "_deadline", "_slot"])


#: Columns that `mix` adds.
ADDED = ["block", "release", "deadline", "slot", "position"]


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block: int = 16, temper: float = 0.5, period: int = 1000, most_blocks: int = 1 << 20, buckets: int | None = None, key: str = "doc_id", source: str = "source") -> DataFrame:
    """Add block, release, deadline, slot and position to every row; ordered by position, sources are mixed by weight.

    weights maps sources to target weights; sources that it doesn't name, and all sources if it is None, get the number
    of their rows to the power `temper`, on the scale of the named ones' rows. Every row is in the result once. Where
    sources run out, those left keep their proportions. Within a source rows come in order of their hashed key. release
    and deadline are slots counted from the start of the phase. A block has `block` rows, or as many more as make about
    `most_blocks` blocks of the table, so that the plan on the driver is bounded. A null source is a source of its own;
    a null key has a hash like any other; repeated rows are rows; an empty table gives no rows. Columns of docs keep
    their values; an added column whose name docs has gets underscores behind its name. Sources should be few (thousands).
    """
    spark = docs.sparkSession
    name = F.coalesce(F.col(f"`{source}`").cast("string"), F.lit(NONE))
    counts = {r[0]: r[1] for r in docs.groupBy(name).count().collect()}
    block = max(block, -(-sum(counts.values()) // most_blocks))
    weights = weights or {}
    named = [s for s in counts if s in weights]
    scale = sum(weights[s] for s in named) / sum(counts[s] ** temper for s in named) if named else 1.0
    target = {s: weights.get(s, n**temper * scale) for s, n in counts.items()}
    blocks = {s: -(-n // block) for s, n in counts.items()}
    table = spark.createDataFrame(plan_rows(phases(blocks, target, period), blocks, target))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), name.alias("source"), F.xxhash64(F.col(f"`{key}`")).alias("hash"), F.col(f"`{key}`").alias("key"))
    # a bucket is a shuffle partition's share of the rows, also where one source has most of them
    ranked = gapless_rank(own, ["source"], ["hash", "key"], buckets or partitions(spark), "rank").withColumn("block", F.floor(F.col("rank") / block))
    out = ranked.join(F.broadcast(table), (F.col("source") == F.col("_name")) & (F.col("block") == F.col("_of")))
    added = dict(zip(ADDED, ("block", "_release", "_deadline", "_slot", F.col("_slot") * block + F.col("rank") % block), strict=True))
    own_columns = [F.col("doc").getField(c).alias(c) for c in docs.columns]
    return out.select(*own_columns, *[(F.col(v) if isinstance(v, str) else v).alias(fresh(c, docs.columns)) for c, v in added.items()])
