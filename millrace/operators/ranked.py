"""Ranked lists of items for a batch of questions, by words of a stored index or by vectors, and their exact fusion.

A list can be read from its top (`top`) or asked for the score and place of some items (`places`), without ever being
written out: both go through blocks of items, each a matrix of scores of a batch of questions. So lists are fused exactly
by a threshold: as soon as a question's k-th fused score exceeds what any item below the tops could still have, its answer
is final; other questions read on twice as deep.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.rank import unit
from ..functions.text import tokenize
from . import index

NOT_LISTED = -np.inf
#: Questions that are scored together, and items in a block of vectors.
TOGETHER, ROWS = 512, 1024
#: A block: ids in ascending order, the numbers of some questions, and a matrix of scores (questions x items).
Block = tuple[np.ndarray, np.ndarray, np.ndarray]


def allow(scores: np.ndarray, questions: np.ndarray, labels: list, allowed: dict | None) -> np.ndarray:
    """Scores, without the items whose label a question doesn't admit. allowed: label -> for each question, yes or no."""
    if allowed is None:
        return scores
    no = np.zeros(int(questions.max(initial=-1)) + 1, bool)
    names = sorted(set(labels), key=str)
    code = {v: i for i, v in enumerate(names)}
    table = np.stack([allowed.get(v, no) for v in names])[:, questions] if names else np.zeros((0, len(questions)), bool)
    return np.where(table[[code[v] for v in labels]].T, scores, NOT_LISTED)


def word_blocks(batches: Iterator[pa.RecordBatch], mean: float, k1: float, b: float, allowed: dict | None, floor: np.ndarray | None) -> Iterator[Block]:
    """Blocks of BM25 scores from index rows in the order of their blocks, each block's own row first.

    A block is passed over for the questions whose k-th score so far (`floor`) its maxima don't reach.
    """

    for table in by_block(batches):
        if table.column("token")[0].as_py() is not None or len(table) == 1:
            continue
        ids, sizes, labels = (np.array(table.column(n)[0].as_py(), kind) for n, kind in (("ids", None), ("sizes", np.float64), ("labels", object)))
        lists = table.slice(1)
        idf, high, low = (lists.column(n).to_numpy().astype(np.float64) for n in ("idf", "most", "least"))
        (asking, askers), (places, length), (counts, _) = (flattened(lists.column(n)) for n in ("questions", "places", "counts"))
        of = np.repeat(np.arange(len(lists)), askers)
        if floor is not None:
            reach = np.bincount(asking, (idf * high * (k1 + 1) / (high + k1 * (1 - b + b * low / mean)))[of], len(floor))
        part = np.repeat(idf, length) * counts * (k1 + 1) / (counts + k1 * (1 - b + b * sizes[places] / mean))
        first = np.cumsum(length) - length
        asked = np.unique(asking)
        for start in range(0, len(asked), TOGETHER):
            some = asked[start : start + TOGETHER]
            if floor is not None:  # which rises from block to block
                some = some[reach[some] + 1e-6 >= floor[some]]
            if not len(some):
                continue
            row = np.full(int(asked[-1]) + 1, -1)
            row[some] = np.arange(len(some))
            mine = row[asking] >= 0
            to, lists_of = row[asking[mine]], of[mine]
            total = np.zeros(len(some) * len(ids))
            for lo, hi in cuts(length[lists_of], 1 << 22):  # each posting once for every question of its term
                each = length[lists_of[lo:hi]]
                at = np.repeat(first[lists_of[lo:hi]] - np.cumsum(each) + each, each) + np.arange(int(each.sum()))
                total += np.bincount(np.repeat(to[lo:hi] * len(ids), each) + places[at], part[at], len(total))
            total = total.reshape(len(some), len(ids))
            total = np.where(total > 0, np.round(total, 6), NOT_LISTED)
            yield ids, some, allow(total, some, labels.tolist(), allowed)


def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each block, from rows in the order of their blocks."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        names = batch.column("block").to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(batch)]
        for lo, hi in zip(edges, edges[1:]):
            if held and hi > lo and held[0].column("block")[0].as_py() != names[lo]:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            if hi > lo:
                held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def flattened(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The elements of a list column end to end, and how many each list has."""
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def cuts(sizes: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Cut rows into runs of rows whose sizes add up to about `size`; a larger row makes a run of its own."""
    edges, lo = np.concatenate(([0], np.cumsum(sizes))), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + size, "right")) - 1)
        yield lo, hi
        lo = hi


def vector_blocks(batches: Iterator[pa.RecordBatch], asked: np.ndarray, allowed: dict | None) -> Iterator[Block]:
    """Blocks of cosines of rows (id, label, vector)."""
    for batch in batches:
        batch = batch.filter(batch.column(2).is_valid())
        for start in range(0, len(batch), ROWS):
            rows = batch.slice(start, ROWS)
            ids = np.array(rows.column(0).to_pylist())
            order = np.argsort(ids, kind="stable")
            labels = [rows.column(1)[int(i)].as_py() for i in order]
            x = unit(rows.column(2))[order]
            for lo in range(0, len(asked), TOGETHER):
                some = np.arange(lo, min(lo + TOGETHER, len(asked)))
                yield ids[order], some, allow(np.round(asked[some] @ x.T, 6), some, labels, allowed)


def take_top(blocks: Iterator[Block], k: int, best: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(question numbers, ids, scores) of each block's k best, without those below the k-th best so far; ties to the smaller id."""
    for ids, some, scores in blocks:
        order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        top = np.take_along_axis(scores, order, axis=1)
        best[some] = -np.partition(-np.concatenate((best[some], top), axis=1), k - 1, axis=1)[:, :k]
        good = (top > NOT_LISTED) & (top >= best[some][:, -1:])
        at, place = np.nonzero(good)
        if len(at):
            yield some[at], ids[order[at, place]], top[at, place]


@dataclass
class Batch:
    """Questions that are answered together: their numbers' ids, and whom they admit."""

    names: pa.Array
    allowed: dict | None


class RankedList:
    """A list of (question, item, score) by falling score, ties to the smaller item, for any number of questions.

    Questions are taken `most` at a time: what is sent to the tasks is bounded by that, whatever their number.
    """

    def __init__(self, questions: DataFrame, question: str, item: str, kind: T.DataType, allowed: DataFrame | None, most: int) -> None:
        self.questions, self.question, self.item, self.kind, self.allowed, self.most = questions, question, item, kind, allowed, most
        self.of = questions.schema[question].dataType
        self.arrow = to_arrow_type(kind)

    def batches(self, wanted: DataFrame | None = None) -> Iterator[tuple[Batch, DataFrame]]:
        """Batches of questions, each with its own rows of them (and a column `number`)."""
        rows = self.questions if wanted is None else self.questions.join(wanted.select(self.question).distinct(), self.question, "left_semi")
        n = rows.count()
        labels = self.allowed.select("label").distinct().count() if self.allowed is not None else 1
        passes = max(1, -(-n // max(1, min(self.most, (1 << 22) // max(1, labels)))))
        for i in range(passes):
            part = rows.where(F.pmod(F.xxhash64(self.question), F.lit(passes)) == i)
            names = part.select(self.question).orderBy(self.question).toArrow().column(0).combine_chunks()
            number = {v: j for j, v in enumerate(names.to_pylist())}
            admitted = None
            if self.allowed is not None:
                admitted = {}
                ok = self.allowed.join(part.select(self.question), self.question, "left_semi").select(self.question, "label").toArrow()
                for q, label in zip(ok.column(0).to_pylist(), ok.column(1).to_pylist()):
                    admitted.setdefault(label, np.zeros(len(number), bool))[number[q]] = True
            if len(names):
                pairs = self.questions.sparkSession.createDataFrame(list(number.items()), T.StructType([T.StructField(self.question, self.of), T.StructField("number", T.IntegerType())]))
                yield Batch(names, admitted), part.join(F.broadcast(pairs), self.question)

    def blocks(self, batch: Batch, part: DataFrame) -> tuple[DataFrame, Callable]:
        """(rows of the store, a function from their batches (and floors) to blocks)."""
        raise NotImplementedError

    def top(self, k: int, wanted: DataFrame | None = None) -> DataFrame:
        """(question, item, score, rank): the first k of each question's list."""
        out = None
        schema = T.StructType([T.StructField("_n", T.IntegerType()), T.StructField(self.item, self.kind), T.StructField("score", T.DoubleType())])
        for batch, part in self.batches(wanted):
            rows, blocks = self.blocks(batch, part)
            size = len(batch.names)
            arrow = self.arrow

            def run(batches: Iterator[pa.RecordBatch], blocks=blocks, size=size, arrow=arrow) -> Iterator[pa.RecordBatch]:
                best = np.full((size, k), NOT_LISTED)
                for n, ids, scores in take_top(blocks(batches, best[:, -1]), k, best):
                    yield pa.RecordBatch.from_arrays([pa.array(n, pa.int32()), pa.array(ids.tolist(), arrow), pa.array(scores)], schema.names)

            found = self.named(rows.mapInArrow(run, schema), batch)
            out = found if out is None else out.unionByName(found)
        if out is None:
            out = self.questions.sparkSession.createDataFrame([], T.StructType([T.StructField(self.question, self.of), *schema.fields[1:]]))
        order = Window.partitionBy(self.question).orderBy(F.desc("score"), self.item)
        return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def named(self, rows: DataFrame, batch: Batch) -> DataFrame:
        """Rows with the ids of their questions in place of numbers; there are at most `most` questions."""
        pairs = rows.sparkSession.createDataFrame(list(enumerate(batch.names.to_pylist())), T.StructType([T.StructField("_n", T.IntegerType()), T.StructField(self.question, self.of)]))
        return rows.join(F.broadcast(pairs), "_n").select(self.question, *[c for c in rows.columns if c != "_n"])

    def places(self, pairs: DataFrame) -> DataFrame:
        """(question, item, score, rank) of the pairs (question, item) that are in the list, each pair once."""
        out = None
        schema = T.StructType([T.StructField("_n", T.IntegerType()), T.StructField(self.item, self.kind), T.StructField("score", T.DoubleType())])
        counted = T.StructType([T.StructField("_n", T.IntegerType()), T.StructField("_at", T.IntegerType()), T.StructField("_before", T.LongType())])
        spark = pairs.sparkSession
        for batch, part in self.batches(pairs):
            rows, blocks = self.blocks(batch, part)
            number = {v: i for i, v in enumerate(batch.names.to_pylist())}
            mine = pairs.join(part.select(self.question), self.question, "left_semi").select(self.question, self.item).distinct().toArrow()  # some of each of `most` questions
            wanted: list[set] = [set() for _ in number]
            for q, i in zip(mine.column(0).to_pylist(), mine.column(1).to_pylist()):
                wanted[number[q]].add(i)
            any_of, arrow = np.array(sorted(set().union(*wanted))), self.arrow

            def score(batches: Iterator[pa.RecordBatch], blocks=blocks, wanted=wanted, any_of=any_of, arrow=arrow) -> Iterator[pa.RecordBatch]:
                for ids, some, scores in blocks(batches, None):
                    for at in np.flatnonzero(np.isin(ids, any_of)).tolist():
                        value = ids[at].item() if isinstance(ids[at], np.generic) else ids[at]
                        hit = [j for j, q in enumerate(some.tolist()) if value in wanted[q] and scores[j, at] > NOT_LISTED]
                        if hit:
                            yield pa.RecordBatch.from_arrays([pa.array(some[hit], pa.int32()), pa.array([value] * len(hit), arrow), pa.array(scores[hit, at])], schema.names)

            found = rows.mapInArrow(score, schema).toArrow()
            # each question's candidates in the order of the list
            known = sorted(zip(found.column(0).to_pylist(), found.column(2).to_pylist(), found.column(1).to_pylist()), key=lambda r: (r[0], -r[1], r[2]))
            lists: list[list] = [[] for _ in number]
            for q, s, i in known:
                lists[q].append((s, i))
            spans = [(np.array([s for s, _ in x]), np.array([i for _, i in x])) for x in lists]

            def count(batches: Iterator[pa.RecordBatch], blocks=blocks, spans=spans) -> Iterator[pa.RecordBatch]:
                total = [np.zeros(len(s), np.int64) for s, _ in spans]
                for ids, some, scores in blocks(batches, None):
                    rising = np.sort(scores, axis=1)
                    for j, q in enumerate(some.tolist()):
                        s, of = spans[q]
                        if len(s):
                            right = np.searchsorted(rising[j], s, "right")
                            total[q] += len(ids) - right
                            for x in np.flatnonzero(right > np.searchsorted(rising[j], s, "left")).tolist():
                                total[q][x] += int((scores[j, : np.searchsorted(ids, of[x])] == s[x]).sum())
                n = np.repeat(np.arange(len(total)), [len(t) for t in total])
                at = np.concatenate([np.arange(len(t)) for t in total])
                yield pa.RecordBatch.from_arrays([pa.array(n, pa.int32()), pa.array(at, pa.int32()), pa.array(np.concatenate(total))], counted.names)

            before = rows.mapInArrow(count, counted).groupBy("_n", "_at").agg(F.sum("_before").alias("_before"))
            listed = [(q, at, i, s) for q, x in enumerate(lists) for at, (s, i) in enumerate(x)]
            fields = [*counted.fields[:2], T.StructField(self.item, self.kind), T.StructField("score", T.DoubleType())]
            full = spark.createDataFrame(listed, T.StructType(fields)).join(before, ["_n", "_at"]).withColumn("rank", (F.col("_before") + 1).cast("int"))
            got = self.named(full.select("_n", self.item, "score", "rank"), batch)
            out = got if out is None else out.unionByName(got)
        if out is None:
            out = spark.createDataFrame([], T.StructType([T.StructField(self.question, self.of), *schema.fields[1:], T.StructField("rank", T.IntegerType())]))
        return out


class Words(RankedList):
    """BM25 over a stored index: items that share a word with a question. Statistics are those of the scopes read."""

    def __init__(self, rows: DataFrame, questions: DataFrame, question: str, item: str, text: str = "text", allowed: DataFrame | None = None, k1: float = 1.2, b: float = 0.75, most: int = 4096) -> None:
        super().__init__(questions, question, item, rows.schema["ids"].dataType.elementType, allowed, most)
        self.rows, self.text, self.k1, self.b = rows, text, k1, b
        self.n, words = rows.where("bucket = -1").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
        self.mean = words / self.n if words else 1.0

    def blocks(self, batch: Batch, part: DataFrame) -> tuple[DataFrame, Callable]:
        asked = part.select("number", F.explode(F.array_distinct(tokenize(F.col(self.text)))).alias("token"))
        terms = asked.groupBy("token").agg(F.sort_array(F.collect_list("number")).alias("questions"))
        buckets = [r[0] for r in asked.select(index.bucket_of(F.col("token"))).distinct().collect()]
        lists = self.rows.where(F.col("bucket").isin(buckets)).select("token", "block", "n", "places", "counts", "most", "least")
        # frequencies read just two columns; a frequent term has a row for each block and not for each text
        df = lists.select("token", "n").join(terms.select("token"), "token", "left_semi").groupBy("token").agg(F.sum("n").alias("_df"))
        idf = F.log(1 + (F.lit(self.n) - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
        weighted = terms.join(df, "token").select("token", "questions", idf.alias("idf"))
        none = F.lit(None)
        hits = lists.join(weighted, "token").select("block", "token", "idf", "questions", "places", "counts", "most", "least", none.cast(self.rows.schema["ids"].dataType).alias("ids"), none.cast("array<int>").alias("sizes"), none.cast("array<string>").alias("labels"))
        ints = none.cast("array<int>")
        heads = self.rows.where("bucket = -1").select("block", none.cast("string").alias("token"), none.cast("double").alias("idf"), ints.alias("questions"), ints.alias("places"), ints.alias("counts"), none.cast("int").alias("most"), none.cast("int").alias("least"), "ids", "sizes", "labels")
        tasks = int(heads.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes may be much work, so not fewer tasks
        both = heads.unionByName(hits).repartition(tasks, "block").sortWithinPartitions("block", F.col("token").asc_nulls_first())
        mean, k1, b, allowed = self.mean, self.k1, self.b, batch.allowed
        return both, lambda batches, floor: word_blocks(batches, mean, k1, b, allowed, floor)


class Vectors(RankedList):
    """Cosine over all rows (item, vector[, label]) that have a vector."""

    def __init__(self, rows: DataFrame, questions: DataFrame, question: str, item: str, vector: str = "embedding", label: str | None = None, allowed: DataFrame | None = None, most: int = 4096) -> None:
        super().__init__(questions.where(F.col(vector).isNotNull()), question, item, rows.schema[item].dataType, allowed, most)
        self.rows, self.vector, self.label = rows, vector, label

    def blocks(self, batch: Batch, part: DataFrame) -> tuple[DataFrame, Callable]:
        held = part.orderBy("number").select(F.col(self.vector).cast("array<double>")).toArrow().column(0).combine_chunks()
        shared = part.sparkSession.sparkContext.broadcast(unit(held))
        label = F.col(self.label) if self.label else F.lit(None).cast("string")
        rows = self.rows.select(self.item, label.alias("_label"), F.col(self.vector).cast("array<double>"))
        allowed = batch.allowed
        return rows, lambda batches, floor: vector_blocks(batches, shared.value, allowed)


class Given(RankedList):
    """A list that is written out as rows (question, item, score)."""

    def __init__(self, rows: DataFrame, questions: DataFrame, question: str, item: str) -> None:
        super().__init__(questions, question, item, rows.schema[item].dataType, None, 0)
        order = Window.partitionBy(question).orderBy(F.desc("score"), item)
        self.ranked = rows.select(question, item, "score").withColumn("rank", F.row_number().over(order))

    def top(self, k: int, wanted: DataFrame | None = None) -> DataFrame:
        first = self.ranked.where(F.col("rank") <= k)
        return first if wanted is None else first.join(wanted.select(self.question), self.question, "left_semi")

    def places(self, pairs: DataFrame) -> DataFrame:
        return self.ranked.join(pairs.select(self.question, self.item).distinct(), [self.question, self.item], "left_semi")


def fused_top(lists: list[tuple[RankedList, float]], widths: DataFrame, question: str, item: str, constant: int = 60) -> DataFrame:
    """(question, item, score, rank): the first k by the sum of weight / (constant + rank) over whole lists, 8 places.

    widths are rows (question, k). An item that a list doesn't have gets nothing from it; ties go to the smaller item. Lists are
    read to the depth at which the heavier one alone settles most questions, the candidates' places in the other lists are
    asked for, and questions in which an item below all tops could still reach the k-th score read on at twice the depth.
    """
    most = int(widths.agg(F.coalesce(F.max("k"), F.lit(0))).first()[0])
    if len(lists) == 1:  # whose order is that of the fused scores
        ranked, w = lists[0]
        cut = ranked.top(max(1, most)).join(widths, question).where(F.col("rank") <= F.col("k"))
        return cut.select(question, item, F.round(F.lit(float(w)) / (constant + F.col("rank")), 8).alias("score"), "rank")
    total, heaviest = sum(w for _, w in lists), max(w for _, w in lists)
    depth = max(1, most, int(np.ceil((constant + most) * total / heaviest)) - constant)
    left, out = widths, None
    while True:
        tops = [(ranked.top(depth, left), w) for ranked, w in lists]
        tops = [(settled(df), w) for df, w in tops]
        pairs = reduce(DataFrame.unionByName, [df.select(question, item) for df, _ in tops]).distinct()
        parts, bound = [], None
        for (ranked, w), (df, _) in zip(lists, tops):
            missing = pairs.join(df.select(question, item), [question, item], "left_anti")
            places = df.select(question, item, "rank").unionByName(ranked.places(settled(missing)).select(question, item, "rank"))
            parts.append(places.select(question, item, (F.lit(float(w)) / (constant + F.col("rank"))).alias("_part")))
            # what is below this top has at most the next place, or none where the list has ended
            more = df.groupBy(question).agg(F.when(F.count("*") >= depth, F.lit(w / (constant + depth + 1))).otherwise(0.0).alias("_more"))
            bound = more if bound is None else bound.unionByName(more)
        fused = reduce(DataFrame.unionByName, parts).groupBy(question, item).agg(F.round(F.sum("_part"), 8).alias("score"))
        order = Window.partitionBy(question).orderBy(F.desc("score"), item)
        best = settled(fused.join(left, question).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("k")))
        reach = bound.groupBy(question).agg(F.sum("_more").alias("_more"))
        state = best.groupBy(question).agg(F.count("*").alias("_n"), F.min("score").alias("_last"))
        judged = left.join(reach, question, "left").join(state, question, "left")
        more = F.coalesce("_more", F.lit(0.0))
        final = (more == 0) | ((F.col("_n") >= F.col("k")) & (F.col("_last") > F.round(more, 8) + 1e-8))
        open_ = judged.where(~F.coalesce(final, F.lit(False))).select(*left.columns)
        done = best.join(open_.select(question), question, "left_anti").select(question, item, "score", "rank")
        out = done if out is None else out.unionByName(done)
        open_ = settled(open_)
        if not open_.take(1):
            return out
        left, depth = open_, 2 * depth


def settled(df: DataFrame) -> DataFrame:
    """df, computed once; a lost executor's part is computed again."""
    return df.persist()
