"""Document scoring by prediction by partial matching (escapes by method D of Howard 1993, with symbol exclusion).

The model is a trie of byte contexts up to `ORDER` bytes, learned from all training documents ("pretrained"). A byte
that was seen after the longest known context gets its share there; else the model escapes to the context without its
first byte, leaving out (excluding) the symbols just ruled out, and so on down to the uniform distribution. Since the
trie is complete (what follows a context follows its suffixes), what is excluded at a context depends only on the next
longer one, so the mass to exclude is one number for each context and whole batches are scored with array lookups.
By method D each symbol of a context gives up half a count to the escape.

All contexts come from the counts of (ORDER + 1)-grams; a text is preceded by ORDER pads and followed by an end symbol.
The grams are split into parts by their last two context bytes, so that a context of two bytes or more has its whole
suffix chain in one part (shorter contexts are few and go along). A part is at most `part_grams` grams on average, is
broadcast by itself, and scores the positions that belong to it; a bigger corpus means more parts, not bigger ones.

Word counts for the unigram baseline work likewise: the `hot_words` most frequent words (a fixed number) are broadcast;
the tokens of all others are joined with their counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import most_frequent, settle
from .kernel import LOWER, U64, Counter, Table, digest, distinct_counts, list_column, signed, text_slices, words

ORDER = 5
#: Bytes that UTF-8 never holds stand for the pad before a text and for its end. 256 byte values and the end.
PAD, END, SYMBOLS = 0xFF, 0xFE, 257
#: The word hash of the end token: no word hashes to it but by accident of 64 bits.
END_WORD = 0x5EED0E0D5EED0E0D
#: Spreads the last two context bytes over the parts of the model.
SPREAD = 0x9E3779B1


def grams(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The (ORDER + 1)-grams of each position of lower-cased texts, end included, and the bounds of the texts in them."""
    rows = len(bounds) - 1
    extra = ORDER + 1
    laid = np.full(len(buf) + extra * rows, PAD, np.uint8)
    begin = bounds + extra * np.arange(rows + 1)
    doc = np.repeat(np.arange(rows), np.diff(bounds))
    laid[np.arange(len(buf)) + extra * doc + ORDER] = LOWER[buf]
    laid[begin[1:] - 1] = END
    wide = laid.astype(U64)
    code = wide[: len(wide) - ORDER].copy()
    for k in range(1, extra):
        code = (code << U64(8)) | wide[k : len(wide) - ORDER + k]
    # window k ends at position k + ORDER, so each text's first ORDER windows but its own first end in the pads
    last = np.ones(len(code) + ORDER, bool)
    for k in range(ORDER):
        last[begin[:-1] + k] = False
    return code[last[ORDER:]], bounds + np.arange(rows + 1)


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of grams (kind 0) and word hashes (kind 1) over a partition's training texts."""
    gram, word = Counter(), Counter()
    for batch in batches:
        for lo, hi, buf, bounds in text_slices(batch.column(0)):
            gram.add(grams(buf, bounds)[0])
            word.add(words(buf, bounds)[0])
            word.add(np.array([END_WORD], U64), np.array([hi - lo]))
    for kind, counter in enumerate((gram, word)):
        keys, counts = counter.merge()
        for a in range(0, len(keys), 100_000):
            k = signed(keys[a : a + 100_000])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(counts[a : a + 100_000])], ["kind", "k", "c"])


class Level:
    """Contexts of one order: totals, distinct symbols and the mass that their symbols have one order below."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, order: int, below: Level | None) -> None:
        keys = grams & U64((1 << (8 * (order + 1))) - 1)
        by = np.argsort(keys, kind="stable")
        keys, counts = keys[by], counts[by]
        at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        self.grams, self.c = keys[at], np.add.reduceat(counts, at) if len(at) else counts
        context = self.grams >> U64(8)
        at = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))) if len(context) else np.zeros(0, np.int64)
        self.contexts = context[at]
        self.kinds = np.diff(np.concatenate((at, [len(context)]))).astype(float)
        self.order, self.out, self.total = order, np.zeros(len(at)), np.zeros(len(at))
        if len(at):
            self.total = np.add.reduceat(self.c, at).astype(float)
        if below is not None and len(at):
            mass = below.c[np.searchsorted(below.grams, self.grams & U64((1 << (8 * order)) - 1))]
            self.out = np.add.reduceat(mass, at).astype(float)

    def find(self, keys: np.ndarray, among: np.ndarray) -> np.ndarray:
        if not len(among):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(among, keys), len(among) - 1)
        return np.where(among[at] == keys, at, -1)


class Model:
    """Levels ORDER..0 for the grams of one part, with counts of orders 1 and 0 over the whole corpus."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, low: np.ndarray, low_counts: np.ndarray) -> None:
        root = Level(low, low_counts, 0, None)
        self.levels = [root, Level(low, low_counts, 1, root)]
        for order in range(2, ORDER + 1):
            self.levels.append(Level(grams, counts, order, self.levels[-1]))
        top = self.levels[-1]
        self.table = Table(top.grams)
        self.seen = np.log10((top.c - 0.5) / np.repeat(top.total, top.kinds.astype(np.int64))) if len(top.grams) else np.zeros(0)

    def score(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of the last symbol of each gram."""
        at = self.table.find(codes)
        out = self.seen[at] if len(self.seen) else np.zeros(len(codes))
        todo = np.flatnonzero(at < 0)
        if len(todo):
            rare, back = np.unique(codes[todo], return_inverse=True)
            out[todo] = self.escaped(rare)[back]
        return out

    def escaped(self, codes: np.ndarray) -> np.ndarray:
        out, left = np.zeros(len(codes)), np.arange(len(codes))
        mass, kinds = np.zeros(len(codes)), np.zeros(len(codes))
        for level in reversed(self.levels):
            keys = codes[left] & U64((1 << (8 * (level.order + 1))) - 1)
            node, entry = level.find(keys >> U64(8), level.contexts), level.find(keys, level.grams)
            known, found = node >= 0, entry >= 0
            free = np.where(known, level.kinds[node] if len(level.kinds) else 0, 0) - np.where(known, kinds[left], 0)
            total = np.where(known, level.total[node] if len(level.total) else 0, 0) - np.where(known, mass[left], 0)
            got = np.flatnonzero(found)
            out[left[got]] += np.log10((level.c[entry[got]] - 0.5) / total[got])
            escape = np.flatnonzero(known & ~found & (free > 0))
            out[left[escape]] += np.log10(0.5 * free[escape] / total[escape])
            down = np.flatnonzero(known & ~found)
            mass[left[down]], kinds[left[down]] = level.out[node[down]], level.kinds[node[down]]
            left = left[~found]
        out[left] -= np.log10(SYMBOLS - kinds[left])
        return out


class Part:
    """What a model part is made of, as it is broadcast; a worker makes the model once and then drops the counts."""

    def __init__(self, *counts: np.ndarray) -> None:
        self.counts, self.made = counts, None

    def model(self) -> Model:
        if self.made is None:
            self.made, self.counts = Model(*self.counts), None
        return self.made


class Unigrams:
    """The most frequent words, as they are broadcast, with the table that a worker makes of them once."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, total: int, kinds: int) -> None:
        self.keys, self.counts, self.total, self.kinds, self.made = keys, counts, total, kinds, None

    def table(self) -> tuple[Table, np.ndarray]:
        if self.made is None:
            value = np.log10((self.counts + 0.1) / (self.total + 0.1 * (self.kinds + 1)))
            self.made = Table(self.keys), np.concatenate((value, [0.0]))
        return self.made


def part_of(codes: np.ndarray, parts: int) -> np.ndarray:
    return (((codes >> U64(8)) & U64(0xFFFF)) * U64(SPREAD) >> U64(7)) % U64(parts)


def score_documents(docs: DataFrame, train: Column, hot_words: int = 1 << 18, part_grams: int = 4_000_000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Score every row: (key, held_out, n_tokens, n_known, train_tokens, base_score, score).

    Training rows are those where `train` holds. score is the model's log10 probability of the whole text (A-Z lower-
    cased, as bytes) and its end. base_score is a unigram score of its words and one end token, with 0.1 added to each
    count; n_known counts tokens with a training count, train_tokens all training tokens. A null text is an empty one.
    Rows keep their number, repeated ones too; an empty table gives none; without training rows every symbol is uniform
    and every word unknown. Other columns are ignored. A null key counts as held out.
    """
    spark = docs.sparkSession
    learn = docs.where(train).select(F.col(text).alias("text"))
    counts = settle(learn.mapInArrow(gathered, "kind int, k long, c long").groupBy("kind", "k").agg(F.sum("c").alias("c")))
    facts = {r["kind"]: r for r in counts.groupBy("kind").agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect()}
    total, kinds = (facts[1]["c"], facts[1]["n"]) if 1 in facts else (0, 0)
    n_grams = facts[0]["n"] if 0 in facts else 0
    parts = max(1, -(-n_grams // part_grams))
    word_counts = counts.where("kind = 1").select("k", "c")
    hot = most_frequent(word_counts, hot_words)
    part = F.shiftrightunsigned(F.shiftrightunsigned("k", 8).bitwiseAND(F.lit(0xFFFF)) * F.lit(SPREAD), 7) % parts
    gram_counts = counts.where("kind = 0").select("k", "c", part.alias("part"))
    low = gram_counts.groupBy(F.col("k").bitwiseAND(F.lit(0xFFFF)).alias("k")).agg(F.sum("c").alias("c")).toArrow()  # 65,536 rows at most
    floor = np.log10(0.1 / (total + 0.1 * (kinds + 1)))
    base = spark.sparkContext.broadcast(Unigrams(hot[0].view(U64), hot[1], total, kinds))

    def part_model(part: int):
        mine = gram_counts.where(F.col("part") == part).select("k", "c").toArrow()
        return spark.sparkContext.broadcast(Part(*(f[c].to_numpy().view(kind) for f in (mine, low) for c, kind in (("k", U64), ("c", np.int64)))))

    def part_scores(model: Model, part: int, buf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        codes, by = grams(buf, bounds)
        if parts == 1:
            return np.add.reduceat(model.score(codes), by[:-1])
        own, out = part_of(codes, parts) == part, np.zeros(len(codes))
        out[own] = model.score(codes[own])
        return np.add.reduceat(out, by[:-1])

    def digests(buf: np.ndarray, bounds: np.ndarray) -> pa.Array:
        return pa.array([digest(buf[a:b]) for a, b in zip(bounds[:-1], bounds[1:])], pa.int64())

    first = part_model(0)

    def main_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (table, value), model = base.value.table(), first.value.model()
        end = table.find(np.array([END_WORD], U64))[0]
        for batch in batches:
            for lo, hi, buf, bounds in text_slices(batch.column(2)):
                h, by, _ = words(buf, bounds)
                at = table.find(h)
                known = at >= 0
                sums = np.concatenate(([0.0], np.cumsum(value[at])))
                hits = np.concatenate(([0], np.cumsum(known)))
                rare = [distinct_counts(h[a:b][~known[a:b]]) for a, b in zip(by[:-1], by[1:])]
                held = np.diff(hits[by]) + int(end >= 0)
                score = np.diff(sums[by]) + (value[end] if end >= 0 else floor)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(k).slice(lo, hi - lo) for k in (0, 1)), digests(buf, bounds), pa.array(np.diff(by) + 1), pa.array(held), pa.array(score),
                        list_column([signed(k) for k, _ in rare], pa.int64()), list_column([n for _, n in rare], pa.int32()), pa.array(part_scores(model, 0, buf, bounds)),
                    ],
                    ["_key", "held_out", "sign", "n_tokens", "n_hot", "hot_score", "rare", "times", "score"],
                )

    base_rows = docs.select(F.col(key).alias("_key"), F.coalesce(~train, F.lit(True)).alias("held_out"), F.col(text).alias("text"))
    kind = dict(docs.dtypes)[key]
    scored = base_rows.mapInArrow(main_pass, f"_key {kind}, held_out boolean, sign long, n_tokens long, n_hot long, hot_score double, rare array<long>, times array<int>, score double")
    scored = settle(scored.withColumn("row", F.monotonically_increasing_id()))
    single = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("t")).select("row", F.col("t.rare").alias("k"), F.col("t.times").alias("n"))
    counted = single.join(word_counts, "k", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    share = F.log10((F.col("c") + 0.1) / F.lit(float(total + 0.1 * (kinds + 1))))
    rest = counted.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"), F.sum(F.col("n") * share).alias("rare_score"))
    scored = scored.drop("rare", "times").join(rest, "row", "left")
    for number in range(1, parts):
        shared = part_model(number)

        def part_pass(batches: Iterator[pa.RecordBatch], shared=shared, number=number) -> Iterator[pa.RecordBatch]:
            model = shared.value.model()
            for batch in batches:
                for lo, hi, buf, bounds in text_slices(batch.column(2)):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), digests(buf, bounds), pa.array(part_scores(model, number, buf, bounds))], ["_key", "sign", "more"])

        # rows of equal key and text have equal scores
        more = base_rows.mapInArrow(part_pass, f"_key {kind}, sign long, more double").groupBy("_key", "sign").agg(F.first("more").alias("more"))
        both = scored["_key"].eqNullSafe(more["_key"]) & (scored["sign"] == more["sign"])
        scored = scored.join(more, both).select(*[scored[c] for c in scored.columns if c != "score"], (scored["score"] + more["more"]).alias("score"))
    return scored.select(
        F.col("_key").alias(key), "held_out", "n_tokens", (F.col("n_hot") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("hot_score") + F.coalesce("rare_score", F.lit(0.0))).alias("base_score"), "score",
    )
