"""Best-two-fit packing of tokenised documents into sequences of a fixed number of tokens.

Documents are tokenised once and cut into pieces only where they are longer than a sequence. Full pieces are sequences
by themselves. The others are items of 1..capacity-1 tokens, and items of equal length are interchangeable, so packing
needs only how many there are of each length: at most capacity-1 numbers, whatever the input. The driver packs those
numbers (see `plan`) into patterns, each with the number of sequences that it makes up, and every item finds its place
by its rank among the items of its length.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import gapless_rank, in_file_order, only, partitions, settle
from .kernel import Table, text_slices, words


def best_two(alive: np.ndarray, counts: np.ndarray, gap: int, more_than: int) -> tuple[int, int] | None:
    """Two unpacked lengths a >= b that fill `gap` most, if they fill more than `more_than`; ties to the longest a."""
    lengths = alive[alive < gap]
    if not len(lengths):
        return None
    # for each a the longest b <= min(a, gap - a)
    limit = np.minimum(lengths, gap - lengths)
    at = np.searchsorted(lengths, limit, "right") - 1
    b = np.where(at >= 0, lengths[np.maximum(at, 0)], 0)
    twin = (b == lengths) & (counts[lengths] < 2)
    lower = np.maximum(at - 1, 0)
    b = np.where(twin, np.where(at >= 1, lengths[lower], 0), b)
    total = np.where(b > 0, lengths + b, 0)
    if total.max() <= more_than:
        return None
    k = len(total) - 1 - int(total[::-1].argmax())
    return int(lengths[k]), int(b[k])


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Best-two-fit over counts by length: [(lengths of a sequence, how many such sequences)].

    A bin is filled greedily with the longest length that still fits. Then its smallest document gives way to two
    unpacked ones that fit the expanded gap more tightly, if there are such, and again until there are none. The bin is
    repeated as long as every length in it lasts, so each step uses up the supply of a length for that many copies, and
    there are at most some ten thousands of steps for any number of documents.
    """
    left = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        left[n] = c
    alive = np.flatnonzero(left)
    out = []
    while len(alive):
        gap, used = capacity, []
        while gap:
            at = int(np.searchsorted(alive, gap, "right")) - 1
            if at < 0:
                break
            n = int(alive[at])
            take = min(gap // n, int(left[n]))
            used += [n] * take
            left[n] -= take
            gap -= take * n
            if not left[n]:
                alive = np.delete(alive, at)
        while gap and used and (two := best_two(alive, left, gap + used[-1], used[-1])):
            small = used.pop()
            left[small] += 1
            gap += small
            for n in two:
                left[n] -= 1
                gap -= n
            used = sorted([*used, *two], reverse=True)
            alive = np.flatnonzero(left)
        need, each = np.unique(used, return_counts=True)
        times = 1 + int((left[need] // each).min())
        left[need] -= each * (times - 1)
        alive = alive[left[alive] > 0]
        out.append((used, times))
    return out


#: The pre-tokenizer's pattern in the file of the tokenizer, over lower-cased letters below U+0180. Texts
#: with other characters, with U+001C..U+001F or U+0085, U+0130, or "<|" (special tokens) are left to the tokenizer itself.
_OTHER = "[^\t\n\r\x0b\x0c -~¡-įı-ſ]|<\\|"
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ſ]+|[0-9²³¹¼-¾]|[^\\sa-zªµºß-öø-ſ0-9²³¹¼-¾]+")


class Encoder:
    """Token ids of texts as flat arrays, equal to the tokenizer's own.

    The tokenizer never looks across white space, nor across the pieces of its pre-tokenizer. So the ids of a text are
    those of its white-space runs, and those of a run are those of its pieces. Runs repeat: a process keeps the ids of
    at most `keep` runs, and of a quarter as many pieces, in arrays behind hash tables (keys are 64-bit hashes; some 100 MB
    at 800,000 runs), and begins anew when they are full. Whole batches are looked up. New
    pieces go to the tokenizer together, as one text; in its vocabulary a token that ends a piece is marked as such, so
    the ids can be told apart again.
    """

    def __init__(self, path: str, keep: int = 800_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.table, self.pieces = Table(), {}
        self.pool, self.edges = np.zeros(1 << 16, "<u4"), np.zeros(1 << 16, np.int64)

    def raw(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def learn(self, hashes: np.ndarray, runs: list[str]) -> None:
        split = [_PIECE.findall(r) for r in runs]
        pieces = self.pieces
        new = list({x for r in split for x in r if x not in pieces})
        if len(pieces) + len(new) > self.keep // 4:
            pieces.clear()
            new = list({x for r in split for x in r})
        if new:
            ids = np.array(self.tokenizer.encode(" ".join(new), add_special_tokens=False).ids, "<u4")
            ends = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            whole = ids.tobytes()
            pieces.update(zip(new, (whole[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())), strict=True))
        found = [b"".join([pieces[x] for x in r]) for r in split]
        flat = np.frombuffer(b"".join(found), "<u4")
        n, used = len(self.table.keys), int(self.edges[len(self.table.keys)])
        self.table.add(hashes)
        while used + len(flat) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        while n + len(runs) + 1 > len(self.edges):
            self.edges = np.concatenate((self.edges, np.zeros_like(self.edges)))
        self.pool[used : used + len(flat)] = flat
        self.edges[n + 1 : n + len(runs) + 1] = used + np.cumsum([len(f) // 4 for f in found])

    def encode(self, texts: pa.Array, limit: int = 1 << 20, rows: int = 512) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, ids, bounds of the rows in them), for runs of rows."""
        for start in range(0, len(texts), rows):  # so that copies of few texts are held at once
            for lo, hi, ids, cut in self.encode_rows(texts.slice(start, rows), limit):
                yield start + lo, start + hi, ids, cut

    def encode_rows(self, texts: pa.Array, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        texts = texts.cast(pa.large_string()).fill_null("")
        odd = pc.match_substring_regex(texts, _OTHER).to_numpy(zero_copy_only=False)  # no other text changes by NFC
        low = pc.utf8_lower(pc.if_else(pa.array(odd), pa.scalar("", pa.large_string()), texts))
        for lo, hi, buf, bounds in text_slices(low, limit):
            h, by, (starts, ends) = words(buf, bounds)
            at = self.table.find(h)
            if (at < 0).any():
                if len(self.table.keys) > self.keep:
                    self.forget()
                    at = np.full(len(h), -1, np.int32)
                miss = np.flatnonzero(at < 0)
                new, first = np.unique(h[miss], return_index=True)
                data = buf.tobytes()
                self.learn(new, [data[a:b].decode() for a, b in zip(starts[miss[first]].tolist(), ends[miss[first]].tolist())])
                at[miss] = self.table.find(h[miss])
            n = self.edges[at + 1] - self.edges[at]
            after = np.concatenate(([0], np.cumsum(n)))
            ids = self.pool[np.repeat(self.edges[at] - after[:-1], n) + np.arange(after[-1])]
            cut = after[by]
            strange = np.flatnonzero(odd[lo:hi])
            if len(strange):
                parts = np.split(ids, cut[1:-1])
                for k, own in zip(strange.tolist(), self.raw(texts.take(pa.array(lo + strange)).to_pylist())):
                    parts[k] = own
                ids, cut = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))
            yield lo, hi, ids, cut


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """One encoder for each worker process, so that what it has learned serves the tasks that follow."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


PIECE = "piece int, start long, length long, ids_crc32 long"


def tokenised(docs: DataFrame, tokenizer: str, capacity: int, end: int, key: str, text: str, position: str | None) -> DataFrame:
    """(key, position, piece, start, length, ids_crc32) of every document; the ids of a document end with `end`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tail = encoder_of(tokenizer), np.array([end], "<u4").tobytes()
        for batch in batches:
            for lo, hi, ids, cut in encoder.encode(batch.column(2)):
                data, rows = ids.tobytes(), []
                for i, (a, b) in enumerate(zip((4 * cut[:-1]).tolist(), (4 * cut[1:]).tolist()), lo):
                    own = data[a:b] + tail
                    rows += [(i, p, s // 4, min(len(own) - s, 4 * capacity) // 4, zlib.crc32(own[s : s + 4 * capacity])) for p, s in enumerate(range(0, len(own), 4 * capacity))]
                at, piece, *rest = (np.array(c, np.int64) for c in zip(*rows))
                at = pa.array(at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(piece.astype(np.int32)), *map(pa.array, rest)], ["_key", "_position", "piece", "start", "length", "ids_crc32"])

    kind = dict(docs.dtypes)[key]
    place = F.col(position) if position else F.lit(0)
    return docs.select(F.col(f"`{key}`").alias("_key"), place.cast("long").alias("_position"), f"`{text}`").mapInArrow(run, f"_key {kind}, _position long, {PIECE}")


def laid(counts: dict[int, int], capacity: int) -> tuple[dict[int, tuple[np.ndarray, ...]], int]:
    """For each length its runs of ranks: (first rank, sequence of that rank, offset); and the number of sequences."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    sequence, taken = 0, dict.fromkeys(counts, 0)
    patterns = [([capacity], counts[capacity])] if capacity in counts else []
    for lengths, times in patterns + plan({n: c for n, c in counts.items() if n < capacity}, capacity):
        offset = 0
        for n in lengths:
            runs.setdefault(n, []).append((taken[n], sequence, offset))
            taken[n] += times
            offset += n
        sequence += times
    return {n: tuple(map(np.array, zip(*r))) for n, r in runs.items()}, sequence


def placed(runs: dict[int, tuple[np.ndarray, ...]], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of items by their lengths and their ranks among items of that length."""
    sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    for n in np.unique(length).tolist():
        at = np.flatnonzero(length == n)
        first, base, own = runs[n]
        k = np.searchsorted(first, rank[at], "right") - 1
        sequence[at], offset[at] = base[k] + rank[at] - first[k], own[k]
    return sequence, offset


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Place every document: (key, piece, start, length, ids_crc32, sequence_id, offset), one row for each piece.

    A document is its token ids and then the id `end`; a null or empty text is that id alone. Documents longer than
    `capacity` are cut into pieces of `capacity` tokens and a rest, all others stay whole. Pieces of a sequence lie end
    to end from offset 0. Repeated rows are packed as often as they occur; a null key is kept. Other columns are
    ignored. An empty table gives no rows. `tokenizer` is the path of a tokenizer file on every executor.
    """
    spark = docs.sparkSession
    pieces = settle(tokenised(only(docs, f"`{key}`", f"`{text}`"), tokenizer, capacity, end, key, text, None))
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    places = spark.sparkContext.broadcast(laid(counts, capacity)[0])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = placed(places.value, batch.column(4).to_numpy(), batch.column(6).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:6], *map(pa.array, found)], [key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = gapless_rank(pieces, ["length"], ["_key", "piece", "ids_crc32"], partitions(spark), "_rank")
    return ranked.mapInArrow(place, f"`{key}` {dict(docs.dtypes)[key]}, {PIECE}, sequence_id long, offset long")


def pack_in_order(docs: DataFrame, tokenizer: str, capacity: int = 4096, end: int = 1, window: int = 65_536, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As `pack`, for documents whose order in their files counts: each `window` of them is packed by itself.

    Sequences are numbered by window, and in a window by the first document that they hold; so reading them in order
    reads the documents in order, but for moves within a window. A window is one task's work, whatever the table's size.
    """
    pieces = settle(tokenised(in_file_order(docs, key, text), tokenizer, capacity, end, key, text, "position"))
    kind = dict(docs.dtypes)[key]
    names = ["_key", "piece", "start", "length", "ids_crc32"]

    def arrange(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("_position", "ascending"), ("piece", "ascending")])
        length, position = rows.column("length").to_numpy(), rows.column("_position").to_numpy()
        by = np.argsort(length, kind="stable")
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by)) - np.searchsorted(length[by], length[by])
        sizes, counts = np.unique(length, return_counts=True)
        sequence, offset = placed(laid(dict(zip(sizes.tolist(), counts.tolist())), capacity)[0], length, rank)
        # rows are in order, so the first row of each sequence is its first document
        _, first, back = np.unique(sequence, return_index=True, return_inverse=True)
        order = np.empty(len(first), np.int64)
        order[np.argsort(first, kind="stable")] = np.arange(len(first))
        return pa.table([*(rows.column(c) for c in names), pa.array(position // window), pa.array(order[back]), pa.array(offset)], [*names, "_window", "_sequence", "offset"])

    own = pieces.groupBy(F.floor(F.col("_position") / window)).applyInArrow(arrange, f"_key {kind}, {PIECE}, _window long, _sequence long, offset long")
    own = settle(own)
    sizes = own.groupBy("_window").agg((F.max("_sequence") + 1).alias("n"))  # a row for each window
    before = Window.orderBy("_window").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_window", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    return own.join(starts, "_window").select(F.col("_key").alias(key), *names[1:], (F.col("_start") + F.col("_sequence")).alias("sequence_id"), "offset")
