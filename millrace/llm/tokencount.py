"""Token counts of texts under a byte-level BPE file, by rank-synchronous merging of ragged arrays.

A text is cut at special tokens and then into pre-tokens, as the tokenizer does. Pre-tokens that a process hasn't counted
lately are counted together: their bytes lie end to end in one array of symbols, and every round joins, in each of them at
once, all places of the pair that has the lowest rank there. A pre-token without a pair to join is done, and what is left of
it are its tokens. So the number of rounds is that of the pre-token with the most different merges, whatever their number.

Every document is counted by itself, so nothing is shuffled; a lost executor costs its own tasks again.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import Table, give_back

#: Fixed value: the pattern of byte-level pre-tokenizers.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The same where all characters are below U+0250, in classes that need no tables.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
LATIN_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
BEYOND_LATIN = re.compile("[^\x00-ɏ]")
#: Characters outside these ranges may be of another class in another edition of Unicode, so texts that have some are cut
#: into pre-tokens by the tokenizer's own code: up to Cyrillic, marks and symbols, kana, ideographs, Hangul, pictographs.
UNSURE = re.compile("[^\x00-ԯ‐-⁞←-⏿ぁ-ゖァ-ヾ一-龥가-힣\U0001f300-\U0001f64f]")
#: Between these two characters a text can be cut: no pre-token goes on from a visible character to a blank.
SEAM = re.compile(r"(?<=\S) (?=\S)")
NONE = np.int32(2**31 - 1)


def byte_symbols() -> list[str]:
    """The characters that stand for bytes in the file: printable ones for themselves, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return [chr(b) if b in printable else chr(256 + others.index(b)) for b in range(256)]


class Merges:
    """The merges of a byte-level BPE file: ranks of pairs of symbols and what they join to."""

    def __init__(self, model: dict) -> None:
        vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.bytes = np.array([vocab[c] for c in byte_symbols()], np.int64)
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.joined = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.ranks = Table(self.key(left, right))

    @staticmethod
    def key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return ((left << 32) | right).astype(np.uint64)

    def rank(self, symbols: np.ndarray, at: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Ranks of the pairs that begin at these places; NONE where there is no merge or the place ends a sequence."""
        found = self.ranks.find(self.key(symbols[at], symbols[np.minimum(at + 1, len(symbols) - 1)])).astype(np.int32)
        return np.where((found < 0) | last[at], NONE, found)

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """The number of tokens of each of these non-empty byte strings."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out, of = sizes.copy(), np.arange(len(pieces))
        symbols = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        last = np.zeros(len(symbols), bool)
        last[np.cumsum(sizes) - 1] = True
        ranks = self.rank(symbols, np.arange(len(symbols)), last)
        while len(of):
            starts = np.cumsum(sizes) - sizes
            low = np.minimum.reduceat(ranks, starts)
            on = low < NONE
            if not on.all():  # what has no pair left is counted and goes
                out[of[~on]] = sizes[~on]
                stay = np.repeat(on, sizes)
                symbols, last, ranks = symbols[stay], last[stay], ranks[stay]
                of, sizes, low = of[on], sizes[on], low[on]
                if not len(of):
                    break
            hit = np.flatnonzero(ranks == np.repeat(low, sizes))
            # of places in a row, which are those of a symbol repeated, every second one is joined, from the first on
            fresh = np.concatenate(([True], np.diff(hit) > 1))
            run = np.flatnonzero(fresh)
            hit = hit[(np.arange(len(hit)) - run[np.cumsum(fresh) - 1]) % 2 == 0]
            symbols[hit] = self.joined[ranks[hit]]
            last[hit] = last[hit + 1]
            stay = np.ones(len(symbols), bool)
            stay[hit + 1] = False
            owner = np.searchsorted(np.cumsum(sizes), hit, "right")
            sizes = sizes - np.bincount(owner, minlength=len(sizes))
            symbols, last, ranks = symbols[stay], last[stay], ranks[stay]
            at = hit - np.arange(len(hit))  # where the joined symbols are now
            changed = np.zeros(len(symbols), bool)
            changed[at] = changed[np.maximum(at - 1, 0)] = True
            at = np.flatnonzero(changed)
            ranks[at] = self.rank(symbols, at, last)
        return out


class Counter:
    """Counts the tokens of texts as the library does for this file, with its default for special tokens in texts.

    A process keeps the counts of at most `keep` pre-tokens of up to 64 bytes, and begins anew when they are full.
    """

    def __init__(self, path: str, keep: int = 500_000) -> None:
        from tokenizers import pre_tokenizers

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, before = file["model"], file["pre_tokenizer"] or {}
        wanted = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd or file["normalizer"] or any(before.get(k) != v for k, v in wanted.items()):
            raise ValueError(f"{path} isn't a plain byte-level BPE file")
        if any(t[k] for t in file["added_tokens"] for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError(f"{path} has added tokens that take in what is beside them")
        added = sorted((t["content"] for t in file["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.merges, self.keep, self.known = Merges(model), keep, {}
        self.own = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text without special tokens."""
        if not BEYOND_LATIN.search(text):
            return LATIN_PIECE.findall(text)
        if UNSURE.search(text):
            return [text[a:b] for _, (a, b) in self.own.pre_tokenize_str(text)]
        return PIECE.findall(text)

    def count(self, texts: Iterable[str | None], block: int = 1 << 18) -> list[int]:
        """The number of tokens of each text (null: none), a block of some characters at a time."""
        totals, held, waiting = [], 0, []
        for row, text in enumerate(texts):
            totals.append(0)
            if not text:
                continue
            parts = [text]
            if self.special and self.special.search(text):
                parts = self.special.split(text)
                totals[row] += len(parts) - 1
            for part in parts:
                for piece in blocks(part, block):
                    waiting.append((row, piece))
                    held += len(piece)
                    if held >= 4 * block:
                        self._add(totals, waiting)
                        held, waiting = 0, []
        self._add(totals, waiting)
        return totals

    def _add(self, totals: list[int], waiting: list[tuple[int, str]]) -> None:
        known = self.known
        if len(known) > self.keep:
            known.clear()
        split = [(row, self.pieces(text)) for row, text in waiting]
        new = sorted(set().union(*(p for _, p in split)) - known.keys(), key=len)
        coded = [p.encode() for p in new]
        lo = size = 0
        for hi, piece in enumerate(coded):  # a million bytes at a time, those of like length together
            size += len(piece)
            if size >= 1 << 20 or hi + 1 == len(coded):
                known.update(zip(new[lo : hi + 1], self.merges.count(coded[lo : hi + 1]).tolist()))
                lo, size = hi + 1, 0
        for row, p in split:
            totals[row] += sum(map(known.__getitem__, p))
        for text, piece in zip(new, coded):
            if len(piece) > 64:
                del known[text]


def blocks(text: str, size: int) -> Iterator[str]:
    """The text in parts of about `size` characters, cut where no pre-token is; without such a place it is one part."""
    at = 0
    while len(text) - at > size and (seam := SEAM.search(text, at + size)):
        yield text[at : seam.start()]
        at = seam.start()
    if at < len(text):
        yield text[at:]


def count_tokens(docs: DataFrame, path: str, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row: UTF-8 bytes, tokens by the file at `path`, and if they exceed `limit`.

    `path` names a byte-level BPE file that every worker can read. Whole texts count; a null one is empty, and an empty one
    has no tokens. Rows with a null or repeated key are rows like any other, no rows give no rows, and further columns of
    any name are left out.
    """
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in batches:
            counts = counter.count(x.as_py() for x in batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["key", "bytes", "tokens"])
        give_back()

    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.coalesce(F.octet_length(f"`{text}`"), F.lit(0)).cast("long").alias("bytes"))
    out = rows.mapInArrow(run, T.StructType().add("key", kind).add("bytes", "long").add("tokens", "long"))
    return out.select(F.col("key").alias(key), F.col("bytes").alias("n_bytes"), F.col("tokens").alias("n_tokens"), (F.col("tokens") > limit).alias("over_limit"))
