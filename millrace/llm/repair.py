"""Repair of the structure of conversations: the cheapest edits after which roles alternate, by DP over a shared trie.

A conversation is a row of turns, each with a role and maybe a fault. Edits keep a turn (K), give it the role user or
assistant (R), delete it (D) or insert an empty turn (I), so that the roles read `(s?(ua)+)?`: nothing, or a system turn
or none and then user and assistant in turn. What edits cost depends on each turn's role and fault alone, a letter of
its conversation's signature. Few signatures differ and many share a beginning, so the distinct ones are sorted by Spark
into ranges, and a task goes through its range as through a trie: of each signature it keeps the DP layers of the
letters that it shares with the next one, computes the others, and reads the answer off at the end.

Texts are shuffled once, in pieces as small as a turn: they are sorted behind the edits of their conversation, and a task
writes the repaired conversation into a running hash. A lost executor costs its own tasks again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .frames import settle

BLANK = " \t\n\x0b\x0c\r"
#: Costs of the edits, and of leaving a truncated turn.
RELABEL, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States of `(s?(ua)+)?`: nothing yet, a system turn, a user turn that waits for its answer, an answer.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
#: The only role that an inserted or relabelled turn can have in a state.
NEXT = ("u", "u", "a", "u")
ENDS = (0, 3)
#: A layer: for each state that can be reached, (cost, rank of its edits among those of the layer, state before, edits since).
Layer = dict[int, tuple[int, int, int, str]]


def begin() -> Layer:
    """The layer before the first turn."""
    return {0: (0, 0, -1, "")}


def inserts(layer: Layer) -> Iterator[tuple[int, int, int, str, int]]:
    """(cost, rank, state, inserts, state behind them): more than two inserts only come back to a state at a higher cost."""
    for state, (cost, rank, _, _) in layer.items():
        now = state
        for n in range(3):
            yield cost + n * INSERT, rank, state, "I" * n, now
            now = STEP[now, NEXT[now]]


def follow(layer: Layer, letter: str) -> Layer:
    """The layer after one more turn. Letters: s, u, a, x (another role), the same in upper case if truncated, d to be deleted.

    Edits that lead to different states of a layer all end with what was done to its turn, so none of them begins with all
    of another, and the order of two continuations is that of their ranks, then that of the edits since. So ranks and the
    state before are all that is kept of the edits.
    """
    best: dict[int, tuple[int, int, str, int]] = {}
    role, extra = letter.lower(), TRUNCATED * letter.isupper()
    for cost, rank, state, put, now in inserts(layer):
        ways = [("D", DELETE, now)]
        if letter != "d":
            ways.append(("R", RELABEL + extra, STEP[now, NEXT[now]]))
            if (now, role) in STEP:
                ways.append(("K", extra, STEP[now, role]))
        for edit, price, to in ways:
            way = (cost + price, rank, put + edit, state)
            if to not in best or way < best[to]:
                best[to] = way
    ranks = {to: i for i, (_, to) in enumerate(sorted(((rank, edits), to) for to, (_, rank, edits, _) in best.items()))}
    return {to: (cost, ranks[to], state, edits) for to, (cost, _, edits, state) in best.items()}


def answer(layers: list[Layer]) -> tuple[int, str]:
    """The cost and the edits of the cheapest repair; of several the first in the order of ASCII."""
    cost, _, put, state = min((c, r, put, state) for c, r, state, put, now in inserts(layers[-1]) if now in ENDS)
    edits = [put]
    for layer in reversed(layers[1:]):
        _, _, before, since = layer[state]
        edits.append(since)
        state = before
    return cost, "".join(reversed(edits))


def repairs(signatures: DataFrame) -> DataFrame:
    """(signature, cost, audit) of each distinct signature of a column of that name; the work is in the letters that sorted
    neighbours don't share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layers, last = [begin()], ""
        for batch in batches:
            rows = []
            for signature in batch.column(0).to_pylist():
                shared = common(last, signature)
                del layers[shared + 1 :]
                for letter in signature[shared:]:
                    layers.append(follow(layers[-1], letter))
                rows.append((signature, *answer(layers)))
                last = signature
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.string()))], ["signature", "cost", "audit"])

    distinct = signatures.select("signature").distinct()
    return distinct.repartitionByRange("signature").sortWithinPartitions("signature").mapInArrow(run, "signature string, cost long, audit string")


def common(a: str, b: str) -> int:
    """How many letters two strings share at their beginnings."""
    if b.startswith(a):
        return len(a)
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return lo


MEASURES = ["gaps", "blank", "duplicate", "truncated", "illegal"]


def signatures(rows: DataFrame) -> DataFrame:
    """(conv, signature, and counts by MEASURES) of rows (conv, turn, role, letter, fault, alive) partitioned by conv and sorted.

    A task reads the rows in order and holds one conversation's letters at a time.
    """
    fields = [T.StructField("conv", rows.schema["conv"].dataType), T.StructField("signature", T.StringType()), *[T.StructField(m, T.LongType()) for m in MEASURES]]
    schema = T.StructType(fields)
    legal = {"su", "ua", "au"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in fields]
        now, open_ = None, False
        letters, faults, illegal, before = [], [0, 0, 0], 0, None
        first = last = None
        turns = 0

        def close() -> tuple:
            gaps = 0 if first is None else last - first + 1 - turns
            return (now, "".join(letters), gaps, *faults, illegal)

        for batch in batches:
            done = []
            for conv, turn, role, letter, fault, alive in zip(*(batch.column(n).to_pylist() for n in ("conv", "turn", "role", "letter", "fault", "alive"))):
                if not open_ or conv != now:
                    if open_:
                        done.append(close())
                    now, open_ = conv, True
                    letters, faults, illegal, before = [], [0, 0, 0], 0, None
                    first = last = None
                    turns = 0
                if not alive:
                    continue
                letters.append(letter)
                if fault:
                    faults[fault - 1] += 1
                illegal += before is not None and before + role not in legal
                before = role
                if turn is not None:
                    turns += turn != last
                    first, last = turn if first is None else first, turn
            yield table(done, schema, names)
        if open_:
            yield table([close()], schema, names)

    return rows.mapInArrow(run, schema)


def table(rows: list[tuple], schema: T.StructType, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, to_arrow_type(schema[n].dataType)) for c, n in zip(columns, names)], names)


def hashes(rows: DataFrame) -> DataFrame:
    """(conv, audit, counts, repaired_sha256) of rows sorted within a conversation: its audit first and then its turns.

    A turn is (conv, role, text), the audit's row has the counts as well. One turn is held at a time, whatever a conversation's size.
    """
    fields = [rows.schema[c] for c in ("conv", "audit", *MEASURES, "cost")]
    schema = T.StructType([*fields, T.StructField("repaired_sha256", T.StringType())])
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, digest, place, state, wrote = None, None, 0, 0, False

        def write(text: str) -> None:
            nonlocal wrote
            digest.update((("\n" if wrote else "") + text).encode())
            wrote = True

        def insert() -> None:
            nonlocal place, state
            while head[1][place : place + 1] == "I":
                write(ROLES[NEXT[state]] + ":")
                place, state = place + 1, STEP[state, NEXT[state]]

        def close() -> tuple:
            insert()
            return (*head, digest.hexdigest())

        for batch in batches:
            done = []
            columns = {n: batch.column(n).to_pylist() for n in (*names[:-1], "role", "text")}
            for i, audit in enumerate(columns["audit"]):
                if audit is not None:
                    if head is not None:
                        done.append(close())
                    head = tuple(columns[n][i] for n in names[:-1])
                    digest, place, state, wrote = hashlib.sha256(), 0, 0, False
                    continue
                insert()
                edit, role = head[1][place], columns["role"][i]
                place += 1
                if edit == "D":
                    continue
                if edit == "R":
                    role = ROLES[NEXT[state]]
                state = STEP[state, role[:1]]
                write(f"{role}:{columns['text'][i]}")
            yield table(done, schema, names)
        if head is not None:
            yield table([close()], schema, names)

    return rows.mapInArrow(run, schema)


#: The roles that inserted and relabelled turns get.
ROLES = {"u": "user", "a": "assistant"}


def damage(turns: DataFrame, key: Column) -> DataFrame:
    """(conv, turn, role, text, alive) of turns with planted faults: by `key` % 20 a turn is dropped (0), loses its text (1)
    or its stops (2), comes twice (3) or gets the role user (4). A dropped turn stays as a row that isn't alive."""
    kind = key % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    rows = turns.select("conv", "turn", role.alias("role"), text.alias("text"), (kind != 0).alias("alive"), F.explode(F.sequence(F.lit(0), (kind == 3).cast("int"))).alias("copy"))
    return rows.drop("copy")


def turns_of(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text) of the conversations; a null role or text is one space."""
    some = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")).alias(a) for c, a in ((role, "role"), (text, "text"))]
    return conversations.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), *some)


def repair(turns: DataFrame) -> DataFrame:
    """Faults and cheapest repair of each conversation of turns (conv, turn, role, text[, alive]).

    Turns are taken by `turn`, nulls first; those of one number by role, then by a digest of the text, equal ones as they
    are. A turn's first fault counts: blank (nothing but white space), duplicate (role and text came before), truncated (the
    last visible character is not one of .!?). Keep costs nothing, a new role 2, to delete 3, to insert an empty turn 2, and
    a truncated turn that stays 1 more; blank and duplicate turns must go. Where no turn is alive, all counts are 0, the
    audit is empty and the hash that of nothing.

    Returns (conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conv, a null one
    included: gaps are numbers missing between the least and the greatest turn (nulls aside), illegal counts neighbours whose
    roles' initials aren't su, ua or au, audit names the edits in order (ties: least in ASCII), and the hash is that of
    the repaired conversation's `role:text` lines. A role without characters has no legal initial. No turns give no rows.
    """
    if "alive" not in turns.columns:
        turns = turns.withColumn("alive", F.lit(True))
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "said"]
    rows = turns.select("conv", "turn", "role", "text", "alive", F.md5(F.col("text").cast("binary")).alias("said"))
    seen = F.rtrim("text", F.lit(BLANK))
    light = rows.select("conv", "turn", "role", "said", "alive", (seen == "").alias("empty"), F.right(seen, F.lit(1)).isin(".", "!", "?").alias("whole")).repartition("conv")
    earlier = F.row_number().over(Window.partitionBy("conv", "role", "said", "alive").orderBy(F.col("turn").asc_nulls_first())) > 1
    fault = F.when(F.col("empty"), 1).when(F.col("again"), 2).when(~F.col("whole"), 3).otherwise(0)
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    letter = F.when(F.col("fault").isin(1, 2), "d").when(F.col("fault") == 3, F.upper(known)).otherwise(known)
    marked = light.withColumn("again", earlier).withColumn("fault", fault).withColumn("letter", letter).withColumn("initial", initial)
    read = settle(signatures(marked.sortWithinPartitions(*order, "again").select("conv", "turn", F.col("initial").alias("role"), "letter", "fault", "alive")))
    heads = read.join(repairs(read), "signature")

    none = F.lit(None)
    counts = [*MEASURES, "cost"]
    texts = rows.where("alive").select("conv", F.lit(1).alias("part"), "turn", "role", "said", "text", none.cast("string").alias("audit"), *[none.cast("long").alias(c) for c in counts])
    empty = [none.cast(texts.schema[c].dataType).alias(c) for c in ("turn", "role", "said", "text")]
    both = texts.unionByName(heads.select("conv", F.lit(0).alias("part"), *empty, "audit", *counts))
    sorted_ = both.repartition("conv").sortWithinPartitions("conv", "part", *order[1:])
    return hashes(sorted_).select("conv", *counts, "audit", "repaired_sha256")
