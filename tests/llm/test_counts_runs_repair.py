"""Token counts, periodic runs and repaired conversations against the library and brute force; odd rows and empty tables."""

import hashlib
import random
import re
import zlib
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from millrace.llm import periodic, queries, repair, tokencount

SF = "/root/testdata/sf0.001"
PATH = queries.tokenizer("byte_bpe_50k.json")
LONG = "the quick brown fox jumps over the lazy dog again and again\n" * 3000
ODD = [(1, "Hello world, it's  1st ½ day"), (1, "Hello world, it's  1st ½ day"), (2, None), (3, ""), (4, " \n\t "), (5, LONG), (None, "no key <|endoftext|><|endoftext|>"), (6, "x" * 5000), (7, "字カ한😀ʯՠ\U00011de1 é")]


@pytest.fixture(scope="module")
def odd(spark):
    names = ["key", "bytes", "tokens", "n_tokens", "runs", "origin", "period", "text_", "conv", "letter", "said"]
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumns({c: F.lit("x") for c in names})


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda texts: [len(e.ids) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


# token counts


def test_counts_of_random_texts(library):
    rng = random.Random(3)
    texts = ["".join(rng.choice("aaabbc  \n\t 'sdtll1②½字 한カ😀.!-_\x1c\x85ļ́՘\U00011de1") for _ in range(rng.randint(0, 150))) for _ in range(1500)]
    texts += ["a" * 3000, "ab" * 900, " " * 333, "<|endoftext|>a<|endoftext|><|endoftext|> b<|endo", "'s" * 40, None, ""]
    assert tokencount.Counter(PATH).count(texts) == library(texts)
    assert tokencount.Counter(PATH, keep=10).count(texts, block=7) == library(texts)


def test_classes_of_characters():
    """Where the patterns are used they cut as the tokenizer's own code does, for every character that they may meet."""
    own, counter = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True), tokencount.Counter(PATH)
    sure = [c for c in map(chr, range(0x110000)) if not "\ud800" <= c <= "\udfff" and not tokencount.UNSURE.search(c)]
    for at in range(0, len(sure), 2000):
        text = " ".join(f"a{c} 1{c} !{c}{c}" for c in sure[at : at + 2000])
        assert counter.pieces(text) == [text[a:b] for _, (a, b) in own.pre_tokenize_str(text)]


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        tokencount.Counter(queries.tokenizer("word_bpe_49k.json"))


def test_counts_of_documents(spark, odd, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in queries.op11_rank_synchronous(spark, SF).collect()}
    for r, n in zip(docs, library([r["text"] for r in docs]), strict=True):
        size = len((r["text"] or "").encode())
        assert tuple(got[r["doc_id"]]) == (r["doc_id"], size, n, n > 1024)
    got = [tuple(r) for r in tokencount.count_tokens(odd, PATH, 1024).collect()]
    want = [(k, len((t or "").encode()), n, n > 1024) for (k, t), n in zip(ODD, library([t for _, t in ODD]))]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert tokencount.count_tokens(odd.limit(0), PATH, 1024).collect() == []


# periodic runs


def runs_by_brute_force(x, least):
    got = {}
    for p in range(1, len(x) // 2 + 1):
        i = 0
        while i + p < len(x):
            j = i
            while j + p < len(x) and x[j] == x[j + p]:
                j += 1
            if j - i + p >= max(least, 2 * p):
                got.setdefault((i, j + p), p)
            i = j + 1
    return sorted((s, e - s, p) for (s, e), p in got.items())


@pytest.mark.parametrize("least", [2, 3, 5, 8, 12, 13])
def test_runs(least):
    rng = random.Random(least)
    for _ in range(250):
        texts = []
        for _ in range(rng.randint(1, 5)):
            n, p, q = rng.randint(0, 70), rng.randint(1, 12), rng.randint(1, 5)
            base = [rng.randrange(q) for _ in range(n)]
            texts.append(base if rng.random() < 0.5 else [base[i % min(p, n)] if rng.random() < 0.98 else 9 for i in range(n)])
        ids, bounds = np.array(sum(texts, []), np.int32), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        assert [[tuple(r) for r in x.tolist()] for x in periodic.runs_of(ids, bounds, least)] == [runs_by_brute_force(t, least) for t in texts]


def test_runs_where_hashes_would_fail():
    thue = [0]
    while len(thue) < 1024:
        thue += [1 - x for x in thue]
    ids = np.array([*thue, *thue[::-1], *thue], np.int32)
    got = periodic.runs_of(ids, np.array([0, len(ids)]), 12)[0].tolist()
    assert [tuple(r) for r in got] == runs_by_brute_force(ids.tolist(), 12)


def expected_runs(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = runs_by_brute_force(words, 12)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    s, k, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    return (doc_id, len(runs), s, k, q, k and 1000 * k // q, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_of_documents(spark):
    docs = [r for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect() if len(r["text"] or "") < 12_000]
    got = {r["doc_id"]: tuple(r) for r in queries.op12_periodic_runs(spark, SF).collect()}
    assert len(docs) > 150 and sum(got[r["doc_id"]][1] > 0 for r in docs) > 10
    for r in docs:
        assert got[r["doc_id"]] == expected_runs(r["doc_id"], r["text"])


def test_runs_of_odd_rows(odd, spark):
    got = sorted(map(tuple, periodic.find_runs(odd).collect()), key=str)
    assert len(got) == len(ODD)
    rows = {r[0]: r for r in got}
    assert rows[2][1:] == rows[3][1:] == rows[4][1:] == (0, "", []) and rows[None][1] == 3
    assert [tuple(r) for r in rows[5][3]] == [(0, 36000, 12)] and rows[5][2] == LONG.split("\n")[0]
    assert periodic.find_runs(odd.limit(0)).collect() == []


# repaired conversations

NEXT = {0: "u", 1: "u", 2: "a", 3: "u"}


def cheapest(turns):
    """(cost, audit) of turns (initial, fault) by trying every edit at every place, with whole strings compared."""

    def step(state, role):
        return {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(role, {}).get(state)

    @cache
    def best(i, state, inserted):
        found = [(0, "")] if i == len(turns) and state in (0, 3) else []
        if inserted < 3:
            c, a = best(i, step(state, NEXT[state]), inserted + 1)
            found.append((c + 2, "I" + a))
        if i < len(turns):
            role, fault = turns[i]
            late = fault == "truncated"
            c, a = best(i + 1, state, 0)
            found.append((c + 3, "D" + a))
            if fault not in ("blank", "duplicate"):
                c, a = best(i + 1, step(state, NEXT[state]), 0)
                found.append((c + 2 + late, "R" + a))
                if step(state, role) is not None:
                    c, a = best(i + 1, step(state, role), 0)
                    found.append((c + late, "K" + a))
        return min(found, default=(10**9, ""))

    return best(0, 0, 0)


def expected_repairs(rows):
    """conv -> the row, of (conv, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            turns += [(turn, "user" if kind == 4 else role, text)] * (kind > 0) * (1 + (kind == 3))
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.md5(t[2].encode()).hexdigest()))
        faults = []
        for i, (_, role, text) in enumerate(turns):
            seen = re.findall(r"[^\x20\x09-\x0D]", text)
            again = any(t[1:] == (role, text) for t in turns[:i])
            faults.append("blank" if not seen else "duplicate" if again else "" if seen[-1] in ".!?" else "truncated")
        numbers = {t[0] for t in turns if t[0] is not None}
        cost, audit = cheapest(tuple((t[1][:1], f) for t, f in zip(turns, faults)))
        state, lines, todo = 0, [], iter(turns)
        for edit in audit:
            role, text = ("", "") if edit == "I" else next(todo)[1:]
            if edit != "D":
                role = role if edit == "K" else {"u": "user", "a": "assistant"}[NEXT[state]]
                state = {"s": 1, "u": 2, "a": 3}[role[0]]
                lines.append(f"{role}:{text}")
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(turns, turns[1:])]
        out[conv] = (
            conv, max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def test_shared_layers_give_the_cheapest_edits():
    rng = random.Random(5)
    layers, last = [repair.begin()], ""
    many = sorted({"".join(rng.choice("suaxSUAXd") for _ in range(rng.randint(0, 9))) for _ in range(1500)})
    for signature in many:
        shared = repair.common(last, signature)
        assert signature[:shared] == last[:shared] and signature[shared : shared + 1] != (last[shared : shared + 1] or None)
        del layers[shared + 1 :]
        for letter in signature[shared:]:
            layers.append(repair.follow(layers[-1], letter))
        turns = tuple((c.lower(), "blank" if c == "d" else "truncated" if c.isupper() else "") for c in signature)
        assert repair.answer(layers) == cheapest(turns)
        last = signature


def test_repairs_of_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r) for r in queries.op13_trie_repair(spark, SF).collect()}
    assert got == expected_repairs(rows)


def test_repairs_of_odd_conversations(spark, tmp_path):
    rng = random.Random(8)
    texts = [None, "", " \n", "a.", "b", "c?", "d!", "é ", "e.\x0b", "\xa0"]
    roles = ["user", "user", "assistant", "assistant", "system", "tool", "", None, "User"]
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts)) for _ in range(500)]
    rows += rows[:50] + [(99, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(120)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("conv", "letter", "said", "alive", "copy", "fault")})
    df.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: tuple(r) for r in queries.op13_trie_repair(spark, str(tmp_path)).collect()}
    assert got == expected_repairs(rows)
    plain = repair.repair(repair.turns_of(df.where("conv_id = 99")))
    assert [tuple(r)[:8] for r in plain.collect()] == [(99, 0, 0, 0, 0, 0, 0, "K" * 120)]
    assert repair.repair(repair.turns_of(df.limit(0))).collect() == []
