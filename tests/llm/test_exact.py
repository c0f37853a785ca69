"""Operators against brute force, on the small test tables."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import ann, bm25, jaccard, kernel, lines, mixing, packing, ppm, queries, ring

SF = "/root/testdata/sf0.001"
ASCII = {i: i + 32 for i in range(65, 91)}


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAbé \n\t.", max_size=30), min_size=1, max_size=6))
def test_words_and_shingles(rows):
    (lo, hi, buf, bounds), = kernel.text_slices(pa.array(rows), 1 << 20)
    h, by, (starts, ends) = kernel.words(buf, bounds)
    data = buf.tobytes()
    seen = {}
    for i, row in enumerate(rows):
        want = split(row)
        got = [data[a:b].decode().translate(ASCII) for a, b in zip(starts[by[i] : by[i + 1]], ends[by[i] : by[i + 1]])]
        assert got == want
        for w, x in zip(want, h[by[i] : by[i + 1]].tolist()):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    for row, s in zip(rows, kernel.shingle_sets(h, by, 3)):
        w = split(row)
        assert len(s) == len({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else ())


def test_hash_table():
    keys = np.random.default_rng(1).integers(1, 2**62, 5000).astype(np.uint64)
    keys = np.unique(keys)
    table = kernel.Table(keys[:100])
    table.add(keys[100:])
    assert (table.find(keys) == np.arange(len(keys))).all() and (table.find(keys + np.uint64(1)) == -1).sum() >= len(keys) - 2


def test_ring_law_and_movement(docs):
    rows = ring.shard_rows(docs, 24, load_factor=1.0).collect()
    shards = collections.defaultdict(list)
    for r in rows:
        shards[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    sizes = [len(shards[s]) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == docs.count()
    more = {r["doc_id"]: r["shard"] for r in ring.shard_rows(docs, 25, load_factor=1.25).collect()}
    less = {r["doc_id"]: r["shard"] for r in ring.shard_rows(docs, 24, load_factor=1.25).collect()}
    assert np.mean([more[d] != less[d] for d in less]) < 0.2


def test_ring_walk_of_every_key(spark):
    """Each key by itself: to the shard of its arc, or clockwise to the first shard with room once those have had theirs."""
    import hashlib
    from bisect import bisect_left

    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    hashed = {r[0]: r[1] for r in docs.select("doc_id", F.xxhash64("doc_id")).collect()}
    for shards, factor in ((7, 1.0), (7, 1.1), (11, 1.3)):
        nodes = sorted((int(hashlib.md5(f"{s}/{r}".encode()).hexdigest()[:4], 16), s) for s in range(shards) for r in range(16))
        cells = [c for c, _ in nodes]
        arc = {d: bisect_left(cells, int(hashlib.md5(str(d).encode()).hexdigest()[:4], 16)) % len(nodes) for d in hashed}
        room = [3000 // shards + (s < 3000 % shards) for s in range(shards)] if factor == 1.0 else [math.ceil(factor * 3000 / shards)] * shards
        want, over = {}, []
        for d in sorted(hashed, key=lambda d: (arc[d], hashed[d], d)):
            s = nodes[arc[d]][1]
            if room[s]:
                room[s] -= 1
                want[d] = s
            else:
                over.append(d)
        for d in over:
            at = arc[d]
            while not room[nodes[at][1]]:
                at = (at + 1) % len(nodes)
            room[nodes[at][1]] -= 1
            want[d] = nodes[at][1]
        got = {r["doc_id"]: r["shard"] for r in ring.shard_rows(docs, shards, replicas=16, load_factor=factor).collect()}
        assert got == want


def test_ring_deals_out_many_copies(spark):
    docs = spark.range(150_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("x").alias("text"))
    sizes = {r["shard"]: (r["n"], r["s"]) for r in ring.shard_rows(docs, 4, load_factor=1.0).groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("s")).collect()}
    assert sizes == {s: (37_500, 37_500) for s in range(4)}


def test_ring_overflow_goes_clockwise():
    nodes = [(10, 0), (20, 1), (30, 2)]
    plan = ring.segments(nodes, {0: 5, 1: 1, 2: 0}, [2, 2, 2])
    placed = collections.Counter()
    for arc, start, shard, slot in plan:
        placed[shard] += 1
    assert [p[:3] for p in plan] == [(0, 0, 0), (1, 0, 1), (0, 2, 1), (0, 3, 2)]


def test_encoder_equals_tokenizer(texts):
    encoder = packing.Encoder(queries.tokenizer(), keep=500)
    odd = ["Don't STOP ½ ²x", "ΑΣ İx", "é ’s", "<|endoftext|> a", " b\x1cc", "", "x" * 5000]
    rows = [*texts.values(), *odd]
    got = []
    for lo, hi, ids, cut in encoder.encode(pa.array(rows), 1 << 14):
        got += np.split(ids, cut[1:-1])
    assert all(np.array_equal(a, b) for a, b in zip(got, encoder.raw(rows), strict=True))


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 63), st.integers(1, 40), max_size=25))
def test_packing_plan(counts):
    used = collections.Counter()
    for lengths, times in packing.plan(counts, 64):
        assert sum(lengths) <= 64 and times >= 1
        for n in lengths:
            used[n] += times
    assert used == collections.Counter(counts)


def best_two_fit(items, capacity):
    """One document at a time: fill a bin with the longest that fit, then replace its smallest by two that fit more tightly."""
    left, bins = sorted(items, reverse=True), []
    while left:
        used, gap = [], capacity
        for n in list(left):
            if n <= gap:
                used.append(n)
                left.remove(n)
                gap -= n
        while gap and used:
            small = used[-1]
            pairs = [(left[i] + left[j], left[i], left[j]) for i in range(len(left)) for j in range(i + 1, len(left)) if small < left[i] + left[j] <= gap + small]
            if not pairs:
                break
            total, a, b = max(pairs)
            used.pop()
            left.remove(a)
            left.remove(b)
            left = sorted([*left, small], reverse=True)
            used = sorted([*used, a, b], reverse=True)
            gap += small - total
        bins.append(used)
    return bins


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 31), max_size=30))
def test_packing_plan_is_best_two_fit(items):
    """The plan over counts makes the bins that packing single documents makes."""
    bins = [sorted(lengths) for lengths, times in packing.plan(dict(collections.Counter(items)), 32) for _ in range(times)]
    assert sorted(bins) == sorted(sorted(b) for b in best_two_fit(items, 32))


def test_packing_replaces_the_smallest_by_two():
    assert sorted(packing.plan({6: 1, 3: 1, 2: 2}, 10)[0][0]) == [2, 2, 6]


def test_packing_round_trip(docs, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer())
    rows = packing.pack(docs, queries.tokenizer()).collect()
    places = collections.defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        ids = [*tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 1][r["start"] : r["start"] + 4096]
        assert len(ids) == r["length"] and zlib.crc32(np.array(ids, "<u4").tobytes()) == r["ids_crc32"]
    for place in places.values():
        end = 0
        for offset, length in sorted(place):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(places) <= 1.02 * math.ceil(sum(r["length"] for r in rows) / 4096) + 1


def test_components_of_near_copies(docs, texts):
    for n, threshold in ((3, 90), (5, 80)):
        sets = {}
        for d, t in texts.items():
            w = split(t)
            sets[d] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
        root = {d: d for d in sets}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        ids = sorted(sets)
        for i, a in enumerate(ids):
            for b in ids[i + 1 :]:
                both = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_components(docs, n, threshold, block=16).collect()}
        assert got == {d: (len(sets[d]), find(d)) for d in ids}


def test_bitmaps_bound_overlaps():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 2**63, 900).astype(np.uint64))
    sets = [np.sort(rng.choice(base, k, replace=False)) for k in (850, 840, 400, 60, 58)]
    maps = [kernel_map.tobytes() for kernel_map in map(jaccard.parity, sets)]
    for threshold in (30, 60, 90):
        keep = set(jaccard.promising([len(s) for s in sets], maps, threshold))
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                both = len(np.intersect1d(a, b))
                if i != j and 100 * both >= threshold * (len(a) + len(b) - both):
                    assert i in keep and j in keep


def test_ppm_against_a_plain_trie():
    learn = ["the cat sat on the mat.", "The Cat sat", "dogs éé run", ""]
    ask = [*learn, "the the theory", "zzz", "é"]
    order = ppm.ORDER

    def raw(t):
        return [ppm.PAD] * order + [b + 32 if 65 <= b <= 90 else b for b in t.encode()] + [ppm.END]

    counts = collections.defaultdict(collections.Counter)
    for t in learn:
        b = raw(t)
        for i in range(order, len(b)):
            for k in range(order + 1):
                counts[tuple(b[i - k : i])][b[i]] += 1

    def plain(t):
        b, total = raw(t), 0.0
        for i in range(order, len(b)):
            out = set()
            for k in range(order, -1, -1):
                n = {x: c for x, c in counts.get(tuple(b[i - k : i]), {}).items() if x not in out}
                if not n:
                    continue
                if b[i] in n:
                    total += math.log10((n[b[i]] - 0.5) / sum(n.values()))
                    break
                total += math.log10(0.5 * len(n) / sum(n.values()))
                out |= set(n)
            else:
                total -= math.log10(ppm.SYMBOLS - len(out))
        return total

    def codes(rows):
        (_, _, buf, bounds), = kernel.text_slices(pa.array(rows))
        return ppm.grams(buf, bounds)

    grams, n = kernel.distinct_counts(codes(learn)[0])
    low, m = kernel.distinct_counts(np.repeat(grams & np.uint64(0xFFFF), n))
    model = ppm.Model(grams, n, low, m)
    code, by = codes(ask)
    assert np.allclose(np.add.reduceat(model.score(code), by[:-1]), [plain(t) for t in ask])
    # a distribution: all symbols after a context add up to one
    context = code[7] >> np.uint64(8) << np.uint64(8)
    everything = model.score(context | np.arange(256, dtype=np.uint64))
    assert abs((10**everything).sum() + 10 ** everything.min() * 1 - 1) < 0.01


def test_ppm_parts_agree(docs):
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0
    one = {r["doc_id"]: r for r in ppm.score_documents(docs, train).collect()}
    many = {r["doc_id"]: r for r in ppm.score_documents(docs, train, hot_words=50, part_grams=10_000).collect()}
    for d, r in one.items():
        assert abs(r["score"] - many[d]["score"]) < 1e-6 and abs(r["base_score"] - many[d]["base_score"]) < 1e-6 and r["n_known"] == many[d]["n_known"]


def test_ppm_base_score(docs, texts):
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in texts}
    count = collections.Counter(w for d, t in texts.items() if not held[d] for w in [*split(t), None])
    total, kinds = sum(count.values()), len(count)
    rows = queries.op2_ppm_score(docs.sparkSession, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        w = [*split(texts[r["doc_id"]]), None]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(w), sum(count[x] > 0 for x in w), total)
        assert abs(r["base_score"] - sum(math.log10((count[x] + 0.1) / (total + 0.1 * (kinds + 1))) for x in w)) < 1e-6
        assert r["score"] < 0


def test_search_is_exact(docs, texts):
    k1, b, k = 1.2, 0.75, 10
    words = {d: collections.Counter(split(t)) for d, t in texts.items()}
    df = collections.Counter(w for c in words.values() for w in c)
    mean = sum(sum(c.values()) for c in words.values()) / len(words)
    found = collections.defaultdict(list)
    for r in bm25.search(docs, docs.where("doc_id % 20 = 0"), k=k, shard=64, block=8, pass_terms=1500).collect():
        found[r["query_id"]].append((r["rank"], r["doc_id"], r["score"]))
    for q in (d for d in texts if d % 20 == 0):
        scores = []
        for d, c in words.items():
            n = sum(c.values())
            s = sum(math.log(1 + (len(words) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * (k1 + 1) / (c[w] + k1 * (1 - b + b * n / mean)) for w in words[q] if w in c)
            if s > 0:
                scores.append((-round(s, 6), d))
        want = sorted(scores)[:k]
        got = sorted(found[q])
        assert [d for _, d in want] == [d for _, d, _ in got]
        assert np.allclose([-s for s, _ in want], [s for _, _, s in got], atol=2e-6)


def test_vector_search_recall(spark):
    x = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = x.collect()
    ids = np.array([r["vec_id"] for r in rows])
    v = np.array([r["embedding"] for r in rows], float)
    hit = total = 0
    got = collections.defaultdict(dict)
    for r in ann.search(x, x.where("vec_id % 20 = 0"), rerank=2, block=128, query_block=8).collect():
        got[r["query_id"]][r["vec_id"]] = r["score"]
    for i in np.flatnonzero(ids % 20 == 0):
        s = v @ v[i]
        s[i] = -np.inf
        top = np.lexsort((ids, -s))[:20]
        hit, total = hit + len(set(ids[top]) & set(got[ids[i]])), total + 20
        assert len(got[ids[i]]) == 20 and all(abs(s[ids.tolist().index(j)] - x) < 1e-9 for j, x in got[ids[i]].items())
    assert hit / total >= 0.9


def test_equal_vectors_tie_by_id(spark):
    rows = [(i, [1.0, 0.0, 0.0, 0.0]) for i in range(200)] + [(i, [0.9, 0.1, 0.0, 0.0]) for i in range(200, 260)]
    x = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = ann.search(x, x.where("vec_id in (0, 5, 250)"), k=20, rerank=1, block=50).orderBy("query_id", "rank").collect()
    by = collections.defaultdict(list)
    for r in out:
        by[r["query_id"]].append(r["vec_id"])
    assert by[0] == list(range(1, 21)) and by[5] == [0, 1, 2, 3, 4, *range(6, 21)] and by[250] == list(range(20))


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_line_groups(spark):
    base = "the mill turns slowly by the old river while farmers bring their grain to be ground into flour for the whole town before winter comes around"
    variants = [base.replace("slowly", f"slowly{c}") for c in "abcdefghijklmnop"]
    rows = [(i, f"{v}\nown line {i} with words {'xyz' * i}") for i, v in enumerate([base, base.upper() + "!", *variants])]
    docs = spark.createDataFrame([*rows, (99, "entirely different words stand in this line here"), (100, "123\n\n456"), (101, "123")], "doc_id long, text string")
    got = {(r["doc_id"], r["line_no"]): (r["first_key"], r["first_line_no"], r["keep"]) for r in lines.line_groups(docs).collect()}
    assert got[1, 0] == (0, 0, False) and got[0, 0] == (0, 0, True)
    assert got[99, 0][2] and got[100, 0][2] and got[101, 0][2]
    # brute force: edit similarity in characters of the normal form, and nothing else
    from itertools import combinations

    form = lambda t: " ".join(w for w in re.split("[\x00-/:-@\\[-`{-\x7f]+", t.lower()) if w)
    text = {(d, i): form(x) for d, t in docs.collect() for i, x in enumerate(t.split("\n")) if re.search("[a-z]", x.lower())}
    root = {k: k for k in text}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in combinations(sorted(text), 2):
        size = max(len(text[x]), len(text[y]))
        if abs(len(text[x]) - len(text[y])) <= size // 10 and edit_distance(text[x], text[y]) <= size // 10:
            a, b = find(x), find(y)
            root[max(a, b)] = min(a, b)
    # the numbered lines are a chain: each is similar to its neighbours only, and all meet in the same places, which is
    # where a link may be lost (see lines.links); all others are exact, and no line is in a group that isn't its own
    chain = {k for k in text if text[k].startswith("own line")}
    assert {k: v[:2] for k, v in got.items() if k in text and k not in chain} == {k: find(k) for k in text if k not in chain}
    assert all(find(got[k][:2]) == find(k) for k in chain)
    near = [(x, y) for x, y in combinations(sorted(chain), 2) if max(len(text[x]), len(text[y])) < lines.SHORT and edit_distance(text[x], text[y]) <= max(len(text[x]), len(text[y])) // 10]
    assert all(got[x][:2] == got[y][:2] for x, y in near)
    left = {r["doc_id"]: r["text"] for r in lines.without_repeats(docs).collect()}
    assert left[1].startswith("own line 1") and left[0] == rows[0][1]


def test_equal_documents_lose_all_lines(spark):
    docs = spark.createDataFrame([(1, "one line of text here\nand a second one"), (1, "one line of text here\nand a second one"), (2, "and a second one")], "doc_id long, text string")
    left = lines.without_repeats(docs).collect()
    assert [(r["doc_id"], r["text"]) for r in left] == [(1, "one line of text here\nand a second one")]


def test_pfair_lag():
    share = mixing.shares({"a": 5, "b": 3, "c": 1.5, "d": 0.5}, 100)
    assert sum(share.values()) == 100
    slots = mixing.period_slots(share)
    assert sorted(t for s in slots.values() for t in s) == list(range(100))
    for s, q in share.items():
        for t in range(100):
            assert abs(sum(x <= t for x in slots[s]) - (t + 1) * q / 100) < 1
        assert all(i * 100 // q <= t < -(-(i + 1) * 100 // q) for i, t in enumerate(slots[s]))


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.integers(1, 60), min_size=1))
def test_pfair_phases_use_every_slot_once(blocks):
    plan = mixing.phases(blocks, {s: float(n) ** 0.5 for s, n in blocks.items()}, 50)
    used = []
    for s, n in blocks.items():
        for k in range(n):
            start, base, period, slots = [p for p in plan[s] if p[0] <= k][-1]
            used.append(base + (k - start) // len(slots) * period + slots[(k - start) % len(slots)])
    assert sorted(used) == list(range(sum(blocks.values())))


def test_mix_positions(docs):
    rows = mixing.mix(docs.select("doc_id", "source"), block=2, buckets=3).collect()
    assert len(rows) == docs.count() and len({r["position"] for r in rows}) == len(rows)
    assert len({(r["slot"]) for r in rows}) == max(r["slot"] for r in rows) + 1
    assert all(len({r["source"] for r in rows if r["slot"] == s}) == 1 for s in range(10))


def test_near_components_in_passes(spark, monkeypatch):
    """Texts are compared in passes of few rows, and the components are those of one pass."""
    rng = random.Random(11)
    base = [[f"w{rng.randrange(400)}" for _ in range(60)] for _ in range(12)]
    rows = [(10 * i + j, " ".join(words[j:])) for i, words in enumerate(base) for j in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = lambda: {r["doc_id"]: r["component_id"] for r in jaccard.near_components(docs, n=3, threshold=90).collect()}
    whole = found()
    passes, take = [], jaccard.bucket
    monkeypatch.setattr(jaccard, "PASS_ROWS", 7)
    monkeypatch.setattr(jaccard, "bucket", lambda *c, buckets: passes.append(buckets) or take(*c, buckets=buckets))
    assert found() == whole == {10 * i + j: 10 * i for i in range(12) for j in range(4)}
    assert len(passes) > 3 and set(passes) == {len(passes)}
