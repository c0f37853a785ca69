"""As-of joins, quantiles, prefixes, batches and page ranges against brute force, with ties, nulls and hot keys."""

import datetime as dt
import random

from pyspark.sql import functions as F

from millrace.operators import layout
from millrace.operators import ordered as O


def day(n):
    return None if n is None else dt.date(2020, 1, 1) + dt.timedelta(n)


def test_next_at(spark):
    rng = random.Random(1)
    key = lambda: rng.choice(["hot"] * 6 + ["a", "b", None])
    left = [(key(), day(rng.choice([None, *range(90)])), i) for i in range(150)]
    left += left[:5]
    right = [(key(), day(rng.choice([None, *range(60)])), i) for i in range(60)]
    a = spark.createDataFrame(left, "k string, d date, i int").repartition(3)
    b = spark.createDataFrame(right, "k string, d date, j int")
    for width in (7 * 86_400, 10**9):
        got = sorted(((r["k"], r["d"], r["i"], r["found"] and tuple(r["found"])) for r in O.next_at(a, b, "d", ["k"], width).collect()), key=str)
        want = []
        for k, d, i in left:
            later = [(x, j) for q, x, j in right if q == k and None not in (k, d, x) and x >= d]
            want.append((k, d, i, (min(later)[0], k, min(later)[1]) if later else None))
        assert got == sorted(want, key=str)
    assert O.next_at(a.limit(0), b, "d", ["k"]).count() == 0 and O.next_at(a, b.limit(0), "d", ["k"]).where("found is not null").count() == 0


def test_quantiles(spark):
    rng = random.Random(2)
    rows = [(g, rng.choice([None, 5.0, rng.gauss(0, 1e6), rng.random()])) for g in ["hot"] * 400 + ["b"] * 30 + [None] * 11 for _ in range(1)] + [("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    for share, bins in ((0.0, 4096), (0.5, 4096), (0.9, 50)):
        got = {r["g"]: r["p90"] for r in O.nearest_rank(df, "v", ["g"], share, bins=bins).collect()}
        some = {g: sorted(v for q, v in rows if q == g and v is not None) for g in {g for g, _ in rows}}
        assert got == {g: v[int(len(v) * share)] for g, v in some.items() if v}
    whole = sorted(v for _, v in rows if v is not None)
    (row,) = O.nearest_rank(df, "v", []).collect()
    assert row["p90"] == whole[int(len(whole) * 0.9)]


def test_prefixes(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("ab/é") for _ in range(rng.randint(0, 7))) for _ in range(120)]
    links, sources = words[:60] + [None], words[60:] + [None]
    got = {r["link"]: (r["longest"], r["begins"]) for r in O.prefix_links(spark.createDataFrame([(x,) for x in links], "link string"), spark.createDataFrame([(x,) for x in sources], "source string")).collect()}
    full = {s for s in sources if s}
    assert got == {x: (max((s for s in full if x.startswith(s)), key=len, default=None), any(s.startswith(x) for s in full)) for x in links if x}


def test_batches_of_one_order(spark):
    rng = random.Random(4)
    for n, rows, most in ((0, 3, 10), (700, 7, 60), (700, 50, 90)):
        keys = sorted(rng.sample(range(-50, 2000), n))
        sizes = [rng.choice([0, 1, 5, 20, 200]) for _ in keys]
        df = spark.createDataFrame(list(zip(keys, sizes)), "k int, s int").repartition(3)
        want, batch, count, total = [], -1, 0, 0
        for k, s in zip(keys, sizes):
            if not count or count == rows or total + s > most:
                batch, count, total = batch + 1, 0, 0
            count, total = count + 1, total + s
            want.append((k, s, batch))
        assert sorted(map(tuple, O.greedy_batches(df, "k", "s", rows, most, width=16, together=4).collect())) == want


def test_page_ranges_of_documents(spark):
    rng = random.Random(5)
    rows = list({(rng.choice(["a", "b", None]), rng.randint(1, 90), f"t{i:03}", float(rng.randint(0, 3)) if i % 9 else None) for i in range(150)})
    want = []
    for doc in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == doc), key=lambda r: r[1:3])
        for i, r in enumerate(own):
            later = [p for _, p, _, x in own[i + 1 :] if None not in (x, r[3]) and x <= r[3]]
            want.append((*r, max(later[0] - 1 if later else own[-1][1], r[1])))
    df = spark.createDataFrame(rows, "doc string, catalog_page int, title string, indent double")
    for segment in (4, 512):
        assert sorted(map(tuple, layout.page_ranges(df, ["doc"], segment).collect()), key=str) == sorted(want, key=str)
