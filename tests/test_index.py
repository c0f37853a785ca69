"""The stored index and ranked lists against scores of all pairs, after updates and with odd rows; fusion against whole lists."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import rank as R
from millrace.functions import text as T
from millrace.operators import index, ranked
from millrace.plans import retrieve

WORDS = "alpha beta gamma delta eta theta iota kappa rho sigma tau phi chi psi omega".split()


def chunks(spark, rng, n, start=0, depts=("a", "b", None)):
    rows = [(f"c{start + i:04d}", " ".join(rng.choices(WORDS, range(15, 0, -1), k=rng.randint(0, 30))) if rng.random() < 0.95 else None, rng.choice(depts), rng.choice(["web", "catalog"])) for i in range(n)]
    return spark.createDataFrame(rows, "chunk_id string, text string, department_id string, content_source string")


def asked(spark, rng, n):
    return spark.createDataFrame([(i, " ".join(rng.sample(WORDS, rng.randint(0, 5)))) for i in range(n)], "q int, text string")


def by_all_pairs(df, questions, k):
    scores = R.bm25_scores(df, questions, chunk="chunk_id", question="q")
    return sorted(map(tuple, R.top(scores, "q", [F.desc("score"), F.col("chunk_id")], k).select("q", "chunk_id", "score", "rank").collect()))


@pytest.mark.parametrize("rows", [1024, 7])
def test_an_index_follows_updates(spark, tmp_path, monkeypatch, rows):
    monkeypatch.setattr(index, "BLOCK_ROWS", rows)
    rng, by = random.Random(rows), ["department_id", "content_source"]
    df, q = chunks(spark, rng, 300).repartition(3).cache(), asked(spark, rng, 25).cache()
    index.write(df, f"{tmp_path}/i", by=by)

    def found(scope=None, most=4096):
        return sorted(map(tuple, ranked.Words(index.read(spark, f"{tmp_path}/i", scope), q, "q", "chunk_id", most=most).top(6).select("q", "chunk_id", "score", "rank").collect()))

    assert found() == found(most=4) == by_all_pairs(df, q, 6)
    assert found({"department_id": "a"}) == by_all_pairs(df.where("department_id = 'a'"), q, 6)
    new = chunks(spark, rng, 60, 1000, ["a"]).where("content_source = 'web'").cache()
    index.write(new, f"{tmp_path}/i", by=by, scope={"department_id": "b", "content_source": "catalog"})
    kept = df.where("not (department_id <=> 'a' and content_source = 'web') and not (department_id <=> 'b' and content_source = 'catalog')")
    assert found() == by_all_pairs(kept.union(new), q, 6)


def test_lists_of_odd_rows(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("b", ""), ("c", "the of"), ("d", "word " * 50_000), ("e", "word"), ("f", "word")], "chunk_id string, text string")
    index.write(df, f"{tmp_path}/i")
    q = spark.createDataFrame([(1, "word"), (2, None), (3, "unheard")], "q int, text string")
    words = ranked.Words(index.read(spark, f"{tmp_path}/i"), q, "q", "chunk_id")
    assert sorted((r["q"], r["rank"], r["chunk_id"]) for r in words.top(5).collect()) == [(1, 1, "d"), (1, 2, "e"), (1, 3, "f")]
    assert [tuple(r)[:2] + (r["rank"],) for r in words.places(spark.createDataFrame([(1, "f"), (1, "a"), (2, "f")], "q int, chunk_id string")).collect()] == [(1, "f", 3)]
    index.write(df.limit(0), f"{tmp_path}/none")
    assert ranked.Words(index.read(spark, f"{tmp_path}/none"), q, "q", "chunk_id").top(5).collect() == []
    assert ranked.Words(index.read(spark, f"{tmp_path}/i"), q.limit(0), "q", "chunk_id").top(5).collect() == []


def test_fusion_is_that_of_whole_lists(spark, tmp_path):
    rng = random.Random(2)
    df, q = chunks(spark, rng, 200, depts=["a"]).cache(), asked(spark, rng, 12)
    vectors = df.select("chunk_id", F.when(F.xxhash64("chunk_id") % 9 != 0, F.array(*[F.round(F.rand(i) * 3) for i in range(3)])).alias("embedding")).cache()
    q = q.withColumn("embedding", F.array(*[F.round(F.rand(9 + i) * 3) for i in range(3)])).cache()
    index.write(df, f"{tmp_path}/i")
    words, near = ranked.Words(index.read(spark, f"{tmp_path}/i"), q, "q", "chunk_id"), ranked.Vectors(vectors, q, "q", "chunk_id")
    widths = q.select("q", (F.col("q") * 9 + 1).alias("k")).cache()
    for weights in ((0.25, 0.75), (0.5, 0.5), (1.0, 0.0001)):
        whole = R.reciprocal_ranks([(words.top(10**4), weights[0]), (near.top(10**4), weights[1])], ["q", "chunk_id"])
        want = R.top(whole.join(widths, "q"), "q", [F.desc("score"), F.col("chunk_id")], F.col("k")).select("q", "chunk_id", "score", "rank")
        got = ranked.fused_top([(words, weights[0]), (near, weights[1])], widths, "q", "chunk_id")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_search_of_a_department(spark, tmp_path):
    df = spark.createDataFrame([("c1", "linear algebra course", "math", "web", "graduate", "faculty"), ("c2", "linear algebra", "cs", "web", "", "faculty"), ("c3", "algebra of graphs", "math", "web", None, None)], "chunk_id string, text string, department_id string, content_source string, level string, chunk_type string")
    q = spark.createDataFrame([(1, "algebra"), (2, "undergraduate algebra")], "question_id int, text string")
    for stored in (None, f"{tmp_path}/i"):
        if stored:
            retrieve.store_index(df, stored)
        got = retrieve.search(q, df, T.as_date("2026-04-24"), department="math", stored=stored).collect()
        assert sorted((r["question_id"], r["chunk_id"]) for r in got) == [(1, "c1"), (1, "c3"), (2, "c3")]
