"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import zlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import ann, bm25, ecoc, jaccard, lines, mixing, ordinal, packing, ppm, queries, ring

LONG = "the quick brown fox jumps over the lazy dog again and again\n" * 3000
ROWS = [
    (1, "hello world this is a text", "en", "a", 1),
    (1, "hello world this is a text", "en", "a", 1),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, " \n\t ", "fr", "b", 3),
    (5, LONG, "en", "a", len(LONG)),
    (6, "ça va très bien merci l'été", "fr", "b", 20),
    (7, "hello world this is a text", "en", None, 1),
    (None, "a row without a key", "en", "b", 1),
    (8, "!!! 123 ???", "en", "c", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ["row", "key", "size", "rank", "score", "shard", "block", "kind", "group", "token", "start", "length", "a", "b", "n", "_key", "_text", "_bucket", "_own", "_n"]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.withColumns({c: F.lit("x") for c in EXTRA})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def train():
    return F.col("doc_id").isNotNull()


CASES = {
    "ring": lambda d: ring.shard_rows(d, 4),
    "ppm": lambda d: ppm.score_documents(d, train()),
    "ecoc": lambda d: ecoc.identify(d, train()),
    "packing": lambda d: packing.pack(d, queries.tokenizer()),
    "jaccard": lambda d: jaccard.near_components(d, 3, 90),
    "lines": lambda d: lines.line_groups(d),
}


@pytest.mark.parametrize("name", CASES)
def test_odd_rows(odd, name):
    out = CASES[name](odd).collect()
    if name == "packing":
        assert len({(r["doc_id"], r["start"]) for r in out}) >= 9 and all(r["length"] >= 1 for r in out)
    elif name == "lines":
        assert sum(r["doc_id"] == 5 for r in out) == 3001
        assert sum(r["keep"] for r in out if r["doc_id"] in (1, 7)) == 1
    else:
        assert len(out) == len(ROWS)


@pytest.mark.parametrize("name", CASES)
def test_empty_tables(empty, name):
    assert CASES[name](empty).collect() == []


def test_values_of_odd_rows(odd):
    got = {r["doc_id"]: r for r in CASES["jaccard"](odd).collect()}
    assert got[2]["n_shingles"] == got[3]["n_shingles"] == got[4]["n_shingles"] == 0
    assert got[2]["component_id"] == 2 and got[7]["component_id"] == 1 and got[None]["component_id"] is None
    langs = {r["doc_id"]: r["lang_pred"] for r in CASES["ecoc"](odd).collect()}
    assert langs[2] == langs[3] == langs[4] == langs[8] == "und" and langs[6] == "fr"
    marks = odd.limit(1).withColumn("text", F.explode(F.array(F.lit("½ ②"), F.lit("Ⅷ"), F.lit("_ 7"), F.lit("ñ"))))
    assert sorted(r["lang_pred"] == "und" for r in ecoc.identify(marks.union(odd.where("doc_id = 6")), train()).collect()) == [False, False, True, True, True]
    sizes = {r["doc_id"]: (r["size"], r["text_crc32"]) for r in CASES["ring"](odd).collect()}
    assert sizes[2] == (8, 0) and sizes[6] == (len(ROWS[6][1].encode()) + 8, zlib.crc32(ROWS[6][1].encode()))


def test_classifier_keeps_rows_and_columns(odd, spark):
    ratings = spark.createDataFrame([(1, 2), (1, 0), (5, 2), (6, 1), (8, 0), (9, 2), (3, None), (None, 1), (4, 7)], "doc_id long, grade int")
    out = ordinal.grade_documents(odd, ratings, 3)
    assert out.columns == [*odd.columns, "expected_grade", "tail"] and out.count() == len(ROWS)
    bare = ordinal.grade_documents(odd, ratings.limit(0), 3).collect()
    assert all(r["tail"] == 1 and r["expected_grade"] == 2 for r in bare)
    assert ordinal.grade_documents(odd.limit(0), ratings, 3).count() == 0
    clashing = odd.withColumns({"tail": F.lit("own"), "expected_grade": F.lit(7)})
    out = ordinal.grade_documents(clashing, ratings, 3).collect()
    assert all(r["tail"] == "own" and r["expected_grade"] == 7 and 0 <= r["tail_"] <= 1 and 0 <= r["expected_grade_"] <= 2 for r in out)


def test_mixing_keeps_every_row(odd, empty):
    names = [*mixing.ADDED, "hash", "doc", "key", "_own", "_bucket", "_rank", "rank", "_slot", "_of", "_name", "_start", "_rows"]
    clashing = odd.select(*SCHEMA.replace(",", "").split()[::2]).withColumns({c: F.lit(f"own {c}") for c in names})
    rows = mixing.mix(clashing, {"a": 3.0, "b": 1.0}, block=1).collect()
    assert len(rows) == len(ROWS) and sorted(r["slot_"] for r in rows) == sorted(r["position_"] for r in rows) == list(range(len(ROWS)))
    assert all(r[c] == f"own {c}" for r in rows for c in names)
    assert sorted((r["doc_id"] or -1, r["source"] or "") for r in rows) == sorted((r[0] or -1, r[3] or "") for r in ROWS)
    assert mixing.mix(empty).count() == 0
    assert len(mixing.mix(odd, block=1, most_blocks=4).select("block_").distinct().collect()) <= 4


def test_search_with_odd_rows(odd, empty):
    out = bm25.search(odd, odd.where("doc_id = 1 or doc_id = 2"), k=3).collect()
    assert {r["query_id"] for r in out} == {1}
    assert [r["doc_id"] for r in sorted(out, key=lambda r: r["rank"])] == [1, 1, 7]
    assert bm25.search(empty, empty).count() == 0 and bm25.search(odd, odd.limit(0)).count() == 0


def test_vectors_with_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0, 0.0]), (9, [0.5, 0.5]), (10, [1.0, 2.0, 3.0])]
    x = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1))
    out = ann.search(x, x.where("vec_id < 6"), k=5).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in out] == [(1, 8, 1.0), (1, 9, 0.5)]
    assert ann.search(x.limit(0), x).count() == 0
