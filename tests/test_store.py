"""Chunks from ingest to search: stored with vectors and index, replaced by scope, searched by words and vectors."""

import numpy as np

from millrace.functions import text as T
from millrace.operators import versions
from millrace.plans import ingest, retrieve

DAY = T.as_date
FIELDS = "chunk_id string, text string, department_id string, content_source string, level string, chunk_type string"


def test_store_and_search(spark, tmp_path):
    path, day = f"{tmp_path}/s", DAY("2026-04-24")
    letters = lambda texts: [[float(t.count(c)) + 0.25 for c in "aeioust"] for t in texts]
    words = "algebra graphs optics waves theory of light sound numbers sets".split()
    rows = [(f"c{i:02}", " ".join(words[(i * k) % 10] for k in range(1, 6)), "math", "web" if i % 2 else "catalog", ["", "graduate"][i % 2], "faculty") for i in range(30)]
    df = spark.createDataFrame(rows, FIELDS)
    for source in ("web", "catalog"):
        ingest.store(df, path, "math", source, letters)
    asked = spark.createDataFrame([(1, "graphs and light"), (2, "undergraduate optics"), (3, "of the")], "question_id int, text string")
    got = sorted((r["question_id"], r["rank"], r["chunk_id"], r["hybrid_score"]) for r in retrieve.search_stored(asked, path, day, "math", letters).collect())
    # the same by a list of all pairs
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    q = {r["question_id"]: unit(letters([r["rewritten"]])[0]) for r in retrieve.prepared(asked, day).collect()}
    pairs = [(i, r[0], round(float(v @ unit(letters([r[1]])[0])), 6)) for i, v in q.items() for r in rows]
    vectors = spark.createDataFrame(pairs, "question_id int, chunk_id string, score double")
    want = sorted((r["question_id"], r["rank"], r["chunk_id"], r["hybrid_score"]) for r in retrieve.search(asked, df, day, vectors=vectors).collect())
    assert got == want and {g[0] for g in got} == {1, 2, 3}
    assert all(int(c[1:]) % 2 == 0 for i, _, c, _ in got if i == 2)  # no graduate chunks for undergraduates
    # a new run over one source
    new = spark.createDataFrame([("n1", "graphs of light", "math", "web", "", "faculty"), ("n1", "twice", "math", "web", "", "faculty"), ("n2", "elsewhere", "art", "web", "", "")], FIELDS)
    ingest.store(new, path, "math", "web")
    found = [r["chunk_id"] for r in retrieve.search_stored(asked.where("question_id = 1"), path, day).orderBy("rank").collect()]
    assert "n1" in found and "n2" not in found and all(c == "n1" or int(c[1:]) % 2 == 0 for c in found)
    ingest.store(df.limit(0), path, "math", "web")
    left = versions.current(spark, f"{path}/chunks").collect()
    assert {r["content_source"] for r in left} == {"catalog"} and len(left[0]["vector"]) == 7
