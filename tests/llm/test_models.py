"""Held-out accuracy of the classifiers, and the pipeline."""

import zlib

from millrace.llm import ordinal, queries

SF = "/root/testdata/sf0.01"


def test_language_accuracy(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in queries.op4_ecoc_language(spark, SF).collect()]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97


def test_quality_selection(spark):
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = {r["doc_id"]: r for r in queries.op8_ordinal_quality(spark, SF).collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    good = [d for d, r in labels.items() if r["quality"] == 1 and r["toxic"] == 0]
    poor = [d for d, r in labels.items() if r["quality"] == 0]
    assert sum(rows[d]["selected"] for d in good) / len(good) > 0.97
    assert sum(rows[d]["selected"] for d in poor) / len(poor) < 0.05


def test_quality_of_unseen_labels(spark):
    """Labels that the fit has not seen: sound documents stay, poor ones go."""
    sf = "/root/testdata/sf0.1"
    held = queries.remainder("doc_id", 3) == 1
    docs = queries.table(spark, sf, "documents")
    ratings = queries.ratings(spark, sf)
    graded = ordinal.grade_documents(docs, ratings.where(~held), 3).where(held)
    rows = graded.select("doc_id", ordinal.accept().alias("selected")).join(queries.table(spark, sf, "labels"), "doc_id").collect()
    rate = lambda some: sum(r["selected"] for r in some) / len(some)
    assert rate([r for r in rows if r["quality"] == 1 and r["toxic"] == 0]) > 0.97
    assert rate([r for r in rows if r["quality"] == 0]) < 0.05


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    seen = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf).cache()
        assert out.columns == columns and 0 < out.count() <= seen
        seen, docs = out.count(), out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == seen
    assert corpus_pipeline.run(spark, sf).count() == packed.count()
