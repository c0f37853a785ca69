"""Nearest vectors in tiles are those of one matrix."""

import random

import numpy as np

from millrace.functions import rank


def test_tiles(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(3)]) for i in range(60)]  # many equal cosines
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "doc_id long, embedding array<double>").repartition(2)
    asked = table.where("doc_id % 6 = 0").withColumnRenamed("doc_id", "item_id")
    monkeypatch.setattr(rank, "TILE", 4)
    got = {(r["item_id"], r["rank"]): r["doc_id"] for r in rank.nearest(table, asked, 5).collect()}
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1)
    for q, v in rows:
        if q % 6 == 0:
            order = sorted((-round(float(unit(v) @ unit(w)), 6), i) for i, w in rows)
            assert [got[q, n + 1] for n in range(5)] == [i for _, i in order[:5]]
