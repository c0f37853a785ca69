"""Page ranges against brute force, with ties, null and many entries on a page, and on a whole table."""

import random

from millrace import queries
from millrace.operators import layout


def test_page_ranges(spark):
    rng = random.Random(4)
    rows = [(rng.randint(1, 60), f"t{i:03}", float(rng.randint(0, 3)) if i % 9 else None) for i in range(120)]
    ordered = sorted(rows, key=lambda r: (r[0], r[1]))
    last = ordered[-1][0]
    want = []
    for i, (page, title, indent) in enumerate(ordered):
        later = [p for p, _, x in ordered[i + 1 :] if None not in (x, indent) and x <= indent]
        want.append((page, title, indent, max(later[0] - 1 if later else last, page)))
    got = layout.page_ranges(spark.createDataFrame(rows, "catalog_page int, title string, indent double")).collect()
    assert sorted(map(tuple, got), key=lambda r: r[:2]) == want


def test_whole_tables(spark):
    sf = "/root/testdata/sf0.01"
    assert queries.QUERIES["toc_ranges"](spark, sf).count() == queries.table(spark, sf, "part").count() > 200
    assert queries.QUERIES["temporal_expand"](spark, sf).count() == queries.table(spark, sf, "orders").count()
