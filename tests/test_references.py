"""Forms that a query's SQL fixes are parameters of the operators; the defaults stay those of browsers and catalogs."""

from millrace.operators import layout as L
from millrace.sources import pages


def test_form_of_codes(spark):
    text = "See CSCI 12345 and PHYS 1100. " * 6
    rows = spark.createDataFrame([(1, 1, 1, "Heading", 12.0, False), (1, 1, 2, text, 9.0, False)], "range_id int, page int, line_no int, text string, size double, is_header boolean")
    found = lambda **kw: L.heading_chunks(rows, **kw).first()["referenced_courses"]
    assert found() == ["PHYS 1100"] and found(code=r"\b(CSCI\s+\d{4})") == ["CSCI 1234"]


def test_character_references():
    html = "<h1>&quot;a&quot; &lt;b&gt; &amp;lt; c&amp</h1>"
    title = lambda *a: pages.tree_parts(pages.parsed(html, *a))[0]
    assert title() == '"a" <b> &lt; c&' and title(["lt", "gt", "amp"]) == "&quot;a&quot; <b> &lt; c&amp"


def test_pages_of_one_file_are_dealt_out(spark, tmp_path):
    made = spark.range(200).selectExpr("id AS page_id", "'u' AS url", "'<h1>' || id || '</h1>' AS html")
    made.coalesce(1).write.parquet(str(tmp_path / "pages"))
    walked = pages.walk_pages(spark.read.parquet(str(tmp_path / "pages")))
    assert walked.rdd.getNumPartitions() >= 4 and {r["h1"] for r in walked.collect()} == {str(i) for i in range(200)}
