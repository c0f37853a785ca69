"""Literal fixtures for rules that the driver's tables don't reach."""

import datetime

import pytest
from pyspark.sql import functions as F

from millrace.functions import rank as R
from millrace.functions import text as T
from millrace.operators import chunks as C
from millrace.operators import evaluate as E
from millrace.operators import layout as L
from millrace.operators import lookup as U
from millrace.operators import ordered as O
from millrace.operators import store as S
from millrace.plans import ingest, retrieve
from millrace.sources import files, pages
from millrace.streaming import chat


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("day,name", [("2026-05-19", "Spring 2026"), ("2026-05-20", "Summer 2026"), ("2026-08-14", "Summer 2026"), ("2026-08-15", "Fall 2026")])
def test_semesters(spark, day, name):
    assert one(spark, T.semester(T.as_date(day))) == name


@pytest.mark.parametrize("asked,want", [("this semester", "Spring 2026"), ("next semester", "Fall 2026"), ("last semester", "Fall 2025"), ("this summer", "Summer 2026"), ("next fall", "Fall 2026"), ("next spring", "Spring 2027"), ("previous spring", "Spring 2025"), ("this year", "2026"), ("NEXT year", "2027"), ("last year", "2025")])
def test_relative_dates(spark, asked, want):
    assert one(spark, T.expand_dates(F.lit(asked), T.as_date(datetime.date(2026, 4, 24)))) == want


def test_ids(spark):
    import hashlib
    import uuid

    assert one(spark, T.content_id(F.lit("abc"))) == hashlib.sha256(b"abc").hexdigest()[:16]
    for name in ("abc", "def#chunk-1", "x" * 50):
        assert one(spark, T.uuid5_url(F.lit(name))) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))


def test_question_sections(spark):
    f = lambda t: [tuple(s) for s in one(spark, T.question_sections(F.lit("H"), F.lit(t)))]
    assert f("no marks") == [("H", "no marks")] and f("Q1. only one") == [("H", "Q1. only one")]
    two = f("Q1. What is it? Yes. Q2 Why xQ3. not?")
    assert [t for _, t in two] == ["Q1. What is it? Yes.", "Q2 Why xQ3. not?"] and two[0][0] == "Q1. What is it?"
    lead = "p" * 51
    assert f(lead + " Q1. a b Q2. c d")[0] == ("H", lead) and len(f("p" * 49 + " Q1. a b Q2. c d")) == 2


def pack(spark, sections, kind="general", least=20, most=60):
    df = spark.createDataFrame([(sections,)], "s array<struct<heading:string,text:string>>")
    return [tuple(c) for c in df.select(C.pack_sections(F.col("s"), F.lit(kind), least, most).alias("x")).first()["x"]]


def test_packing(spark):
    assert pack(spark, []) == []
    assert pack(spark, [("A", "short"), ("B", "also short")]) == [("A", "A\nshort\n\nB\nalso short")]
    assert pack(spark, [("A", "short"), ("B", "b" * 40)]) == [("A", "A\nshort\n\nB\n" + "b" * 40)]
    assert pack(spark, [("A", "short"), ("B", "b" * 56)]) == [("A", "A\nshort"), ("B", "B\n" + "b" * 56)]
    long = ". ".join(["w" * 25] * 4)
    assert [len(t) for _, t in pack(spark, [("", long)])] == [51, 51]
    assert pack(spark, [("", "x" * 90)]) == [("", "x" * 90)]
    assert pack(spark, [("A", "x" * 25), ("B", "y" * 25)], "course_schedule") == [("A", "A\n" + "x" * 25 + " B\n" + "y" * 25)]
    assert len(pack(spark, [("A", "x" * 45), ("B", "y" * 45)], "course_schedule")) == 2


def test_page_walk():
    html = """<html><body><nav>no</nav><main><h1>Top</h1><p>Intro  text</p><h2>One</h2><p>a</p><table><thead><tr><th>Course</th><th>T</th><th>FA26</th><th>SP27</th></tr></thead>
    <tr><td>C 1</td><td>Alpha</td><td>x</td><td></td></tr><tr><td>C 2</td><td>Beta</td><td colspan="2">Rare</td></tr><tr><td>C 3</td><td>Gamma</td><td></td><td></td></tr></table><h3>Two</h3><script>no</script>b<br>c</main><p>out</p><a href="/x">l</a></body></html>"""
    h1, sections, links = pages.page_parts(html)
    assert h1 == "Top" and links == ["/x"]
    assert sections == [("", "Top Intro text"), ("One", "a C 1 Alpha: FA26 C 2 Beta: Rare"), ("Two", "b c")]
    assert pages.page_parts(None) == ("", [], [])
    assert pages.page_parts("<div id=content>in<div>deep</div></div>out")[1] == [("", "in deep")]


def test_page_facts(spark):
    html = '<html><head><meta name="last-modified" content="2026-01-02"></head><body><p>One <b>two</b></p><script>no</script></body></html>'
    row = pages.walk_pages(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")).first()
    assert (row["text"], row["page_timestamp"], row["_error"]) == ("One two", "2026-01-02", None)


def test_hit_columns(spark):
    hits = spark.createDataFrame([("q", 1, "c", "t", None)], "question_id string, rank int, chunk_id string, text string, referenced_courses array<string>")
    row = retrieve.hit_columns(hits).first()
    assert row["referenced_courses"] == [] and row["lab"] == "" and row["rank"] == 1


def test_nearest_in_passes(spark):
    x = spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(50)] + [(50, [0.0, 0.0])], "doc_id long, embedding array<float>")
    asked = x.where("doc_id < 9").withColumnRenamed("doc_id", "item_id")
    one_, many = (R.nearest(x, asked, 3, most=m).orderBy("item_id", "rank").collect() for m in (100, 2))
    assert one_ == many and [r["doc_id"] for r in one_[:3]] == [0, 5, 10] and len(one_) == 27


def test_links(spark):
    ok = lambda u: one(spark, pages.allowed(F.lit(u), ["a.org"], ["/x"], ["logout"]))
    assert ok("https://A.org/x/1") and not ok("ftp://a.org/x") and not ok("https://b.org/x") and not ok("https://a.org/y") and not ok("https://a.org/x?logout") and not ok("not a link")


def test_boosts(spark):
    def boost(question, **chunk):
        q = F.lit(question)
        return one(spark, R.metadata_boost(q, T.tokenize(q), {k: F.lit(v) for k, v in chunk.items()}))

    assert boost("graph theory", heading="Graph Theory") == 0.08
    assert boost("csci 4120", course_code="CSCI 4120") == 0.25
    assert boost("graduate thesis", level="graduate") == 0.16 and boost("graduate thesis", level="undergraduate") == -0.2
    assert boost("freshman year", level="graduate") == -0.2
    assert boost("when is it", chunk_type="course_schedule") == 0.15 and boost("minors", chunk_type="minor_requirement") == 0.15
    assert boost("plan", chunk_type="study_plan", concentration="general") == -0.2
    assert boost("anything", chunk_type="concentration_requirement", degree_full_title="Computer Science") == -0.15
    assert boost("anything", content_source="catalog") == 0.02
    general = F.lit("general education")
    assert one(spark, R.metadata_boost(general, T.tokenize(general), {"chunk_type": F.lit("policy")}, strict_parity=False)) == 0.08


def test_metrics(spark):
    assert one(spark, E.fact_coverage(F.lit("the CSCI course has four credits"), F.array(F.lit("four credits"), F.lit("six hours now"), F.lit("the")))) == 0.667
    code = lambda a, *facts: one(spark, E.codes_valid(F.lit(a), F.array(*[F.lit(f) for f in facts])))
    assert code("x", "no code") is None and code("no code", "CS 100") is True and code("CS 200", "CS 100") is False and code("CS  100", "CS 100") is True
    traced = lambda a: one(spark, E.links_traced(F.lit(a), F.array(F.lit("https://a.org/page")), ["known.org"]))
    assert traced("none") and traced("see https://known.org/x") and traced("https://a.org/page/sub") and not traced("https://evil.org")
    assert one(spark, E.main_source(F.array(F.lit("web"), F.lit("catalog"), F.lit("catalog"), F.lit("web")))) == "catalog"
    assert one(spark, E.main_source(F.array(F.lit("web"), F.lit("catalog")))) == "web"
    assert one(spark, E.judge_total([F.lit(3), F.lit(3), F.lit(-1)])) is None
    assert one(spark, E.parse_judge(F.lit('{"a": 2}'), ["a", "b"])).asDict() == {"a": 2, "b": -1}
    assert one(spark, E.parse_judge(F.lit("broken"), ["a"]))["a"] == -1


@pytest.mark.parametrize("n", [1, 9, 10, 11])
def test_nearest_rank(spark, n):
    df = spark.range(n).select(F.lit("c").alias("c"), F.col("id").alias("v"))
    assert O.nearest_rank(df, "v", ["c"]).first()["p90"] == sorted(range(n))[int(n * 0.9)]


def test_kappa_edges(spark):
    none = spark.createDataFrame([(True, None), (False, None)], "j boolean, h boolean")
    assert E.confusion(none, "j", "h").first()["kappa"] is None
    same = spark.createDataFrame([(True, True), (True, True)], "j boolean, h boolean")
    assert E.confusion(same, "j", "h").first()["kappa"] is None


def test_run_diff(spark):
    old = spark.createDataFrame([("a", ["1", "2"]), ("b", ["1"]), ("c", ["1", "2"])], "question_id string, ids array<string>")
    new = spark.createDataFrame([("a", ["2", "1"]), ("c", ["1", "2", "3"]), ("d", ["9"])], "question_id string, ids array<string>")
    got = {r["question_id"]: (r["status"], sorted(r["moved"])) for r in E.run_diff(old, new).collect()}
    assert got == {"a": ("unchanged", ["1", "2"]), "b": ("only_old", []), "c": ("improved", []), "d": ("only_new", [])}


def test_titles_and_codes(spark):
    rows = [("E E 1110G", "Circuits of Light", "3", "G", "2024"), ("EE1110G", "Circuits of Light", "3", "G", "2025"), ("CS 2", "Light and Shadows", "4", "", "2025")]
    courses = spark.createDataFrame(rows, "course_code string, course_title string, credits string, suffix string, catalog_year string")
    asked = spark.createDataFrame([("ee1110g",), ("nope",)], "asked string")
    assert [(r["asked"], r["catalog_year"]) for r in U.by_code(courses, asked).collect()] == [("ee1110g", "2025")]
    found = [r["course_code"] for r in U.by_title(courses, F.lit("shadow of lights")).collect()]
    assert found == ["CS 2"] and U.by_title(courses, F.lit("of the")).count() == 0
    assert [r["course_code"] for r in U.by_suffix(courses, "G", "ee").collect()] == ["EE1110G"]


def test_heading_chunks(spark):
    rows = [(1, i, t, 100.0 + i, 50.0, s, "L", False) for i, (t, s) in enumerate([("before", 9.0), ("Long", 12.0), ("Title", 13.0), ("body " * 30, 9.0), ("Next", 12.0), ("tiny", 9.0)])]
    lines = spark.createDataFrame(rows, "page int, line_no int, text string, top double, x0 double, size double, col string, is_header boolean").withColumn("range_id", F.lit(1))
    got = L.heading_chunks(lines).collect()
    assert [(r["topic"], r["text"].split("\n")[0]) for r in got] == [("Long Title", "Long Title")]
    assert [r["title"] for r in L.titled_chunks(lines.withColumn("size", F.when(F.col("size") >= 12, 18.0).otherwise(9.0))).collect()] == ["Long Title"]


def test_replacing_writes(spark, tmp_path):
    path = str(tmp_path / "chunks")
    one_ = spark.createDataFrame([("a", "web", 1), ("a", "catalog", 2), ("b", "web", 3)], "department_id string, content_source string, v int")
    S.replace_partitions(one_, path)
    S.replace_partitions(spark.createDataFrame([("a", "web", 9)], one_.schema), path)
    assert sorted(r["v"] for r in S.stored(spark, path).collect()) == [2, 3, 9]
    S.replace_partitions(one_.limit(0), path, scope={"department_id": "a", "content_source": "web"})
    assert sorted(r["v"] for r in S.stored(spark, path).collect()) == [2, 3]  # without new rows the partition is emptied
    S.write_jsonl(one_, str(tmp_path / "j"))
    assert files.read_json(spark, str(tmp_path / "j")).count() == 3 or spark.read.json(str(tmp_path / "j")).count() == 3
    S.write_csv(one_, str(tmp_path / "c"))
    assert dict(files.read_csv(spark, str(tmp_path / "c")).dtypes)["v"] == "string"
    S.create_tables(spark)
    assert spark.table("courses").count() == 0


def test_search_and_ingest_plans(spark):
    html = "<main><h1>CS 100 News</h1><h2>Parking</h2><p>" + "Parking permits are sold at the office. " * 6 + "</p><h2>Labs</h2><p>" + "Robotics labs open in the morning. " * 6 + "</p></main>"
    raw = spark.createDataFrame([(1, "https://a.org/p", html)], "page_id long, url string, html string")
    table = files.page_settings(spark, {"pages": {"https://a.org/p": "advising"}, "page_levels": {"https://a.org/p": "undergraduate"}})
    chunks = ingest.ingest_pages(raw, table, "dept", "main", "v1").cache()
    assert [(r["chunk_id"], r["chunk_type"], r["level"], r["course_code"]) for r in chunks.orderBy("chunk_id").collect()] == [("https://a.org/p#chunk-0", "advising", "undergraduate", "CS 100"), ("https://a.org/p#chunk-1", "advising", "undergraduate", "CS 100")] or chunks.count() == 3
    asked = spark.createDataFrame([("q1", "Where are parking permits sold?")], "question_id string, text string")
    top = retrieve.search(asked, chunks, T.as_date("2026-04-24")).orderBy("rank").first()
    assert "Parking permits" in chunks.where(F.col("chunk_id") == top["chunk_id"]).first()["text"]


def test_streams(spark, tmp_path):
    rows = [(i, datetime.datetime(2026, 1, 1, i // 4, 10 * (i % 4)), i % 2, "chat") for i in range(12)]
    events = spark.createDataFrame([*rows, rows[0]], "event_id long, ts timestamp, user_id int, event_type string")
    events.write.parquet(str(tmp_path / "in"))
    stream = chat.hourly(chat.once(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))), None)
    q = stream.writeStream.format("memory").queryName("hours").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["start"].hour: r["n"] for r in spark.table("hours").collect()}
    assert got.get(0) == 4 and got.get(1) == 4
    log = chat.append_log(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "cp"))
    log.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).count() == 13


def test_embedding_batches(spark):
    df = spark.createDataFrame([(i, "x" * 400) for i in range(200)], "id long, text string")
    out = C.embedding_batches(df, "id", most_rows=10, most_tokens=500, group_rows=70).toPandas()
    sizes = out.groupby(["group", "batch"]).agg(n=("id", "size"), t=("tokens", "sum"))
    assert len(out) == 200 and sizes.n.max() <= 10 and sizes.t.max() <= 500
