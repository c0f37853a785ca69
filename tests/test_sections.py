"""Typed sections and the answer plan, on literal lines and questions."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import layout
from millrace.operators import sections as X
from millrace.plans import answer as A
from millrace.plans import ingest


def lines(spark, rows):
    data = [(1, i // 6 + 1, i, t, float(s), False) for i, (t, s) in enumerate(rows)]
    return spark.createDataFrame(data, "range_id int, page int, line_no int, text string, size double, is_header boolean")


BODY = "Take these courses in the first year of the program."


def test_degree_section(spark):
    title = "Physics - Bachelor of Science"
    rows = [("tail of another degree", 9), ("Physics - Bachelor", 18), ("of Science", 18), (BODY, 9), ("Electives", 12), ("CSCI 1110 and others", 9), ("A Suggested Plan of Study", 12), (BODY, 9), ("Second Language Requirement", 12), (BODY, 9), ("Physics - Master of Science", 18), ("not here", 9)]
    got = {r["chunk_type"]: r for r in X.degree_chunks(lines(spark, rows), title, title).collect()}
    assert set(got) == {"degree_requirement", "study_plan", "second_language"}
    assert got["degree_requirement"]["text"] == f"{BODY}\nElectives\nCSCI 1110 and others" and got["degree_requirement"]["referenced_courses"] == ["CSCI 1110"]
    assert got["study_plan"]["text"].startswith("A Suggested Plan") and got["study_plan"]["level"] == "undergraduate"


def test_concentration(spark):
    rows = [("General text that goes", 9), ("The specific requirements for the concentration in AI are:", 9), (BODY, 9), ("Total Credits 40", 9), ("a footnote", 9), ("A Suggested Plan of Study", 12), (BODY, 9)]
    got = {r["chunk_type"]: r["text"] for r in X.degree_chunks(lines(spark, rows), "CS (AI) - Bachelor of Science", concentration=True).collect()}
    assert got["concentration_requirement"].split("\n")[0] == "CS (AI) - Bachelor of Science" and got["concentration_requirement"].endswith("Total Credits 40")
    assert "footnote" not in " ".join(got.values()) and "study_plan" in got


def test_core(spark):
    rows = [("before", 9), ("Computer Science -", 18), ("Bachelor of Science", 18), (BODY, 9), (BODY, 9), ("Another Title", 18), ("after", 9)]
    (row,) = X.core_chunks(lines(spark, rows), "computer science - bachelor of science", "Computer Science - Bachelor of Science", 50).collect()
    assert row["text"] == f"Computer Science - Bachelor of Science\n{BODY}\n{BODY}" and row["concentration"] == "general"


def test_department(spark):
    rows = [("Welcome to the department of things.", 9), ("Degrees for the", 12), ("Department", 12), (BODY, 9), ("Physics Courses", 12), ("PHYS 110. Light", 9), ("Graduate Assistantships", 12), (BODY, 9)]
    got = {r["chunk_type"]: r for r in X.department_chunks(lines(spark, rows)).collect()}
    assert set(got) == {"dept_intro", "program_index", "grad_program_info"}
    assert got["grad_program_info"]["policy_topic"] == "Graduate Assistantships" and got["program_index"]["text"] == BODY


def test_answers(spark):
    courses = spark.createDataFrame([("CS 100G", "Ideas of Computing", "3", "G", "2025"), ("CS 100G", "Ideas of Computing", "4", "G", "2024"), ("MATH 150", "Numbers", "2", "", "2025")], "course_code string, course_title string, credits string, suffix string, catalog_year string")
    asked = spark.createDataFrame([("a", "How many credits is CS 100G?"), ("b", "Which general education courses does CS have?"), ("c", "Is Numbers gen ed?"), ("d", "Are seats open this fall for registration?"), ("e", "Where do I park my car?")], "question_id string, text string")
    chunks = spark.createDataFrame([("1", "Park your car in lot nine.", "Parking", "general", "", "web", "https://a.org", "dept")], "chunk_id string, text string, heading string, chunk_type string, level string, content_source string, source string, department_id string")
    out = {r["question_id"]: r for r in A.answer_questions(asked, chunks, courses, T.as_date("2026-04-24"), lambda p: "told " + str("lot nine" in p), "Look it up at the registrar.").collect()}
    assert out["a"]["answer"] == "CS 100G — Ideas of Computing carries 3 credit(s) (Academic Catalog 2025)."
    assert out["b"]["answer"] == "The following in CS courses carry a General Education (G) suffix:\n\n- CS 100G — Ideas of Computing (4 cr.)\n- CS 100G — Ideas of Computing (3 cr.)\n\nSource: Academic Catalog 2024."
    assert out["c"]["answer"].startswith("No. MATH 150")
    assert out["d"]["answer"] == "Look it up at the registrar." and out["e"]["answer"] == "told True" and out["e"]["sources"] == ["https://a.org"]


def test_no_courses_and_titles_of_all_years(spark):
    courses = spark.createDataFrame([("CS 1", "Ideas of Computing", "3", "", "2025"), ("CS 1", "Ideas of Computing", "4", "", "2024"), ("MATH 150", "Numbers", "2", "", "2025")], "course_code string, course_title string, credits string, suffix string, catalog_year string")
    asked = spark.createDataFrame([("a", "Which general education courses does PHYS have?"), ("b", "How many credits is Computing worth?"), ("c", "How many credits is Numbers worth?")], "question_id string, text string")
    out = {r["question_id"]: r["answer"] for r in A.lookups(asked, courses).collect()}
    assert out["a"] == "No courses in PHYS with a General Education (G) suffix were found in the course lookup table."
    assert "b" not in out and out["c"].startswith("MATH 150 — Numbers carries 2")  # an equal title of another year leaves no clear winner


def test_dispatch_of_a_plan(spark):
    """Every handler reads its own ranges; a text that two ranges give is kept once."""
    long = "A sentence of some length about this topic of the catalog, again and again. " * 2
    ranges = {
        "policy": [("before the heading " + long, 9), ("Transfer", 12), (long, 9)], "glossary": [("terms " + long, 9)], "grad_info": [("Graduate School", 12), ("school " + long, 9)], "research": [("Laser Lab", 12), ("lab " + long, 9)],
        "dept_intro": [("Faculty", 12), ("Ada, Alan and Grace teach here " + long, 9)], "degree_core": [("Physics - Bachelor of Science", 18), ("core " + long, 9)], "degree": [("Physics - Bachelor of Science", 18), ("requirements " + long, 9)],
        "minor": [("Physics - Graduate Minor", 18), ("minor " + long, 9)], "courses": [("PHYS 5100. Light", 9), ("All of light. 3-4 Credits. Prerequisite: PHYS 1100.", 9)],
    }
    rows = [(i + 1, k, t, float(s), False) for i, r in enumerate([*ranges.values(), ranges["glossary"]]) for k, (t, s) in enumerate(r)]
    lines = spark.createDataFrame(rows, "page int, line_no int, text string, size double, is_header boolean")
    plan = [(i + 1, i + 1, i + 1, h, "Physics - Bachelor of Science", "Department of Physics", "", "Physics - Bachelor of Science" if h == "degree" else "", "", False) for i, h in enumerate([*ranges, "glossary"])]
    plan = spark.createDataFrame(plan, "range_id int, start_page int, end_page int, handler string, title string, dept_name string, topic string, start_heading string, degree_level string, is_concentration boolean")
    out = ingest.ingest_lines(lines, plan, "dept", "main", "2026").collect()
    got = {r["chunk_type"]: r for r in out}
    assert len(out) == len(got) == 9
    assert set(got) == {"policy", "glossary", "grad_program_info", "research", "faculty", "degree_core_requirement", "degree_requirement", "minor_requirement", "course_description"}
    assert got["policy"]["heading"] == got["policy"]["policy_topic"] == "Transfer" and got["research"]["heading"] == got["research"]["lab"] == "Laser Lab" and got["research"]["research"]
    assert got["degree_requirement"]["level"] == "undergraduate" and got["degree_requirement"]["degree_type"] == "bs" and got["minor_requirement"]["level"] == "graduate"
    c = got["course_description"]
    assert (c["heading"], c["level"], c["credits"], c["has_prerequisites"], c["catalog_page_end"]) == ("PHYS 5100 — Light", "graduate", "3-4", True, 9)
    with pytest.raises(ValueError):
        ingest.catalog_chunks(lines, plan.withColumn("handler", F.lit("poetry")))


def minors(spark, rows, **plan):
    data = [(1, i // 3 + 7, i, t, float(s), False) for i, (t, s) in enumerate(rows)]
    df = spark.createDataFrame(data, "range_id int, page int, line_no int, text string, size double, is_header boolean").withColumns({k: F.lit(v) for k, v in plan.items()})
    return [(r["title"], r["text"], r["catalog_page"]) for r in sorted(layout.titled_chunks(df).collect(), key=lambda r: (r["catalog_page"], r["title"]))]


def test_minors_begin_and_end(spark):
    rows = [(BODY, 9), ("Art -", 18), ("Minor", 18), (BODY, 9), ("Program Information", 14), (BODY, 9), ("Bio - Minor", 18), (BODY, 9)]
    art = ("Art - Minor", f"Art - Minor\n{BODY}", 7)
    assert minors(spark, rows) == [("", BODY, 7), art]  # a smaller heading ends the range, not just its section
    assert minors(spark, rows, start_page=5)[0] == ("", BODY, 5)
    assert minors(spark, rows, start_heading=" art  - MINOR") == [(*art[:2], 7)]
    assert minors(spark, rows, start_heading="Bio - Minor") == [("Bio - Minor", f"Bio - Minor\n{BODY}", 9)] and minors(spark, rows, start_heading="Law") == []
    # titles right behind the start heading are another minor
    assert minors(spark, [("Minors", 18), ("Art - Minor", 18), (BODY, 9)], start_heading="minors") == [("Art - Minor", f"Art - Minor\n{BODY}", 7)]


def test_lines_meet_their_ranges(spark):
    lines = spark.range(100).select(F.col("id").cast("int").alias("page"))
    plan = spark.createDataFrame([(1, 0, 40), (2, 16, 16), (3, 90, 200), (4, 9, 3), (5, 40, 41)], "range_id int, start_page int, end_page int")
    got = layout.in_plan(lines, plan)
    assert sorted((r["page"], r["range_id"]) for r in got.collect()) == sorted((p, r["range_id"]) for p in range(100) for r in plan.collect() if r["start_page"] <= p <= r["end_page"])
    assert "NestedLoop" not in got._jdf.queryExecution().toString()


def test_plans_of_any_size_make_one_job(spark):
    lines = spark.createDataFrame([(1, 0, "x", 9.0, False)], "page int, line_no int, text string, size double, is_header boolean")
    row = lambda i: (i, i, i, list(ingest.HANDLERS)[i % 5], "T", "D", "", "", "", False)
    sizes = []
    for n in (5, 60):
        plan = spark.createDataFrame([row(i) for i in range(n)], "range_id int, start_page int, end_page int, handler string, title string, dept_name string, topic string, start_heading string, degree_level string, is_concentration boolean")
        sizes.append(ingest.catalog_chunks(lines, plan)._jdf.queryExecution().optimizedPlan().toString().count("Join"))
    assert sizes[0] == sizes[1]


def test_evaluation_of_results(spark):
    golden = spark.createDataFrame([("a", "x", ["CS 100 has four credits"], ["1"], "web", False), ("b", "x", ["none"], ["9"], "catalog", False), ("c", "x", ["none"], [], "redirect", True)], "question_id string, category string, key_facts array<string>, expected_chunk_ids array<string>, expected_source_type string, banner_redirect_expected boolean")
    chunk = "array<struct<chunk_id:string,content_source:string,source:string>>"
    results = spark.createDataFrame([("a", "CS 100 has four credits, see https://a.org/p", [("1", "web", "https://a.org/p")], 5), ("c", "Ask Banner about it.", [], 7)], f"question_id string, answer string, chunks {chunk}, latency int")
    out = {r["question_id"]: r for r in A.evaluate(golden, results).collect()}
    assert out["a"]["retrieval_score"] == 1.0 and out["a"]["context_recall"] == 1.0 and out["a"]["passed"] and out["a"]["links_traced"] and out["a"]["course_entity_valid"]
    assert not out["b"]["passed"] and out["b"]["recall_at_k"] is False or out["b"]["recall_at_k"] is None
    assert out["c"]["passed"]


def test_embedding_by_tokens(spark):
    df = spark.createDataFrame([(i, "x" * 400) for i in range(10)] + [(10, "y" * 4000)], "id long, text string").coalesce(1)
    sizes = {r["id"]: r["vector"][0] for r in A.embed(df, "id", "text", lambda ts: [[float(len(ts))]] * len(ts), batch=4, most_tokens=300).collect()}
    assert [sizes[i] for i in range(11)] == [3.0] * 9 + [1.0, 1.0]


def test_embedding_and_failures(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(5)], "id long, text string")
    assert {r["id"]: list(r["vector"]) for r in A.embed(df, "id", "text", lambda ts: [[float(len(t))] for t in ts], batch=2).collect()} == {i: [float(i)] for i in range(5)}

    def failing(p):
        raise ValueError("no")

    row = A.generate(df.limit(1).withColumn("prompt", F.lit("p")), failing).first()
    assert row["answer"] is None and row["error"] == "no"
