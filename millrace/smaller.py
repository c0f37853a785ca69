"""Queries that run the smaller operators on rows of the driver's tables, with their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .functions import vocabulary as V
from .functions.text import content_id
from .operators import chunks as C
from .operators import evaluate as E
from .operators import layout as L
from .operators import store as S
from .operators.versions import shared_folder
from .plans import ingest
from .queries import query, table
from .sources import files, pages

# Layout: a page of 40 parts in two columns, the first of which is a running header

SET = """set_ AS (SELECT CAST(p_partkey // 40 + 1 AS INT) AS page, CASE WHEN p_partkey % 40 < 20 THEN 'L' ELSE 'R' END AS col, CASE WHEN p_partkey % 40 = 0 THEN 20 ELSE 60 + 30 * (p_partkey % 20) END AS y,
 CASE WHEN p_partkey % 40 = 0 THEN (1000 + p_partkey % 9000) || ' Catalog' ELSE p_name END AS text, p_partkey % 2 = 0 AS bold, p_partkey % 40 = 0 AS header FROM part)"""


def set_characters(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey") % 40
    text = F.when(k == 0, F.concat((1000 + F.col("p_partkey") % 9000).cast("string"), F.lit(" Catalog"))).otherwise(F.col("p_name"))
    y = F.when(k == 0, 20.0).otherwise((60 + 30 * (F.col("p_partkey") % 20)).cast("double"))
    font = F.when(F.col("p_partkey") % 2 == 0, "Serif-Bold").otherwise("Serif")
    lines = p.select((F.floor(F.col("p_partkey") / 40) + 1).cast("int").alias("page"), F.when(k < 20, 50.0).otherwise(320.0).alias("x"), y.alias("top"), font.alias("fontname"), F.posexplode(F.split(text, "")).alias("i", "text"))
    at = F.col("x") + 4.0 * F.col("i")
    return lines.select("page", "text", at.alias("x0"), (at + 4.0).alias("x1"), "top", F.lit(9.0).alias("size"), "fontname")


@query(f"WITH {SET} SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY col, y) AS INT) AS line_no, text, bold AS bold_start FROM set_ WHERE NOT header")
def bold_lines(spark, sf_dir):
    return L.lines_of_chars(set_characters(spark, sf_dir), bold=True).select("page", "line_no", "text", "bold_start")


@query(f"WITH {SET} SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY col, y) AS INT) AS line_no, text, header AS is_header FROM set_")
def header_lines(spark, sf_dir):
    return L.lines_of_chars(set_characters(spark, sf_dir)).select("page", "line_no", "text", "is_header")


# Pages with headings of all levels and a table

MARKUP = """'<html><body><p>before</p><main><h1>' || p_name || '</h1><p>All of ' || p_type || '</p><h2>Courses</h2><ul><li>' || p_brand || '</li></ul><h3>Terms</h3><table><thead><tr><th>Code</th><th>Title</th><th>Fall</th><th>Spring</th></tr></thead><tr><td>CS ' || p_partkey || '</td><td>'
 || p_name || '</td><td>' || CASE WHEN p_partkey % 2 = 0 THEN 'X' ELSE '' END || '</td><td>x</td></tr><tr><td>MA ' || p_partkey || '</td><td>Sums</td><td colspan="2">on demand</td></tr></table></main><p>after</p></body></html>'"""


@query("""SELECT p_partkey AS page_id, p_name AS h1, '' AS heading, p_name || ' All of ' || p_type AS text FROM part UNION ALL SELECT p_partkey, p_name, 'Courses', p_brand FROM part
 UNION ALL SELECT p_partkey, p_name, 'Terms', 'CS ' || p_partkey || ' ' || p_name || ': ' || CASE WHEN p_partkey % 2 = 0 THEN 'Fall, ' ELSE '' END || 'Spring MA ' || p_partkey || ' Sums: on demand' FROM part""")
def page_headings(spark, sf_dir):
    """Sections of pages with main, h1 to h3 and a table of terms."""
    made = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), F.lit("https://a.org").alias("url"), F.expr(MARKUP).alias("html"))
    one_line = F.regexp_replace("s.text", r"\s+", " ")
    return pages.walk_pages(made).select("page_id", "h1", F.explode("sections").alias("s")).select("page_id", "h1", F.col("s.heading").alias("heading"), one_line.alias("text"))


@query("""SELECT p.page_id, p.url, coalesce(s.chunk_type, 'general') AS chunk_type, coalesce(s.level, '') AS level, coalesce(s.degree_type, '') AS degree_type
 FROM pages p LEFT JOIN (SELECT DISTINCT url, 'faculty' AS chunk_type, CASE WHEN page_id % 20 = 0 THEN 'graduate' END AS level, 'ms' AS degree_type FROM pages WHERE page_id % 10 = 0) s USING (url)""")
def page_settings(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    named = p.where("page_id % 10 = 0").select("url", F.lit("faculty").alias("chunk_type"), F.when(F.col("page_id") % 20 == 0, "graduate").alias("level"), F.lit("ms").alias("degree_type")).distinct()
    return files.with_settings(p.select("page_id", "url"), named)


# Chunks

BLANK = "CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '  ' || chr(10) || ' ' ELSE p_name || '  ' || p_brand END"


@query(f"SELECT CAST(p_partkey AS VARCHAR) AS chunk_id, trim(regexp_replace({BLANK}, '\\s+', ' ', 'g')) AS text, 'Academic Catalog 2026, p.' || p_partkey AS source FROM part WHERE trim(regexp_replace({BLANK}, '\\s+', ' ', 'g')) <> ''")
def empty_texts(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("range_id"), F.expr(BLANK).alias("text"), F.col("p_partkey").alias("catalog_page"))
    made = ingest.as_chunks(p).withColumn("chunk_id", F.col("range_id").cast("string")).withColumn("catalog_page_end", F.col("catalog_page"))
    return ingest.mapped(made, "dept", "main", "2026").select("chunk_id", "text", "source")


def made_chunks(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    return p.select(k.cast("string").alias("chunk_id"), F.concat(F.lit("phys  "), (k % 30).cast("string")).alias("course_code"), F.concat("p_name", F.lit(" - Bachelor of Arts")).alias("degree_full_title"), F.array(F.concat(F.lit("CSCI "), (1000 + k % 50).cast("string")), F.lit("MATH 190G")).alias("referenced_courses"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS chunk_id FROM part WHERE p_partkey % 30 = 7 ORDER BY chunk_id LIMIT 1")
def course_found(spark, sf_dir):
    return C.find_course(made_chunks(spark, sf_dir), " PHYS 7 ").select("chunk_id")


@query("SELECT CAST(p_partkey AS VARCHAR) AS chunk_id FROM part WHERE p_partkey % 50 = 11")
def chunk_references(spark, sf_dir):
    return C.filter_chunks(made_chunks(spark, sf_dir), references="CSCI 1011").select("chunk_id")


@query("SELECT CAST(p_partkey AS VARCHAR) AS chunk_id FROM part WHERE contains(lower(p_name || ' - Bachelor of Arts'), 'widget - bachelor')")
def chunk_titles(spark, sf_dir):
    return C.filter_chunks(made_chunks(spark, sf_dir), title="Widget - BACHELOR").select("chunk_id")


# Evaluation

REPLY = "CASE conv_id % 5 WHEN 0 THEN 'See the Catalog of 2024. ' WHEN 1 THEN 'Go to HTTPS://Banner.example.org/x now. ' WHEN 2 THEN 'In the catalog. ' WHEN 3 THEN 'http://a.org has it. ' ELSE '' END || text"
FROM = "CASE (conv_id + turn) % 4 WHEN 0 THEN {a}'catalog'{z} WHEN 1 THEN {a}'web', 'catalog'{z} WHEN 2 THEN {a}'web'{z} ELSE {a}'other'{z} END"


@query(f"""WITH r AS (SELECT conv_id, turn, {REPLY} AS answer, {FROM.format(a="[", z="]")} AS sources FROM conversations)
 SELECT conv_id, turn, contains(lower(answer), 'banner.example.org') AS redirected, (NOT list_contains(sources, 'catalog') OR (contains(lower(answer), 'catalog') AND regexp_matches(answer, '202[0-9]'))) AND (NOT list_contains(sources, 'web') OR contains(lower(answer), 'http')) AS cited FROM r""")
def redirects_and_citations(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(REPLY).alias("answer"), F.expr(FROM.format(a="array(", z=")")).alias("sources"))
    return c.select("conv_id", "turn", E.redirected(F.col("answer"), "banner.example.org").alias("redirected"), E.cites_well(F.col("sources"), F.col("answer")).alias("cited"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN true WHEN 2 THEN true ELSE false END AS valid FROM part""")
def course_entities(spark, sf_dir):
    """Codes that facts expect against those of an answer: none expected, none given, all there, one missing."""
    k = F.col("p_partkey") % 4
    facts = F.when(k == 0, F.array(F.col("p_name"))).otherwise(F.array(F.concat("p_name", F.lit(" in PHYS 1100")), F.lit("and CSCI 2200")))
    answer = F.when(k == 1, F.col("p_name")).when(k == 2, "CSCI 2200, MATH 1500 and PHYS 1100").otherwise("PHYS 1100")
    return table(spark, sf_dir, "part").select("p_partkey", E.codes_valid(answer, facts).alias("valid"))


@query("""WITH s AS (SELECT CAST(event_id AS VARCHAR) AS question_id, event_type AS category, CASE WHEN event_id % 7 <> 0 THEN value > 20 END AS passed, round(value / 100, 3) AS judge_total FROM events),
 t AS (SELECT *, CASE WHEN NOT coalesce(passed, false) THEN 0 WHEN judge_total < 0.85 THEN 1 ELSE 2 END AS stratum FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY question_id) AS n FROM t)
 SELECT CAST(stratum AS INT) AS stratum, question_id, category, coalesce(CAST(passed AS VARCHAR), '') AS judge_pass, '' AS human_pass, '' AS human_notes, CASE WHEN CAST(question_id AS BIGINT) % 2 = 0 THEN 'Q' || question_id ELSE '' END AS question,
  CASE WHEN CAST(question_id AS BIGINT) % 2 = 0 THEN 'A' || question_id ELSE '' END AS system_answer, '' AS judge_reasoning FROM r WHERE stratum < 2 OR n <= 10""")
def review_sheet(spark, sf_dir):
    e, v = table(spark, sf_dir, "events"), F.col("value")
    key = F.col("event_id").cast("string")
    scores = e.select(key.alias("question_id"), F.col("event_type").alias("category"), F.when(F.col("event_id") % 7 != 0, v > 20).alias("passed"), F.round(v / 100, 3).alias("judge_total"))
    answers = e.where("event_id % 2 = 0").select(key.alias("question_id"), F.concat(F.lit("Q"), key).alias("question"), F.concat(F.lit("A"), key).alias("system_answer"))
    return E.review_sheet(scores, answers).drop("judge_total")


@query("""SELECT substr(sha256(p_name || p_partkey), 1, 16) AS chunk_id, p_name || p_partkey AS text, CAST(p_partkey AS INT) AS catalog_page, 0 AS catalog_page_end, '2026' AS catalog_year, 'main' AS source_scope, p_partkey % 2 = 0 AS has_prerequisites, '' AS lab_name,
 array_to_string([p_type], '|') AS referenced, 0 AS families, CASE WHEN p_partkey % 3 = 0 THEN p_size END AS first FROM part""")
def legacy_upload(spark, sf_dir):
    """Rows of the older store, with vectors of a third of the chunks."""
    text = F.concat("p_name", F.col("p_partkey").cast("string"))
    made = table(spark, sf_dir, "part").select(content_id(text).alias("chunk_id"), text.alias("text"), F.col("p_partkey").alias("catalog_page"), (F.col("p_partkey") % 2 == 0).alias("has_prerequisites"), F.array("p_type").alias("referenced_courses"), "p_size", "p_partkey")
    vectors = made.where("p_partkey % 3 = 0").select("chunk_id", F.array("p_size").alias("vector"))
    rows = C.legacy_rows(made, "2026", "main", vectors)
    own = ["chunk_id", "text", "catalog_page", "catalog_page_end", "catalog_year", "source_scope", "has_prerequisites", "lab_name"]
    return rows.select(*own, F.array_join("referenced_courses", "|").alias("referenced"), F.size("program_family").alias("families"), F.get("vector", F.lit(0)).alias("first"))


SAID = """CASE event_id % 4 WHEN 0 THEN '{"faith": ' || (event_id % 3) || ', "full": 1}' WHEN 1 THEN '{"faith": 2, "full": null, "more": 7}' WHEN 2 THEN 'no json' ELSE '{"full": ' || (event_id % 2) || '}' END"""


@query("SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN event_id % 3 WHEN 1 THEN 2 ELSE -1 END AS INT) AS faith, CAST(CASE event_id % 4 WHEN 0 THEN 1 WHEN 3 THEN event_id % 2 ELSE -1 END AS INT) AS \"full\" FROM events")
def judge_scores(spark, sf_dir):
    parsed = E.parse_judge(F.expr(SAID), ["faith", "full"])
    return table(spark, sf_dir, "events").select("event_id", parsed.alias("p")).select("event_id", "p.*")


@query("""SELECT o_custkey, CAST(list_extract(r, 1).rank AS INT) AS rank, list_extract(r, 1).chunk_id AS chunk_id, list_extract(r, 1).heading AS heading, CAST(len(r) AS INT) AS n
 FROM (SELECT o_custkey, list({'rank': o_orderkey, 'chunk_id': CAST(o_orderkey AS VARCHAR), 'heading': o_orderstatus} ORDER BY o_orderkey) AS r FROM orders GROUP BY 1)""")
def retrieved_fields(spark, sf_dir):
    """A result's chunks with just the fields that it keeps."""
    fields = {"rank": F.col("o_orderkey"), "chunk_id": F.col("o_orderkey").cast("string"), "heading": F.col("o_orderstatus"), "text": F.lit("left out")}
    item = F.struct(*[fields.get(c, F.lit("")).alias(c) for c in dict.fromkeys(["rank", *V.RETRIEVED, "text"])])
    lists = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(item)).alias("chunks"))
    kept = lists.select("o_custkey", E.retrieved(F.col("chunks")).alias("r"))
    first = F.get("r", F.lit(0))
    return kept.select("o_custkey", first["rank"].cast("int").alias("rank"), first["chunk_id"].alias("chunk_id"), first["heading"].alias("heading"), F.size("r").alias("n"))


# Files: what is written is read again

def fresh(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name || chr(10) || '\"' || p_type || '\", ' || p_brand AS note FROM part")
def csv_round_trip(spark, sf_dir):
    path = fresh(spark)
    note = F.concat("p_name", F.lit('\n"'), "p_type", F.lit('", '), "p_brand")
    S.write_csv(table(spark, sf_dir, "part").select("p_partkey", note.alias("note")), path)
    return files.read_csv(spark, path)


@query("SELECT event_id, event_type, value FROM events")
def jsonl_round_trip(spark, sf_dir):
    path = fresh(spark)
    S.write_jsonl(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), path)
    return spark.read.schema("event_id long, event_type string, value double").json(path)


@query("SELECT count(*) AS n, CAST(max(event_id) AS BIGINT) AS last, CAST(NULL AS VARCHAR) AS error FROM events")
def summary_file(spark, sf_dir):
    """One row as one object, with a null field."""
    path = fresh(spark)
    S.write_summary(table(spark, sf_dir, "events").agg(F.count("*").alias("n"), F.max("event_id").cast("long").alias("last"), F.lit(None).cast("string").alias("error")), path)
    return files.read_json(spark, path)


@query("WITH g AS (SELECT item_id AS question_id, text, CASE item_id % 3 WHEN 0 THEN 'policy' ELSE 'course' END AS category FROM benchmark) SELECT question_id, text FROM g WHERE question_id IN (1, 3, 6, 9, 10) AND category = 'policy'")
def golden_questions(spark, sf_dir):
    g = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), "text", F.when(F.col("item_id") % 3 == 0, "policy").otherwise("course").alias("category"))
    return files.golden(g, [1, 3, 6, 9, 10], "policy").select("question_id", "text")


@query("SELECT event_id FROM events WHERE strftime(ts, '%Y-%m-%d') = (SELECT max(strftime(ts, '%Y-%m-%d')) FROM events)")
def latest_run(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("run_id"))
    return files.latest_run(e).select("event_id")
