"""Ingest plans: chunks of web pages, and of catalog lines under a plan of sections."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.text import codes, collapse, content_id, first_code, question_sections, strip
from ..operators import chunks as C
from ..operators import layout as L
from ..operators import sections as X
from ..operators import versions
from ..sources import pages as P
from ..sources.files import with_settings
from . import retrieve
from .embedding import embed


def ingest_pages(pages: DataFrame, table: DataFrame, department: str, campus: str, version: str, least: int = 0, references: list[str] | None = None) -> DataFrame:
    """Chunks of web pages (page_id, url, html): walk, split questions, pack, annotate.

    A page whose sections give nothing is one chunk of its text, cut at 2000 characters. Pages with a text of no more
    than `least` characters, and pages that could not be read, are left out.
    """
    walked = with_settings(P.walk_pages(pages, references), table).where(F.col("_error").isNull() & (F.length("text") > least - (least == 0)))
    split = F.flatten(F.transform("sections", lambda s: question_sections(s["heading"], s["text"])))
    whole = F.when(strip(F.col("text")) != "", F.array(F.struct(F.col("h1").alias("heading"), F.substring(strip(F.col("text")), 1, V.MAX_CHARS).alias("text")))).otherwise(F.slice(C.pack_sections(split, F.col("chunk_type")), 1, 0))
    made = walked.withColumn("packed", C.pack_sections(split, F.col("chunk_type")))
    packed = made.select("*", F.posexplode(F.when(F.size("packed") > 0, F.col("packed")).otherwise(whole)).alias("i", "chunk"))
    body = F.array_join(F.transform("sections", lambda s: s["text"]), " ")
    return packed.select(
        F.concat(F.col("url"), F.lit("#chunk-"), F.col("i").cast("string")).alias("chunk_id"), "chunk_type", F.lit(department.strip().lower()).alias("department_id"), F.lit(campus).alias("campus"),
        F.col("chunk.text").alias("text"), F.coalesce(F.nullif(F.col("chunk.heading"), F.lit("")), F.col("h1")).alias("heading"), F.col("url").alias("source"), "level", "degree_type",
        first_code(F.col("h1"), body).alias("course_code"), codes(F.col("text")).alias("referenced_courses"), F.lit("web").alias("content_source"), F.lit(version).alias("crawl_version"),
    )


#: A chunk before it is mapped to the chunk table: its columns, and what they hold where a section has nothing for them.
DEFAULTS: dict[str, str] = {
    "chunk_type": "''", "catalog_page": "0", "text": "''", "dept_name": "''", "program_family": "cast(array() as array<string>)", "degree_level": "''", "degree_type": "''", "concentration": "''",
    "degree_full_title": "''", "course_code": "''", "course_title": "''", "credits": "''", "dept_prefix": "''", "course_number_level": "''", "has_prerequisites": "false", "policy_topic": "''",
    "lab_name": "''", "referenced_courses": "cast(array() as array<string>)", "is_research_related": "false",
}
#: Handlers of page ranges that are cut at headings, and the types of their chunks.
GENERIC = {"policy": "policy", "glossary": "glossary", "grad_info": "grad_program_info", "research": "research"}
#: The columns of a section plan beside range_id, start_page, end_page and handler.
PLAN = ["title", "dept_name", "topic", "start_heading", "degree_level"]


def as_chunks(df: DataFrame, **columns: Column) -> DataFrame:
    """(range_id, the columns of DEFAULTS): what df has, what is given here, and defaults."""
    kept = {c: columns.get(c, F.col(c) if c in df.columns else F.expr(v)) for c, v in DEFAULTS.items()}
    return df.select("range_id", *[v.alias(c) for c, v in kept.items()])


def generic_chunks(lines: DataFrame, code: str = V.CATALOG_CODE) -> DataFrame:
    """Chunks of policy, glossary, graduate and research ranges (lines with handler and the plan's columns); `code` is the form of course codes."""
    kind = F.coalesce(*[F.when(F.col("handler") == h, F.lit(k)) for h, k in GENERIC.items()])
    facts = lines.select("range_id", kind.alias("chunk_type"), "dept_name", "degree_level").distinct()
    cut = L.heading_chunks(lines, preset="topic", keep=F.col("handler") == "glossary", code=code).join(facts, "range_id")
    is_lab = F.col("chunk_type") == "research"
    topic = F.when(F.col("chunk_type").isin("policy", "grad_program_info"), F.col("topic")).otherwise("")
    return as_chunks(cut, policy_topic=topic, lab_name=F.when(is_lab, F.col("topic")).otherwise(""), is_research_related=is_lab)


def department_chunks(lines: DataFrame) -> DataFrame:
    return as_chunks(X.department_chunks(lines), program_family=F.array(C.family(F.col("dept_name"))), referenced_courses=codes(F.col("text"), V.CATALOG_CODE))


def core_chunks(lines: DataFrame) -> DataFrame:
    level = C.degree_facts(F.col("title"))["level"]
    return as_chunks(X.core_chunks(lines), program_family=F.array(C.family(F.col("dept_name"))), degree_level=level, referenced_courses=codes(F.col("text"), V.CATALOG_CODE))


def degree_chunks(lines: DataFrame) -> DataFrame:
    return as_chunks(X.degree_chunks(lines), program_family=F.array(C.family(F.col("dept_name"))), degree_level=F.col("level"))


def minor_chunks(lines: DataFrame) -> DataFrame:
    level = F.when(F.col("title").rlike(r"(?i)\bgraduate\b"), "graduate").otherwise("undergraduate")
    facts = {"chunk_type": F.lit("minor_requirement"), "degree_full_title": F.col("title"), "degree_type": F.lit("minor"), "degree_level": level}
    return as_chunks(L.titled_chunks(lines), program_family=F.array(C.family(F.col("dept_name"))), referenced_courses=codes(F.col("text"), V.CATALOG_CODE), **facts)


def course_chunks(lines: DataFrame, bold: bool = False) -> DataFrame:
    found = L.course_chunks(lines, bold=bold)
    facts = C.course_facts(F.col("course_code"), F.col("text"), bold)
    renamed = {"dept_prefix": facts["prefix"], "course_number_level": facts["course_level"], "credits": facts["credits"], "has_prerequisites": facts["has_prerequisites"]}
    return as_chunks(found, chunk_type=F.lit("course_description"), referenced_courses=codes(F.col("text"), V.CATALOG_CODE), **renamed)


#: Handlers of a section plan beside the generic ones: what reads the lines of all ranges that name it.
HANDLERS = {"courses": course_chunks, "dept_intro": department_chunks, "degree_core": core_chunks, "degree": degree_chunks, "minor": minor_chunks}


def catalog_chunks(lines: DataFrame, plan: DataFrame, bold: bool = False) -> DataFrame:
    """Chunks of all ranges of a plan, first of equal texts by range and page, with their content ids.

    plan is (range_id, start_page, end_page, handler, title, dept_name, topic, start_heading, degree_level, is_concentration). Its rows
    meet their lines in a join and go with them as parameters, so each handler reads all its ranges at once, partitioned by
    range, and the size of the job doesn't depend on their number. A plan with an unknown handler is refused.
    """
    if odd := plan.where(~F.col("handler").isin([*GENERIC, *HANDLERS]) | F.col("handler").isNull()).select("handler").limit(1).collect():
        raise ValueError(f"no handler {odd[0][0]}")
    own = L.in_plan(lines, plan.fillna("", PLAN).fillna(False, "is_concentration"))
    parts = [generic_chunks(own.where(F.col("handler").isin(list(GENERIC))))]
    for name, read in HANDLERS.items():
        mine = own.where(F.col("handler") == name)
        parts.append(read(mine, bold) if name == "courses" else read(mine))
    both = reduce(DataFrame.unionByName, parts)
    ided = both.withColumn("chunk_id", content_id(F.col("text"))).withColumn("catalog_page_end", F.col("catalog_page")).withColumn("seq", F.struct("range_id", "catalog_page"))
    return C.first_wins(ided, "chunk_id", "seq").drop("seq")


def mapped(chunks: DataFrame, department: str, campus: str, year: str, catalog: str = "Academic Catalog") -> DataFrame:
    """Rows of the chunk table from catalog chunks; those without a text are left out."""
    c = F.col
    heading = C.catalog_heading(c("course_code"), c("course_title"), c("degree_full_title"), c("policy_topic"), c("lab_name"), c("chunk_type"))
    return chunks.withColumn("text", collapse(c("text"))).where("text <> ''").select(
        "chunk_id", "chunk_type", F.lit(department).alias("department_id"), F.lit(campus).alias("campus"), "text", heading.alias("heading"), C.catalog_source(catalog, F.lit(year), c("catalog_page")).alias("source"),
        C.catalog_level(c("course_number_level"), c("degree_level")).alias("level"), "degree_type", "course_code", "referenced_courses", F.lit("catalog").alias("content_source"), F.lit(year).alias("catalog_year"),
        "catalog_page", "catalog_page_end", "degree_full_title", "concentration", "credits", "has_prerequisites", "policy_topic", c("lab_name").alias("lab"), c("is_research_related").alias("research"), F.lit("").alias("crawl_version"),
    )


def ingest_lines(lines: DataFrame, plan: DataFrame, department: str, campus: str, year: str, catalog: str = "Academic Catalog", bold: bool = False) -> DataFrame:
    """Rows of the chunk table from catalog lines under a plan (see `catalog_chunks`)."""
    return mapped(catalog_chunks(lines, plan, bold), department, campus, year, catalog)


def store(chunks: DataFrame, path: str, department: str, source: str, function: Callable[[list[str]], list[list[float]]] | None = None) -> tuple[int, int]:
    """Replace what the store at `path` has of a department and source (web or catalog) by these chunks: (version of chunks, of index).

    Chunks are checked for their scope, embedded by `function` (a column `vector`, joined by chunk_id) and published, and so is their
    index. Each of both tables changes in one step; a run without chunks empties the scope. Of equal ids the first by text stays.
    """
    scope = {"department_id": department, "content_source": source}
    own = C.first_wins(chunks.where(F.col("department_id").eqNullSafe(department) & F.col("content_source").eqNullSafe(source)), "chunk_id", "text")
    if function is not None:
        own = own.join(embed(own, "chunk_id", "text", function), "chunk_id", "left")
    version = versions.publish(own, f"{path}/chunks", retrieve.SCOPES, scope)
    return version, retrieve.store_index(versions.current(own.sparkSession, f"{path}/chunks", scope), f"{path}/index", scope)
