"""Typed sections of catalog lines: department pages, degree sections and cores, by windows over the lines of a range.

Lines (range_id, page, line_no, text, size, is_header) are cut in three steps, each a window: runs of heading lines are
joined to one heading; rules give a heading its part (where reading starts, a new section of some type, or where it
stops); running counts over those give every line its section. So a section that crosses pages stays whole, and ranges
are independent of each other. What a plan says of a range (title, dept_name, start_heading, is_concentration) are columns of its
lines, so one plan reads any number of ranges; each may also be given to a function as a value for all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.text import codes, collapse, nfkc, strip
from .chunks import degree_facts
from .layout import HEADING_SIZE, TITLE_SIZE, islands

# Patterns that begin or end the parts of a degree section.
STUDY_PLAN = r"(?i)^A Suggested Plan of Study"
SECOND_LANGUAGE = r"(?i)^Second Language Requirement"
OTHER_DEGREE = r"(?i).+\s[-–]\s*(Bachelor of (Arts|Science)|Master of|Doctor of)"
MINOR_OR_CERTIFICATE = r"(?i)(Undergraduate|Graduate)\s+(Minor|Certificate)"
CONCENTRATION = r"(?i)The spe[ck]i.ic requirements for the concentration in"
TOTAL = r"^Total Credits"
COURSES = r"(?i).+\sCourses?$"

# Headings of department pages and their types, but for those that name a subject.
DEPARTMENT_HEADINGS = {
    "Degrees for the Department": "program_index",
    "Minors for the Department": "minor_index",
    "Faculty": "faculty",
    "College Faculty": "faculty",
    "Master’s Accelerated Program (MAP)": "grad_program_info",
    "Graduate Program Information": "grad_program_info",
    "Graduate Assistantships": "grad_program_info",
}


def same_heading(a: Column, b: Column) -> Column:
    """Equal but for case, white space and compatibility forms."""
    return F.lower(collapse(nfkc(a))) == F.lower(collapse(nfkc(b)))


#: What a section plan says of a range, and what holds where it says nothing.
PARAMETERS = {"title": "", "dept_name": "", "start_heading": "", "is_concentration": False}


def with_parameters(lines: DataFrame, **values: str | bool | None) -> DataFrame:
    """Lines with a column for every parameter: the value given, else their own column, else the default."""
    out = lines
    for name, default in PARAMETERS.items():
        if values.get(name) is not None:
            out = out.withColumn(name, F.lit(values[name]))
        else:
            out = out.withColumn(name, F.coalesce(F.col(name), F.lit(default)) if name in lines.columns else F.lit(default))
    return out


def headed(lines: DataFrame, size: float) -> DataFrame:
    """Body lines and joined headings in order: (range_id, page, at, text, is_heading, the parameters), one row for a run of headings."""
    own = lines.where("not is_header").withColumn("at", F.struct("page", "line_no")).withColumn("is_heading", F.col("size") >= size)
    runs = islands(own, "is_heading", "range_id", "at", "run")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), " ")
    heads = runs.where("is_heading").groupBy("range_id", "run").agg(F.min("at").alias("at"), text.alias("text"), *[F.first(c).alias(c) for c in PARAMETERS])
    heads = heads.select("range_id", F.col("at.page").alias("page"), "at", "text", F.lit(True).alias("is_heading"), *PARAMETERS)
    return heads.union(runs.where("not is_heading").select("range_id", "page", "at", "text", "is_heading", *PARAMETERS))


def so_far(column: Column, by: str = "range_id", upto: int = 0) -> Column:
    """The sum of a flag over the rows up to this one (or up to the one before, with -1)."""
    return F.coalesce(F.sum(column.cast("int")).over(Window.partitionBy(by).orderBy("at").rowsBetween(Window.unboundedPreceding, upto)), F.lit(0))


def within(rows: DataFrame, start: Column, stop: Column) -> DataFrame:
    """Rows from the start heading (with it; all where no start_heading is named) to the first stop heading after it (without it)."""
    begun = rows.withColumn("_begun", so_far(F.coalesce(start, F.lit(False)))).where("_begun > 0 or start_heading = ''")
    return begun.withColumn("_ended", so_far(F.coalesce(stop, F.lit(False)))).where("_ended = 0").drop("_begun", "_ended")


def gathered(rows: DataFrame, least: int) -> DataFrame:
    """(range_id, section, chunk_type, catalog_page, text, the parameters) of numbered and typed rows, at least so many characters."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "\n")
    out = rows.groupBy("range_id", "section", "chunk_type").agg(text.alias("text"), F.min("at")["page"].alias("catalog_page"), *[F.first(c).alias(c) for c in PARAMETERS])
    return out.withColumn("text", strip(F.col("text"))).where(F.length("text") >= least)


def department_chunks(lines: DataFrame, start_heading: str | None = None, dept_name: str | None = None, least: int = 30) -> DataFrame:
    """Chunks of a department's pages, by its headings; listings under "... Courses" are left out.

    "Entrance Requirements for Graduate Study in ..." is a heading where the department's subject follows.
    """
    text, head = F.col("text"), F.col("is_heading")
    subject = F.trim(F.regexp_replace("dept_name", "^Department of ", ""))
    entrance = (subject != "") & (text == F.concat(F.lit("Entrance Requirements for Graduate Study in "), subject))
    kind = F.coalesce(*[F.when(text == h, F.lit(k)) for h, k in DEPARTMENT_HEADINGS.items()], F.when(entrance, "grad_program_info"))
    rows = headed(with_parameters(lines, start_heading=start_heading, dept_name=dept_name), HEADING_SIZE)
    rows = within(rows, head & same_heading(text, F.col("start_heading")), F.lit(False))
    boundary = head & (kind.isNotNull() | text.rlike(COURSES))
    marked = rows.withColumn("_kind", F.when(head & text.rlike(COURSES), "courses").when(head, kind)).withColumn("section", so_far(boundary))
    named = marked.withColumn("chunk_type", F.coalesce(F.max("_kind").over(Window.partitionBy("range_id", "section")), F.lit("dept_intro")))
    kept = named.where((F.col("chunk_type") != "courses") & (F.col("_kind").isNull() | (F.col("_kind") == "grad_program_info")))
    topic = F.coalesce(F.max(F.when(F.col("_kind") == "grad_program_info", text)).over(Window.partitionBy("range_id", "section")), F.lit(""))
    topics = kept.withColumn("policy_topic", topic).groupBy("range_id", "section").agg(F.max("policy_topic").alias("policy_topic"))
    return gathered(kept, least).join(topics, ["range_id", "section"]).drop("section")


def core_chunks(lines: DataFrame, start_heading: str | None = None, title: str | None = None, least: int = 100) -> DataFrame:
    """The shared requirements of a degree: from its heading of 18 points (its title if none is named) to the next of that size."""
    head, text = F.col("is_heading"), F.col("text")
    own = with_parameters(lines, start_heading=start_heading, title=title)
    rows = headed(own.withColumn("start_heading", F.coalesce(F.nullif("start_heading", F.lit("")), "title")), TITLE_SIZE)
    starts = head & same_heading(text, F.col("start_heading"))
    kept = within(rows, starts, head & ~same_heading(text, F.col("start_heading")))
    facts = degree_facts(F.col("title"))
    out = gathered(kept.withColumn("section", F.lit(0)).withColumn("chunk_type", F.lit("degree_core_requirement")), least).drop("section")
    return out.withColumns({"degree_full_title": F.col("title"), "degree_type": facts["degree_type"], "concentration": F.lit("general")})


def degree_chunks(lines: DataFrame, title: str | None = None, start_heading: str | None = None, concentration: bool | None = None, least: int = 40) -> DataFrame:
    """Requirements, study plan and second language of one degree, or of one concentration of it.

    Reading stops at the heading of another degree, a minor or a certificate. Of a concentration, requirements are the
    lines from the sentence that announces them to the line of total credits, under the degree's title; what else stands
    before the study plan goes.
    """
    text, head, own = F.col("text"), F.col("is_heading"), F.col("title")
    rows = headed(with_parameters(lines, title=title, start_heading=start_heading, is_concentration=concentration), HEADING_SIZE)
    begins = head & (F.col("start_heading") != "") & same_heading(text, F.col("start_heading"))
    other = text.rlike(OTHER_DEGREE) & ~same_heading(text, own) & ~same_heading(text, F.coalesce(F.nullif("start_heading", F.lit("")), own))
    rows = within(rows, begins, head & (other | text.rlike(MINOR_OR_CERTIFICATE))).where(~begins)
    part = F.when(text.rlike(STUDY_PLAN), "study_plan").when(head & text.rlike(SECOND_LANGUAGE), "second_language")
    marked = rows.withColumn("_part", part)
    filled = F.last("_part", ignorenulls=True).over(Window.partitionBy("range_id").orderBy("at"))
    typed = marked.withColumn("chunk_type", F.coalesce(filled, F.lit("degree_requirement")))
    # a further heading of the part that is being read doesn't begin a new one
    changed = F.col("chunk_type") != F.coalesce(F.lag("chunk_type").over(Window.partitionBy("range_id").orderBy("at")), F.lit("degree_requirement"))
    cut = typed.withColumn("_changed", changed).withColumn("section", so_far(F.col("_changed")))
    announced, totals = so_far(collapse(nfkc(text)).rlike(CONCENTRATION)), so_far(text.rlike(TOTAL), upto=-1)
    inside = F.col("is_concentration") & (F.col("chunk_type") == "degree_requirement") & (announced > 0) & (totals == 0)
    cut = cut.withColumn("_inside", inside).where("not is_concentration or _inside or chunk_type <> 'degree_requirement'")
    cut = cut.withColumn("chunk_type", F.when(F.col("_inside"), "concentration_requirement").otherwise(F.col("chunk_type")))
    facts = degree_facts(F.col("title"))
    out = gathered(cut, 1).drop("section")
    led = F.when(F.col("chunk_type") == "concentration_requirement", F.concat_ws("\n", "title", "text")).otherwise(F.col("text"))
    out = out.withColumn("text", led).where(F.length("text") >= least)
    return out.withColumns({"degree_full_title": F.col("title"), **facts, "referenced_courses": codes(F.col("text"), V.CATALOG_CODE), "is_research_related": F.col("text").rlike("(?i)research|thesis|dissertation")})
