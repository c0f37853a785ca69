"""Page-layout text: characters to lines, lines to sections and entries. All of it is window and aggregate code.

Characters: page, text, x0, x1, top, size, fontname. Lines: page, line_no, text, top, x0, size, col, is_header.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.text import codes, collapse, strip

# The column split, the height of a line, the gap that makes a blank, where headers end, heading sizes.
COLUMN_X, LINE_HEIGHT, GAP, HEADER_Y, HEADING_SIZE, TITLE_SIZE = 306.0, 3, 1.5, 45.0, 12.0, 18.0
# Forms of a running header, but for the institution's name, which is a parameter.
RUNNING = [r"^\d{1,4}\s{2,}", r"^\d{3,4}\s+[A-Z]", r"^[A-Z][A-Za-z ,\-]+\s{2,}\d{1,4}$"]
# Fixed value: how the text after a code begins where it is no title.
NO_TITLE = r"(?i)^(?:May\s+be\b|Cannot\s+be\b|\d+\s*(?:to|[-–])\s*\d+\s+Credit|Prerequisites?\b|Cross[\s-]listed|Formerly\b)"
# Fixed value: a course entry in the variant that looks at bold type.
BOLD_ENTRY = r"^([A-Z][A-Z\s]{0,5}\s*\d{3,4}[A-Z]?)\.\s+(.+)$"


def is_running_header(text: Column, institution: str | None = None) -> Column:
    forms = [*RUNNING, *([f"^{institution}"] if institution else [])]
    found = F.lit(False)
    for form in forms:
        found = found | text.rlike(form)
    return found


def lines_of_chars(chars: DataFrame, bold: bool = False, institution: str | None = None) -> DataFrame:
    """Lines of text from positioned characters, one aggregate over (page, column, height).

    The column is that of a character's middle (of its left edge if bold). Characters go by x0; a gap wider than GAP
    becomes a blank (not if bold). If bold, running headers are left out and bold_start says how a line's first
    character is set.
    """
    middle = (F.col("x0") + F.coalesce("x1", F.col("x0") + F.col("size") * 0.55)) / 2
    placed = chars.where("text <> ''").withColumn("col", F.when((F.col("x0") if bold else middle) < COLUMN_X, "L").otherwise("R"))
    placed = placed.withColumn("bucket", (F.bround(F.col("top") / LINE_HEIGHT) * LINE_HEIGHT).cast("int"))
    own = F.struct("x0", F.coalesce("x1", F.col("x0") + 3).alias("x1"), "text", F.coalesce("fontname", F.lit("")).alias("fontname"))
    grouped = placed.groupBy("page", "col", "bucket").agg(F.array_sort(F.collect_list(own)).alias("cs"), F.avg("size").alias("size"), F.avg("top").alias("top"), F.min("x0").alias("x0"))
    zero = F.struct(F.lit("").alias("text"), F.lit(None).cast("double").alias("end"))
    gap = F.lit(False) if bold else None

    def step(acc: Column, c: Column) -> Column:
        wide = gap if gap is not None else F.coalesce(c["x0"] - acc["end"] > GAP, F.lit(False))
        return F.struct(F.concat(acc["text"], F.when(wide, " ").otherwise(""), c["text"]).alias("text"), c["x1"].cast("double").alias("end"))

    text = strip(F.aggregate("cs", zero, step, lambda a: a["text"]))
    header = (F.col("top") < HEADER_Y) & is_running_header(F.col("text"), institution)
    lines = grouped.withColumn("text", text).where("text <> ''").withColumn("is_header", header)
    lines = lines.withColumn("bold_start", F.lower(F.get("cs", F.lit(0))["fontname"]).contains("bold"))
    order = Window.partitionBy("page").orderBy("col", "bucket")
    out = lines.where("not is_header") if bold else lines
    return out.select("page", F.row_number().over(order).alias("line_no"), "text", "top", "x0", "size", "col", "is_header", *(["bold_start"] if bold else []))


def reading_order(lines: DataFrame, skip_headers: bool = True) -> DataFrame:
    """(page, text): the left column from the top, then the right one."""
    kept = lines.where("not is_header") if skip_headers else lines
    return kept.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "top", "text"))), lambda x: x["text"]), "\n").alias("text"))


def toc_entries(lines: DataFrame) -> DataFrame:
    """(catalog_page, title, indent, section_type) of the dotted lines of a table of contents, by page.

    Running headers, entries without a title and pages below 1 are left out.
    """
    title = strip(F.regexp_extract("text", V.TOC_LINE, 1))
    page = F.regexp_extract("text", V.TOC_LINE, 2).try_cast("int")
    found = lines.where(~F.col("is_header") & F.col("text").rlike(V.TOC_LINE))
    return found.select(page.alias("catalog_page"), title.alias("title"), F.col("x0").alias("indent"), section_type(title).alias("section_type")).where("title <> '' and catalog_page >= 1").orderBy("catalog_page")


def section_type(title: Column) -> Column:
    """A section's type by what its title holds, first match."""
    low = F.lower(title)
    # Phrase and type, in the order in which they are tried.
    rules = [
        ("bachelor of arts", "degree_ba"),
        ("bachelor of science", "degree_bs"),
        ("master of", "degree_ms"),
        ("doctor of", "degree_phd"),
        ("undergraduate minor", "minor_undergrad"),
        ("graduate minor", "minor_grad"),
        ("graduate certificate", "certificate"),
        ("research facilit", "research"),
        ("graduate school", "grad_program_info"),
        ("transfer", "policy"),
        ("veteran", "policy"),
        ("military", "policy"),
        ("international student", "policy"),
        ("financial aid", "policy"),
        ("tuition", "policy"),
    ]
    return F.coalesce(*[F.when(low.contains(phrase), F.lit(kind)) for phrase, kind in rules], F.lit("general"))


def page_ranges(entries: DataFrame, by: list[str] | None = None, segment: int = 512) -> DataFrame:
    """(by, catalog_page, title, indent, end_page): the page before the next entry that is indented no deeper, else the last of all.

    Entries go by (page, title, indent) within each document (the columns `by`; without any all entries are one document's). An
    entry counts at its own level and at all deeper ones of its document, so the next entry of its level is the one looked for.
    It is looked for within a segment of pages first, and then among the first entries of later segments, so windows are over a
    segment, or over the segments, of one level. Entries x levels rows are made; a document's levels should be few.
    """
    keys = [f"_g{i}" for i in range(len(by or []))]
    own = entries.select(*[F.col(c).alias(k) for c, k in zip(by or [], keys)], "catalog_page", "title", "indent")
    same = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys], F.lit(True))
    levels = own.where("indent is not null").select(*keys, F.col("indent").alias("_level")).distinct()
    seen = own.alias("e").join(levels.alias("l"), same("e", "l") & (F.col("_level") >= F.col("indent"))).select("e.*", "_level", F.floor(F.col("catalog_page") / segment).alias("_seg"))
    at = Window.partitionBy(*keys, "_level", "_seg").orderBy("catalog_page", "title", "indent")
    near = seen.withColumn("_near", F.lead("catalog_page").over(at))
    starts = seen.groupBy(*keys, "_level", "_seg").agg(F.min("catalog_page").alias("_first"))
    later = starts.withColumn("_later", F.lead("_first").over(Window.partitionBy(*keys, "_level").orderBy("_seg")))
    found = near.where("_level = indent").alias("e").join(later.alias("l"), same("e", "l") & (F.col("e._level") == F.col("l._level")) & (F.col("e._seg") == F.col("l._seg")))
    found = found.select(*[f"e.{c}" for c in own.columns], F.coalesce("_near", "_later").alias("_next"))
    bare = own.where("indent is null").withColumn("_next", F.lit(None).cast(dict(own.dtypes)["catalog_page"]))
    last = own.groupBy(*keys).agg(F.max("catalog_page").alias("_last"))
    both = found.union(bare).alias("e").join(last.alias("l"), same("e", "l"))
    end = F.greatest(F.coalesce(F.col("_next") - 1, "_last"), F.col("catalog_page"))
    return both.select(*[F.col(f"e.{k}").alias(c) for k, c in zip(keys, by or [])], "catalog_page", "title", "indent", end.alias("end_page"))


def islands(df: DataFrame, flag: str, by: str, order: str, name: str = "island") -> DataFrame:
    """Number runs of rows: a run begins where the flag turns true after a row where it was not."""
    w = Window.partitionBy(by).orderBy(order)
    starts = F.col(flag) & ~F.coalesce(F.lag(flag).over(w), F.lit(False))
    return df.withColumn("_start", starts.cast("int")).withColumn(name, F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_start")


def section_ids(df: DataFrame, boundary: str, by: str, order: str, name: str = "section") -> DataFrame:
    """The number of boundary rows up to and with each row."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.col(boundary).cast("int")).over(w))


def _sections(lines: DataFrame, by: str) -> DataFrame:
    at = F.struct("page", "line_no")
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "line_no", F.col(c).alias("t")))), lambda x: x["t"]), "\n")
    return lines.groupBy(by, "section").agg(ordered("text").alias("body"), F.min(at)["page"].alias("catalog_page"))


def heading_chunks(lines: DataFrame, by: str = "range_id", size: float = HEADING_SIZE, least: int = 120, preset: str | None = None, keep: Column | None = None, code: str = V.CATALOG_CODE) -> DataFrame:
    """(by, catalog_page, topic, text): a chunk for each heading of the lines of a page range, at least 120 characters.

    Headings that follow each other are one, joined by blanks, and lead the chunk's text. What stands before the first
    heading has the topic that the column `preset` gives, and goes if that is empty, unless `keep` holds. `code` is the form of course codes.
    """
    before, stays = (F.coalesce(F.col(preset), F.lit("")) if preset else F.lit("")), (keep if keep is not None else F.lit(False))
    own = lines.where("not is_header").withColumn("_at", F.struct("page", "line_no")).withColumn("_heads", F.col("size") >= size).withColumn("_before", before).withColumn("_stays", stays)
    cut = islands(own, "_heads", by, "_at", "section")
    order = F.array_sort(F.collect_list(F.when(F.col("_heads"), F.struct("page", "line_no", "text"))))
    head = F.array_join(F.transform(order, lambda x: x["text"]), " ")
    topics = cut.groupBy(by, "section").agg(head.alias("head"), F.min("page").alias("catalog_page"), F.first("_before").alias("_before"), F.first("_stays").alias("_stays"))
    bodies = _sections(cut.where("not _heads"), by).select(by, "section", "body")
    whole = topics.join(bodies, [by, "section"], "left").withColumn("text", strip(F.concat_ws("\n", F.nullif("head", F.lit("")), "body")))
    named = whole.withColumn("topic", F.when(F.col("head") != "", F.col("head")).otherwise(F.col("_before")))
    return named.where(((F.col("topic") != "") | F.col("_stays")) & (F.length("text") >= least)).select(by, "catalog_page", "topic", "text", codes(F.col("text"), code).alias("referenced_courses"))


def course_chunks(lines: DataFrame, by: str = "range_id", bold: bool = False, least: int = 30, most: int = 32_000) -> DataFrame:
    """(by, catalog_page, course_code, course_title, text): an entry from each course heading to the next.

    With bold, a heading must also start in bold type, not follow a line that ends in and / or / &, and have a title
    that reads like one. Entries are split within `by`, so that an entry that crosses pages stays whole.
    """
    own = lines.where("not is_header").withColumn("_at", F.struct("page", "line_no"))
    pattern = BOLD_ENTRY if bold else V.COURSE_ENTRY
    heads = F.col("text").rlike(pattern)
    if bold:
        before = F.lag("text").over(Window.partitionBy(by).orderBy("_at"))
        heads = heads & F.col("bold_start") & ~F.coalesce(strip(before).rlike(r" (?:and|or|&)$"), F.lit(False)) & ~F.regexp_extract("text", pattern, 2).rlike(NO_TITLE)
    cut = section_ids(own.withColumn("_heads", heads), "_heads", by, "_at").where("section > 0")
    first = cut.where("_heads").select(by, "section", strip(F.regexp_extract("text", pattern, 1)).alias("course_code"), strip(F.regexp_extract("text", pattern, 2)).alias("course_title"))
    bodies = _sections(cut, by).withColumn("text", F.substring(strip(F.col("body")), 1, most))
    return bodies.join(first, [by, "section"]).where(F.length("text") >= least).select(by, "catalog_page", "course_code", "course_title", "text")


def titled_chunks(lines: DataFrame, by: str = "range_id", least: int = 40) -> DataFrame:
    """(by, catalog_page, title, text, dept_name): a chunk for each title of 18 points, which leads its text in one line.

    Titles that follow each other are one, joined by blanks. The first heading of 12 to 17 points ends the range. Where lines
    have a start_heading, reading begins with the titles that make it up (but for case and white space), as a title of its own;
    without one, what stands before the first title is a chunk without a title, on the range's start_page if lines have it.
    """
    blank = F.lit("")
    start = collapse(F.lower(F.coalesce("start_heading", blank))) if "start_heading" in lines.columns else blank
    dept = F.coalesce("dept_name", blank) if "dept_name" in lines.columns else blank
    page = F.col("start_page") if "start_page" in lines.columns else F.col("page")
    own = lines.where("not is_header").select(by, "page", "text", "size", F.struct("page", "line_no").alias("_at"), start.alias("_wanted"), dept.alias("dept_name"), page.alias("_first_page"))
    own = islands(own.withColumn("_big", F.col("size") >= TITLE_SIZE), "_big", by, "_at", "_run")
    order = Window.partitionBy(by).orderBy("_at")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    # a run of titles up to each of its lines, where a start heading is looked for
    here = F.collect_list(F.when(F.col("_big") & (F.col("_wanted") != ""), F.col("text"))).over(Window.partitionBy(by, "_run", "_big").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    told = own.withColumn("_told", F.array_join(here, " "))
    starts = F.col("_big") & (F.col("_wanted") != "") & (collapse(F.lower("_told")) == F.col("_wanted"))
    begun = told.withColumn("_starts", F.sum(starts.cast("int")).over(upto)).withColumn("_begins", starts & (F.col("_starts") == 1))
    read = begun.where("_wanted = '' or _starts > 0").withColumn("text", F.when(F.col("_begins"), F.col("_told")).otherwise(F.col("text")))
    stopped = F.sum((~F.col("_big") & (F.col("size") >= HEADING_SIZE)).cast("int")).over(upto)
    read = read.withColumn("_stopped", stopped).where("_stopped = 0")
    goes_on = F.lag(F.col("_big") & ~F.col("_begins"), 1, False).over(order)
    cut = read.withColumn("_new", (F.col("_begins") | (F.col("_big") & ~goes_on)).cast("int")).withColumn("_section", F.sum("_new").over(upto))
    some = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("_at", "text")))), lambda x: x["text"])
    out = cut.groupBy(by, "_section").agg(F.array_join(some(F.col("_big")), " ").alias("title"), F.array_join(some(~F.col("_big")), "\n").alias("_body"), F.min("_at")["page"].alias("_page"), F.min("_first_page").alias("_first_page"), F.first("dept_name").alias("dept_name"))
    out = out.withColumn("text", strip(F.concat_ws("\n", F.nullif("title", blank), "_body"))).where(F.length("text") >= least)
    return out.select(by, F.when(F.col("_section") > 0, F.col("_page")).otherwise(F.col("_first_page")).alias("catalog_page"), "title", "text", "dept_name")


#: Pages that a bucket of the join below has.
PAGES = 16


def in_plan(lines: DataFrame, plan: DataFrame) -> DataFrame:
    """Lines with each row of the section plan that their page lies in (start_page <= page <= end_page).

    An interval join: a range goes to every bucket of PAGES pages that it meets, lines to the bucket of their page, and bounds are
    compared within buckets. Ranges that overlap give a line to each of them; those that end before they start have none.
    """
    bucket = lambda c: F.floor(F.col(c) / PAGES)
    ranges = plan.where("start_page <= end_page").withColumn("_bucket", F.explode(F.sequence(bucket("start_page"), bucket("end_page"))))
    both = lines.withColumn("_bucket", bucket("page")).join(ranges, "_bucket")
    return both.where((F.col("page") >= F.col("start_page")) & (F.col("page") <= F.col("end_page"))).drop("_bucket")
