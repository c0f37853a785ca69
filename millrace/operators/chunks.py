"""Size-bounded packing of sections into chunks, and what is derived from chunks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.text import collapse, content_id, estimate_tokens, slug, strip
from .ordered import greedy_batches

CHUNK = "array<struct<heading:string,text:string>>"


def _chunk(heading: Column, text: Column) -> Column:
    return F.array(F.struct(heading.alias("heading"), text.alias("text")))


def _none() -> Column:
    return F.from_json(F.lit("[]"), CHUNK)


def split_long(heading: Column, text: Column, most: int) -> Column:
    """Chunks of a long text: paragraphs and sentences joined by blanks up to `most`; a longer one stays whole."""
    parts = F.filter(F.transform(F.split(text, r"\n\n+|\.\s+"), strip), lambda p: p != "")
    zero = F.struct(_none().alias("done"), F.lit("").alias("now"))

    def step(acc: Column, part: Column) -> Column:
        full = (acc["now"] != "") & (F.length(acc["now"]) + F.length(part) + 1 > most)
        done = F.when(full, F.concat(acc["done"], _chunk(heading, acc["now"]))).otherwise(acc["done"])
        now = F.when(full | (acc["now"] == ""), part).otherwise(F.concat_ws(" ", acc["now"], part))
        return F.struct(done.alias("done"), now.alias("now"))

    return F.aggregate(parts, zero, step, lambda a: F.when(a["now"] != "", F.concat(a["done"], _chunk(heading, a["now"]))).otherwise(a["done"]))


def pack_sections(sections: Column, kind: Column, least: int = V.MIN_CHARS, most: int = V.MAX_CHARS) -> Column:
    """Chunks (heading, text) of sections: short ones are merged forward, long ones split, schedules kept whole.

    One fold over the array, in the JVM. The accumulator holds what is done and what waits to be merged.
    """
    full = lambda s: strip(F.when(F.coalesce(s["heading"], F.lit("")) != "", F.concat_ws("\n", s["heading"], strip(s["text"]))).otherwise(s["text"]))
    texts = F.filter(F.transform(sections, lambda s: F.struct(F.coalesce(s["heading"], F.lit("")).alias("heading"), full(s).alias("text"))), lambda s: s["text"] != "")
    zero = F.struct(_none().alias("done"), F.lit("").alias("heading"), F.lit("").alias("text"))

    def step(acc: Column, s: Column) -> Column:
        size, waits = F.length(s["text"]), acc["text"] != ""
        both = F.concat_ws("\n\n", acc["text"], s["text"])
        merged = F.when(waits, both).otherwise(s["text"])
        flushed = F.when(waits, F.concat(acc["done"], _chunk(acc["heading"], acc["text"]))).otherwise(acc["done"])
        first = F.when(waits, acc["heading"]).otherwise(s["heading"])
        short, long = size < least, size > most
        spills = short & (F.length(merged) >= most)
        done = (
            F.when(long, F.concat(flushed, split_long(s["heading"], s["text"], most)))
            .when(spills, F.concat(acc["done"], _chunk(first, merged)))
            .when(short, acc["done"])
            .when(waits & (F.length(both) <= most), F.concat(acc["done"], _chunk(acc["heading"], both)))
            .otherwise(F.concat(flushed, _chunk(s["heading"], s["text"])))
        )
        keeps = short & ~spills
        return F.struct(done.alias("done"), F.when(keeps, first).otherwise("").alias("heading"), F.when(keeps, merged).otherwise("").alias("text"))

    packed = F.aggregate(texts, zero, step, lambda a: F.when(a["text"] != "", F.concat(a["done"], _chunk(a["heading"], a["text"]))).otherwise(a["done"]))
    whole = strip(F.array_join(F.transform(texts, lambda s: s["text"]), " "))
    single = F.when(whole != "", _chunk(F.get(sections, F.lit(0))["heading"], whole)).otherwise(_none())
    return F.when((kind == "course_schedule") & (F.length(whole) <= most), single).otherwise(packed)


def first_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key, in this order."""
    ranked = df.withColumn("_first", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    return ranked.where("_first = 1").drop("_first")


def catalog_level(course_level: Column, degree_level: Column) -> Column:
    """graduate or undergraduate of a course, else of a degree (ms and phd are graduate)."""
    return F.when(course_level == "graduate", "graduate").when(course_level != "", "undergraduate").when(degree_level.isin("ms", "phd"), "graduate").otherwise(F.coalesce(degree_level, F.lit("")))


def catalog_heading(code: Column, course: Column, degree: Column, topic: Column, lab: Column, kind: Column) -> Column:
    """Code and title if there are both, else degree, topic, lab or type, whichever comes first."""
    filled = lambda c: F.nullif(c, F.lit(""))
    named = F.when((code != "") & (course != ""), F.concat_ws(" — ", code, course))
    return F.coalesce(named, filled(degree), filled(topic), filled(lab), kind)


def document_id(year: str, code: Column, degree: Column, kind: Column, page: Column) -> Column:
    """A readable id of a catalog chunk: by its course, else its degree, else its type and page."""
    part = lambda name, value: F.concat_ws("::", F.lit("catalog"), F.lit(year), name, value)
    return F.when(code != "", part(F.lit("course"), slug(code))).when(degree != "", part(F.lit("degree"), slug(degree))).otherwise(part(kind, F.concat(F.lit("p"), page.cast("string"))))


def catalog_source(name: str, year: Column, page: Column) -> Column:
    return F.concat(F.lit(f"{name} "), year, F.lit(", p."), page.cast("string"))


def suffix(code: Column) -> Column:
    last = F.right(strip(code), F.lit(1))
    return F.when(last.isin("G", "V"), last).otherwise("")


def degree_facts(title: Column) -> dict[str, Column]:
    """Degree type, level and concentration from a degree's title; other titles have neither type nor level."""
    low = F.lower(title)
    of = lambda i: F.coalesce(*[F.when(low.contains(phrase), F.lit(facts[i])) for phrase, facts in V.DEGREES.items()], F.lit(""))
    inside = F.regexp_extract(title, r"\(([^)]+)\)", 1)
    return {"degree_type": of(0), "level": of(1), "concentration": F.when(inside != "", F.replace(F.lower(inside), F.lit(" "), F.lit("_"))).otherwise("general")}


def course_facts(code: Column, text: Column, bold: bool = False) -> dict[str, Column]:
    """Prefix, level, credits and prerequisites of a course entry, without regard to case.

    Credits need two characters, as in '3-' or '1-3'; one is enough in entries that were found by bold type, whose
    prefix is all letters before the number.
    """
    clean = collapse(code)
    prefix = strip(F.regexp_extract(clean, r"^([A-Z][A-Z\s]*?)\s*\d" if bold else r"^([A-Z]{1,4}(?:\s[A-Z]{1,4})?)", 1))
    number = F.regexp_extract(clean, r"(\d+)", 1).try_cast("int")
    return {
        "prefix": F.when(prefix == "", F.substring_index(clean, " ", 1)).otherwise(prefix) if bold else prefix,
        "course_level": F.when(number >= 5000, "graduate").otherwise("undergraduate"),
        "credits": F.regexp_extract(text, r"(?i)(\d[\d\-]*)\s*Credits?" if bold else r"(?i)(\d[\d\-]+)\s*Credits?", 1),
        "has_prerequisites": text.rlike("(?i)prerequisite"),
    }


def family(department: Column) -> Column:
    """A known family that the department's name holds, else the name in lower case with underscores, 30 characters."""
    low = F.lower(department)
    named = [F.when(low.contains(f), F.lit(f.replace(" ", "_"))) for f in V.FAMILIES]
    return F.coalesce(*named, F.btrim(F.substring(F.regexp_replace(low, r"(?U)\W+", "_"), 1, 30), F.lit("_")))


def course_records(chunks: DataFrame) -> DataFrame:
    """Rows of the course dimension from chunks of course descriptions: the title is what follows the dash of the heading."""
    own = chunks.where((F.col("chunk_type") == "course_description") & (F.coalesce("course_code", F.lit("")) != ""))
    title = F.when(F.col("heading").contains(" — "), F.regexp_extract("heading", r"(?s)^.*? — (.*)$", 1)).otherwise(F.col("heading"))
    return own.select("course_code", title.alias("course_title"), "credits", suffix(F.col("course_code")).alias("suffix"), "department_id", "campus", "catalog_year")


def counters(chunks: DataFrame, pages: str = "source") -> DataFrame:
    """One row: how many pages gave chunks, and how many chunks there are."""
    return chunks.agg(F.count_distinct(pages).alias("pages_scraped"), F.count("*").alias("chunks_indexed"))


def oversized(df: DataFrame, text: str = "text", tokens: int = V.TOKEN_LIMIT) -> DataFrame:
    """Rows whose text would not fit the token limit, at four characters a token."""
    return df.where(F.length(text) > tokens * 4)


def embedding_batches(df: DataFrame, key: str, text: str = "text", most_rows: int = 64, most_tokens: int = 240_000, group: Column | None = None, group_rows: int = 4096) -> DataFrame:
    """(key, group, tokens, batch): batches of at most so many rows and tokens, in order of key within a group.

    A batch closes at the row that would exceed a limit. Groups are packed independently of each other: by default as
    many hash groups as make about `group_rows` rows each, so there are more of them and not larger ones for more rows.
    """
    if group is None:
        group = F.pmod(F.xxhash64(key), F.lit(max(1, -(-df.count() // group_rows))))
    sized = df.select(key, group.cast("int").alias("group"), estimate_tokens(F.col(text)).alias("tokens"))

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        batch, rows, total, out = 0, 0, 0, []
        for n in pdf["tokens"]:
            if rows and (rows == most_rows or total + n > most_tokens):
                batch, rows, total = batch + 1, 0, 0
            rows, total = rows + 1, total + n
            out.append(batch)
        return pdf.assign(batch=out)

    return sized.groupBy("group").applyInPandas(cut, f"{key} {dict(df.dtypes)[key]}, group int, tokens int, batch int")


def batches_in_order(df: DataFrame, key: str, text: str = "text", most_rows: int = 64, most_tokens: int = 240_000, width: int = 4096) -> DataFrame:
    """(key, tokens, batch): batches of all rows as one order of an integer key, closed where a single pass would close them."""
    return greedy_batches(df.select(key, estimate_tokens(F.col(text)).alias("tokens")), key, "tokens", most_rows, most_tokens, width)


def common_prefixes(courses: DataFrame, prefix: str = "dept_prefix", k: int = 20) -> DataFrame:
    """(prefix, n): the k most frequent prefixes of course descriptions, ties by name; empty and null ones don't count."""
    counts = courses.where(F.col(prefix) != "").groupBy(F.col(prefix).alias("prefix")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "prefix").limit(k)


def legacy_rows(chunks: DataFrame, year: str, scope: str, vectors: DataFrame | None = None) -> DataFrame:
    """Rows of the older store: its fields in order, with the year and scope of the run, and the vector of the chunk's id.

    Fields that chunks lack are empty, false or no list; without `vectors` there is no vector.
    """
    flags, lists, pages = ("has_prerequisites", "is_research_related"), ("program_family", "referenced_courses"), ("catalog_page", "catalog_page_end")

    def field(name: str) -> Column:
        if name in ("catalog_year", "source_scope"):
            return F.lit(year if name == "catalog_year" else scope)
        kind, empty = ("boolean", F.lit(False)) if name in flags else ("array<string>", F.array()) if name in lists else ("int", F.lit(0)) if name in pages else ("string", F.lit(""))
        return F.coalesce(F.col(name).cast(kind), empty.cast(kind)) if name in chunks.columns else empty.cast(kind)

    rows = chunks.select(*[field(c).alias(c) for c in V.LEGACY])
    return rows if vectors is None else rows.join(vectors.select("chunk_id", "vector"), "chunk_id", "left").select(*V.LEGACY, "vector")


def quality_issues(chunks: DataFrame) -> DataFrame:
    """(chunk_id, issue): one row for each rule that a chunk breaks."""
    kind = F.col("chunk_type")
    issue = lambda broken, name: F.when(broken, F.lit(name))
    found = F.array(
        issue((kind == "research") & (F.col("lab") == ""), "lab missing"),
        issue((kind == "policy") & (F.col("policy_topic") == ""), "topic missing"),
        issue((kind == "grad_program_info") & (F.col("policy_topic") == ""), "graduate topic missing"),
        issue(kind.isin("degree_requirement", "degree_core_requirement") & (F.col("degree_full_title") == ""), "title missing"),
        issue(F.length("text") < 80, "short text"),
    )
    return chunks.select("chunk_id", F.explode(F.array_compact(found)).alias("issue"))


def type_histogram(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("chunk_type").agg(F.count("*").alias("n"))


def with_ids(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("chunk_id", content_id(F.col(text)))


def where_all(df: DataFrame, tests: list[Column | None]) -> DataFrame:
    """The rows that meet every test that is given."""
    for test in tests:
        if test is not None:
            df = df.where(test)
    return df


def filter_chunks(chunks: DataFrame, *, chunk_type: str | None = None, level: str | None = None, degree_type: str | None = None, degree_level: str | None = None, concentration: str | None = None, department: str | None = None, family: str | None = None, research: bool | None = None, prefix: str | None = None, title: str | None = None, references: str | None = None, code_prefix: str | None = None, topic: str | None = None) -> DataFrame:
    """The chunks that meet every given condition; names and topics by a part of them, without regard to case."""
    has = lambda column, part: F.lower(column).contains(part.lower())
    return where_all(chunks, [
        None if not chunk_type else F.col("chunk_type") == chunk_type,
        None if not level else F.col("level") == level,
        None if not degree_type else F.col("degree_type") == degree_type,
        None if not degree_level else F.col("degree_level") == degree_level,
        None if not concentration else has("concentration", concentration),
        None if not department else has("dept_name", department),
        None if not family else F.array_contains("program_family", family),
        None if research is None else F.col("is_research_related") == research,
        None if not prefix else F.col("dept_prefix").startswith(prefix),
        None if not title else has("degree_full_title", title),
        None if not references else F.array_contains("referenced_courses", references),
        None if not code_prefix else F.col("course_code").startswith(code_prefix),
        None if not topic else has("policy_topic", topic),
    ])


def filter_courses(chunks: DataFrame, *, prefix: str | None = None, level: str | None = None, prerequisites: bool | None = None, title: str | None = None, code: str | None = None) -> DataFrame:
    """The course descriptions that meet every given condition."""
    return where_all(chunks.where(F.col("chunk_type") == "course_description"), [
        None if not prefix else F.col("dept_prefix") == prefix.strip(),
        None if not level else F.col("course_number_level") == level,
        None if prerequisites is None else F.col("has_prerequisites") == prerequisites,
        None if not title else F.lower("course_title").contains(title.lower()),
        None if not code else F.upper("course_code").contains(code.upper()),
    ])


def find_course(chunks: DataFrame, code: str, order: str = "chunk_id") -> DataFrame:
    """The first chunk, in this order, of a course; white space and case aside."""
    return chunks.where(F.upper(collapse(F.col("course_code"))) == F.upper(collapse(F.lit(code)))).orderBy(order).limit(1)
