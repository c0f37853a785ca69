"""Structured lookups over a course dimension (course_code, course_title, credits, suffix, catalog_year)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.english import asked as lexemes_asked
from ..functions.english import lexemes, match_rank
from ..functions.text import strings


def latest(courses: DataFrame) -> DataFrame:
    """The latest year of each code, years compared as text."""
    w = Window.partitionBy("course_code").orderBy(F.desc("catalog_year"))
    return courses.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def by_suffix(courses: DataFrame, suffix: str, prefix: str = "") -> DataFrame:
    found = courses.where(F.upper("suffix") == suffix.upper())
    if prefix:
        found = found.where(F.upper("course_code").like(f"{prefix.upper()}%"))
    return found.orderBy("course_code")


def same_code(code: Column, asked: Column) -> Column:
    bare = lambda c: F.upper(F.replace(c, F.lit(" "), F.lit("")))
    return bare(code) == bare(asked)


def by_code(courses: DataFrame, codes: DataFrame) -> DataFrame:
    """The latest row of each code asked for (column asked), blanks and case aside."""
    keyed = courses.withColumn("_key", F.upper(F.replace("course_code", F.lit(" "), F.lit(""))))
    wanted = codes.withColumn("_key", F.upper(F.replace("asked", F.lit(" "), F.lit(""))))
    w = Window.partitionBy("asked").orderBy(F.desc("catalog_year"), "course_code")
    return wanted.join(keyed, "_key").withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank", "_key")


def by_title(courses: DataFrame, query: Column, k: int = 5) -> DataFrame:
    """The k best rows whose title has every lexeme of the query (English stems, no stop words), ranked by `match_rank`."""
    both = courses.withColumn("_want", lexemes_asked(query)).withColumn("_held", lexemes(F.col("course_title")))
    found = both.where((F.size("_want") > 0) & (F.size(F.array_except("_want", "_held")) == 0))
    ranked = found.withColumn("rank", match_rank(F.col("_held"), F.col("_want"))).drop("_want", "_held")
    return ranked.orderBy(F.desc("rank"), F.desc("catalog_year"), "course_code").limit(k)


def clear_winner(hits: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """The best hit of each query, if it is the only one or ranks more than twice as high as the second."""
    w = Window.partitionBy(by).orderBy(F.desc("rank"), *order)
    ranked = hits.withColumn("_n", F.row_number().over(w)).withColumn("_second", F.lead("rank").over(w))
    return ranked.where((F.col("_n") == 1) & (F.col("_second").isNull() | (F.col("rank") > 2 * F.col("_second")))).drop("_n", "_second")


def answer(kind: Column, code: Column, title: Column, credits: Column, suffix: Column, year: Column, catalog: str = "Academic Catalog") -> Column:
    """A sentence about a course's credits or about what its suffix counts toward."""
    # The sentences, but for the catalog's name.
    course, where = F.concat_ws(" — ", code, title), F.concat(F.lit(f"({catalog} "), year, F.lit(")."))
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    general = F.when(suffix == "G", say("Yes. ", course, " has a 'G' suffix, which means it counts toward General Education requirements ", where))
    general = general.when(suffix == "V", say("No. ", course, " has a 'V' suffix, not 'G'. It counts toward Viewing a Wider World (VWW) requirements, not General Education ", where))
    general = general.otherwise(say("No. ", course, " does not carry a 'G' suffix, so it does not count toward General Education requirements ", where))
    wider = F.when(suffix == "V", say("Yes. ", course, " has a 'V' suffix, which means it counts toward Viewing a Wider World (VWW) requirements ", where))
    wider = wider.when(suffix == "G", say("No. ", course, " has a 'G' suffix, not 'V'. It counts toward General Education requirements, not VWW ", where))
    wider = wider.otherwise(say("No. ", course, " does not carry a 'V' suffix, so it does not count toward Viewing a Wider World requirements ", where))
    return F.when(kind == "credits", say(course, " carries ", credits, " credit(s) ", where)).when(kind == "general_education", general).when(kind == "wider_world", wider)


#: What a suffix is called in lists.
LABELS = {"G": "General Education (G)", "V": "Viewing a Wider World (V)"}


def course_list(courses: DataFrame, asked: DataFrame, catalog: str = "Academic Catalog") -> DataFrame:
    """(asked's columns, listing): the courses of a suffix and of a department's prefix (empty: all), one to a line, by code.

    asked has suffix and prefix and is small. Without any such course the listing says so; the catalog's year is that
    of the first course.
    """
    # The sentences around the list.
    label = F.coalesce(*[F.when(F.col("suffix") == k, F.lit(v)) for k, v in LABELS.items()], F.col("suffix"))
    held = courses.select(F.upper("suffix").alias("_suffix"), "course_code", "course_title", "credits", "catalog_year")
    line = F.concat(F.lit("- "), F.col("course_code"), F.lit(" — "), F.col("course_title"), F.when(F.coalesce("credits", F.lit("")) != "", F.concat(F.lit(" ("), F.col("credits"), F.lit(" cr.)"))).otherwise(""))
    wanted = F.broadcast(asked.select("suffix", "prefix").distinct())  # suffixes x departments
    found = held.join(wanted, (F.col("_suffix") == F.upper("suffix")) & F.upper("course_code").startswith(F.upper("prefix")))
    item = F.struct("course_code", "catalog_year", line.alias("line"))
    lists = found.groupBy("suffix", "prefix").agg(F.array_sort(F.collect_list(item)).alias("rows"))  # an answer, so as long as one may be
    within = F.when(F.col("prefix") != "", F.concat(F.lit(" in "), F.col("prefix"))).otherwise("")
    year = F.get("rows", F.lit(0))["catalog_year"]
    foot = F.when(F.coalesce(year, F.lit("")) != "", F.concat(F.lit(f"\n\nSource: {catalog} "), year, F.lit("."))).otherwise("")
    full = F.concat(F.lit("The following"), within, F.lit(" courses carry a "), label, F.lit(" suffix:\n\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), foot)
    none = F.concat(F.lit("No courses"), within, F.lit(" with a "), label, F.lit(" suffix were found in the course lookup table."))
    return asked.join(lists, ["suffix", "prefix"], "left").withColumn("listing", F.when(F.col("rows").isNull(), none).otherwise(full)).drop("rows")


def in_set(value: Column, values: list[str]) -> Column:
    return F.array_contains(strings(values), value)
