"""Text functions, Column to Column."""

from __future__ import annotations

import datetime as dt
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import vocabulary as V


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def any_of(tokens: Column, values) -> Column:
    """Whether an array of tokens has one of the values."""
    return F.arrays_overlap(tokens, strings(values))


def has_phrase(text: Column, phrases) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in phrases])


def collapse(text: Column) -> Column:
    """White space (of Unicode) to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip(text: Column) -> Column:
    """No white space (of Unicode) at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility forms unified (NFKC), an Arrow batch at a time: no built-in function does this."""
    return text.str.normalize("NFKC")


def tokenize(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits without stop words, repeats kept."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(V.STOPWORDS))


def expand_acronyms(text: Column) -> Column:
    """The text and, after it, the long form of each acronym that it has as a word (in capitals)."""
    return F.concat_ws(" ", text, *[F.when(text.rlike(rf"\b{a}\b"), F.lit(long)) for a, long in V.ACRONYMS.items()])


def first_code(heading: Column, text: Column) -> Column:
    """The first course code in a heading and the first 500 characters of the text under it, else empty."""
    return collapse(F.regexp_extract(F.concat_ws("\n", heading, F.substring(text, 1, 500)), V.PAGE_CODE, 1))


def codes(text: Column, pattern: str = V.PAGE_CODE) -> Column:
    """The distinct course codes of a text, sorted, white space collapsed."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, collapse)))


def content_id(text: Column) -> Column:
    """The first 16 hexadecimal digits of the text's SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def uuid5_url(name: Column) -> Column:
    """Version-5 UUID of a name in the URL name space."""
    digest = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), F.encode(name, "UTF-8")))
    variant = F.substring(F.lower(F.hex(F.conv(F.substring(digest, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(0x3F)).bitwiseOR(F.lit(0x80)))), -2, 2)
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 19, 2)), F.substring(digest, 21, 12))


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor((F.length(text) + 3) / 4)).cast("int")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(text, "[^A-Za-z0-9]+", "-")), "^-+|-+$", "")


def parse_bool(text: Column) -> Column:
    """true and false words, else null."""
    word = F.upper(strip(text))
    return F.when(word.isin("TRUE", "YES", "1", "T", "Y"), True).when(word.isin("FALSE", "NO", "0", "F", "N"), False)


def env_flag(text: Column) -> Column:
    return F.coalesce(F.lower(strip(text)).isin("1", "true", "yes", "on"), F.lit(False))


def joined(items: Column) -> Column:
    """An array as one field, null as empty."""
    return F.coalesce(F.array_join(items, " | "), F.lit(""))


def cut_at_word(text: Column, most: int) -> Column:
    """The first characters of a text, at most so many, back to their last blank if there is one after the first."""
    head = F.substring(text, 1, most)
    return F.coalesce(F.nullif(strip(F.regexp_extract(head, r"(?s)^(.+) ", 1)), F.lit("")), head)


def split_questions(text: Column) -> Column:
    """The text before the first question marker and one piece for each marker."""
    return F.split(text, r"(?=(?<!\w)Q\d+[\s.])")


def question_sections(heading: Column, text: Column) -> Column:
    """array<struct<heading,text>>: a section for each question, if there are two markers or more, else the one section.

    The text before the first marker is a section if it is longer than 50 characters. A question's heading is its first
    200 characters, back to a blank.
    """
    pieces = split_questions(text)
    single = F.array(F.struct(heading.alias("heading"), text.alias("text")))
    marks = F.regexp_count(text, F.lit(V.QUESTION_MARKER))
    starts = text.rlike(r"^Q\d+[\s.]")
    lead = F.when(starts, F.lit("")).otherwise(F.get(pieces, F.lit(0)))
    questions = F.when(starts, F.filter(pieces, lambda p: p != "")).otherwise(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))))
    made = F.transform(questions, lambda q: F.struct(cut_at_word(strip(q), 200).alias("heading"), strip(q).alias("text")))
    before = F.when(F.length(lead) > 50, F.array(F.struct(heading.alias("heading"), strip(lead).alias("text")))).otherwise(F.slice(single, 1, 0))
    return F.when(marks >= 2, F.concat(before, made)).otherwise(single)


SEASONS = ("Spring", "Summer", "Fall")


def season_index(day: Column) -> Column:
    """1 Spring, 2 Summer (from 20 May), 3 Fall (from 15 August)."""
    mmdd = F.month(day) * 100 + F.dayofmonth(day)
    return F.when(mmdd < 520, 1).when(mmdd < 815, 2).otherwise(3)


def season_name(index: Column) -> Column:
    return F.element_at(strings(SEASONS), index.cast("int"))


def semester(day: Column) -> Column:
    return F.concat_ws(" ", season_name(season_index(day)), F.year(day).cast("string"))


def expand_dates(text: Column, day: Column) -> Column:
    """Relative semesters and years as named ones: this / next / last semester, year, fall, spring and summer.

    this <season>: of this year if it is not over yet, else of the next. next <season>: the first one that begins after
    the current season. last <season>: the latest one before the current season. next and last semester skip summers.
    """
    now, year = season_index(day), F.year(day)

    def replaced(t: Column, phrase: str, value: Column) -> Column:
        return F.regexp_replace(t, F.lit(rf"(?i)\b{phrase}\b"), value)

    def named(index, y: Column) -> Column:
        return F.concat_ws(" ", season_name(index if isinstance(index, Column) else F.lit(index)), y.cast("string"))

    out = replaced(text, r"(?:this|current)\s+semester", named(now, year))
    out = replaced(out, r"next\s+semester", F.when(now == 3, named(1, year + 1)).otherwise(named(3, year)))
    out = replaced(out, r"(?:last|previous)\s+semester", F.when(now == 1, named(3, year - 1)).otherwise(named(1, year)))
    out = replaced(out, r"(?:this|current)\s+year", year.cast("string"))
    out = replaced(out, r"next\s+year", (year + 1).cast("string"))
    out = replaced(out, r"(?:last|previous)\s+year", (year - 1).cast("string"))
    for index in (3, 1, 2):
        word = SEASONS[index - 1].lower()
        out = replaced(out, rf"this\s+{word}", named(index, F.when(now <= index, year).otherwise(year + 1)))
        out = replaced(out, rf"next\s+{word}", named(index, F.when(now < index, year).otherwise(year + 1)))
        out = replaced(out, rf"(?:last|previous)\s+{word}", named(index, F.when(now > index, year).otherwise(year - 1)))
    return out


def department_prefix(text: Column) -> Column:
    """The first word of 2-5 capitals, else the department of the first keyword that the text holds, else null."""
    capitals = F.regexp_extract(text, r"\b([A-Z]{2,5})\b", 1)
    by_word = F.coalesce(*[F.when(F.lower(text).contains(k), F.lit(v)) for k, v in V.DEPARTMENTS.items()])
    return F.when(capitals != "", capitals).otherwise(by_word)


def title_words(text: Column) -> Column:
    """What is left of a question to search titles with."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
    return F.array_join(F.filter(found, lambda t: ~t.isin(V.TITLE_NOISE)), " ")


def question_type(text: Column) -> Column:
    """general_education, wider_world or credits, with list_ before it where courses are asked for; else null."""
    low = F.lower(text)
    kind = F.when(has_phrase(low, V.GENERAL_EDUCATION_PHRASES), "general_education").when(has_phrase(low, V.WIDER_WORLD_PHRASES), "wider_world").when(has_phrase(low, V.CREDIT_PHRASES), "credits")
    asks = (low.contains("what ") | low.contains("which ")) & low.contains("courses") & (kind != "credits")
    return F.when(asks, F.concat(F.lit("list_"), kind)).otherwise(kind)


def asks_availability(text: Column) -> Column:
    low = F.lower(text)
    found = F.regexp_extract_all(low, F.lit("[a-z]+"), F.lit(0))
    return any_of(found, V.AVAILABILITY) & has_phrase(low, V.SEMESTER_PHRASES)


def as_date(value: str | dt.date) -> Column:
    return F.lit(value).cast("date")
