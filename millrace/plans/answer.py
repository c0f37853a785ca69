"""Answering questions in batches: redirects and lookups first, then retrieval, prompts and an injected model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vocabulary as V
from ..functions.english import asked as lexemes_asked
from ..functions.english import lexemes, match_rank
from ..functions.text import asks_availability, codes, department_prefix, question_type, semester, title_words
from ..operators import evaluate as E
from ..operators import lookup as U
from .embedding import embed  # noqa: F401  part of this interface
from .retrieve import search


def generate(df: DataFrame, function: Callable[[str], str], prompt: str = "prompt", name: str = "answer") -> DataFrame:
    """Add a model's text for each prompt, by an injected function; a failure gives null and the message in `error`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out, errors = [], []
            for p in rows.column(prompt).to_pylist():
                try:
                    out.append(function(p))
                    errors.append(None)
                except Exception as e:  # one bad call must not lose the batch
                    out.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(out, pa.string()), pa.array(errors, pa.string())], [*rows.schema.names, name, "error"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.StringType()), T.StructField("error", T.StringType())]))


def prompt(question: Column, context: Column, day: Column, rules: str) -> Column:
    return F.concat_ws("\n\n", F.lit(rules), F.concat(F.lit("Today: "), F.date_format(day, "yyyy-MM-dd"), F.lit(" ("), semester(day), F.lit(")")), F.concat(F.lit("Context:\n"), context), F.concat(F.lit("Question: "), question))


def judge_prompt(question: Column, answer: Column, facts: Column, note: Column, rules: str) -> Column:
    noted = F.when(F.coalesce(note, F.lit("")) != "", F.concat(F.lit("Note: "), note))
    return F.concat_ws("\n\n", F.lit(rules), F.concat(F.lit("Question: "), question), F.concat(F.lit("Answer: "), answer), F.concat(F.lit("Facts:\n- "), F.array_join(facts, "\n- ")), noted)


def lookups(questions: DataFrame, courses: DataFrame) -> DataFrame:
    """(question_id, answer) of the questions that the course dimension answers, by list, code or title.

    Lists need the suffix and, if the question has one, the department, and answer also that there is no such course;
    codes take the latest year of the first code that is known; titles are looked for in all years, and count only
    where one row is the sole hit or ranks more than twice as high as the next.
    """
    t = F.col("text")
    kinds = questions.withColumn("kind", question_type(t)).where("kind is not null")
    listing = kinds.where(F.col("kind").startswith("list_")).withColumn("suffix", F.when(F.col("kind") == "list_general_education", "G").otherwise("V")).withColumn("prefix", F.coalesce(department_prefix(t), F.lit("")))
    lists = U.course_list(courses, listing.select("question_id", "suffix", "prefix")).select("question_id", F.col("listing").alias("answer"))
    single = kinds.where(~F.col("kind").startswith("list_"))
    asked = single.select("question_id", "kind", F.posexplode(codes(F.upper(t), V.QUESTION_CODE)).alias("i", "asked"))
    by_code = U.by_code(courses, asked.select("asked").distinct()).join(asked, "asked")
    first = by_code.groupBy("question_id").agg(F.min_by(F.struct("kind", "course_code", "course_title", "credits", "suffix", "catalog_year"), "i").alias("c"))
    rest = single.join(first, "question_id", "left_anti").withColumn("want", lexemes_asked(title_words(t))).where("size(want) > 0")
    titled = courses.withColumn("held", lexemes(F.col("course_title")))
    hits = rest.select("question_id", "kind", "want", F.explode("want").alias("term")).join(titled.select("*", F.explode(F.array_distinct("held")).alias("term")), "term")
    full = hits.groupBy("question_id", "kind", "course_code", "course_title", "credits", "suffix", "catalog_year", "held", "want").agg(F.count("*").alias("n")).where("n = size(want)")
    ranked = full.withColumn("rank", match_rank(F.col("held"), F.col("want")))
    best = U.clear_winner(ranked, "question_id", [F.desc("catalog_year"), F.col("course_code")])
    both = first.select("question_id", "c.*").unionByName(best.select("question_id", "kind", "course_code", "course_title", "credits", "suffix", "catalog_year"))
    c = F.col
    answers = both.select("question_id", U.answer(c("kind"), c("course_code"), c("course_title"), c("credits"), c("suffix"), c("catalog_year")).alias("answer"))
    return lists.unionByName(answers)


def answer_questions(questions: DataFrame, chunks: DataFrame, courses: DataFrame, day: Column, function: Callable[[str], str], redirect: str, rules: str = "", department: str | None = None) -> DataFrame:
    """(question_id, answer, sources, prompt_context) of a batch: redirects, lookups, and retrieval for the rest."""
    empty = F.array().cast("array<string>")
    away = questions.where(asks_availability(F.col("text"))).select("question_id", F.lit(redirect).alias("answer"), empty.alias("sources"), F.lit("").alias("prompt_context"))
    rest = questions.where(~asks_availability(F.col("text")))
    looked = lookups(rest, courses).select("question_id", "answer", F.array(F.lit("course lookup")).alias("sources"), F.lit("").alias("prompt_context"))
    asked = rest.join(looked.select("question_id"), "question_id", "left_anti")
    hits = search(asked, chunks, day, department)
    fields = ["chunk_type", "heading", "source", "content_source", "text", "course_code", "degree_full_title", "catalog_year", "catalog_page", "catalog_page_end", "referenced_courses"]
    own = hits.withColumns({f: F.lit("") for f in fields if f not in hits.columns})
    grouped = own.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.struct(*fields).alias("c")))).alias("h"))  # at most K chunks a question
    made = asked.join(grouped, "question_id", "left").withColumn("c", F.transform("h", lambda x: x["c"]))
    ready = made.select("question_id", E.citations(F.col("c")).alias("sources"), F.coalesce(E.context(F.col("c")), F.lit("")).alias("prompt_context"), "text")
    told = generate(ready.withColumn("prompt", prompt(F.col("text"), F.col("prompt_context"), day, rules)), function)
    out = told.select("question_id", "answer", F.coalesce("sources", empty).alias("sources"), "prompt_context")
    return away.unionByName(looked).unionByName(out)


def evaluate(golden: DataFrame, results: DataFrame, known: list[str] | None = None) -> DataFrame:
    """Row metrics of results (question_id, answer, chunks, latency, error) against golden questions, joined by id.

    golden has question_id, category, key_facts, expected_chunk_ids, expected_source_type and banner_redirect_expected;
    chunks is an array of structs with chunk_id, content_source and source. A question without a result has null metrics
    and isn't passed. Judges are left to `evaluate.parse_judge` and `evaluate.judge_total`.
    """
    both = golden.join(results, "question_id", "left")
    c = F.col
    ids, kinds, sources = c("chunks.chunk_id"), c("chunks.content_source"), c("chunks.source")
    found, first, right = E.hit(ids, c("expected_chunk_ids")), E.top_hit(ids, c("expected_chunk_ids")), E.source_right(kinds, c("expected_source_type"))
    scored = both.withColumns({
        "recall_at_k": found, "precision_at_1": first, "source_type_correct": right, "retrieval_score": E.retrieval_score(found, first, right), "context_recall": E.fact_coverage(c("answer"), c("key_facts")),
        "filler_detected": E.has_filler(c("answer")), "leads_with_answer": E.leads_with_answer(c("answer")), "course_entity_valid": E.codes_valid(c("answer"), c("key_facts")),
        "links_traced": E.links_traced(c("answer"), sources, known or []), "citation_format": E.cites_well(kinds, c("answer")), "response_length": E.word_count(c("answer")), "readability": E.reading_ease(c("answer")),
    })
    redirect = F.coalesce(c("banner_redirect_expected"), F.lit(False))
    done = E.passed(redirect, E.redirected(c("answer"), "banner"), c("expected_chunk_ids"), c("retrieval_score"))
    return scored.withColumn("passed", F.coalesce(done & c("answer").isNotNull(), F.lit(False)))
