"""Evaluation: row metrics as columns, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.text import codes, strip
from .ordered import nearest_rank

# Weights, thresholds, and kappa's labels from the top.
WEIGHTS, PASS, BORDERLINE = (0.4, 0.3, 0.3), 0.7, 0.85
LABELS = [(0.8, "almost perfect"), (0.6, "substantial"), (0.4, "moderate"), (0.2, "fair")]


def hit(ids: Column, expected: Column) -> Column:
    """Whether any retrieved id is expected."""
    return F.coalesce(F.arrays_overlap(ids, expected), F.lit(False))


def top_hit(ids: Column, expected: Column) -> Column:
    return F.coalesce(F.array_contains(expected, F.get(ids, F.lit(0))), F.lit(False))


def main_source(sources: Column) -> Column:
    """The most frequent of the first three, ties to the earliest."""
    three = F.slice(sources, 1, 3)
    counted = F.transform(three, lambda s, i: F.struct(F.size(F.filter(three, lambda t: t == s)).alias("n"), (-i).alias("at"), s.alias("s")))
    return F.array_max(counted)["s"]


def source_right(sources: Column, expected: Column) -> Column:
    return F.when(expected.isin("either", "redirect"), True).otherwise(F.coalesce(main_source(sources) == expected, F.lit(False)))


def retrieval_score(found: Column, first: Column, source: Column) -> Column:
    return F.round(sum((F.when(c, F.lit(w)).otherwise(F.lit(0.0)) for c, w in zip((found, first, source), WEIGHTS)), F.lit(0.0)), 6)


def redirected(answer: Column, host: str) -> Column:
    return F.lower(answer).contains(host)


def cites_well(sources: Column, answer: Column) -> Column:
    """Catalog chunks want the word catalog and a year of the 2020s in the answer, web chunks a link; else true."""
    low = F.lower(answer)
    catalog = ~F.array_contains(sources, "catalog") | (low.contains("catalog") & answer.rlike("202[0-9]"))
    web = ~F.array_contains(sources, "web") | low.contains("http")
    return F.coalesce(catalog & web, F.lit(True))


def fact_coverage(answer: Column, facts: Column) -> Column:
    """The share of facts of which half the words (rounded down, at least one) occur in the answer, to 3 places."""
    low = F.lower(answer)

    def covered(fact: Column) -> Column:
        tokens = F.filter(F.regexp_extract_all(F.lower(fact), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: ~t.isin(V.FACT_STOPWORDS))
        hits = F.size(F.filter(tokens, lambda t: low.contains(t)))
        return (F.size(tokens) == 0) | (hits >= F.greatest(F.lit(1), F.floor(F.size(tokens) / 2)))

    return F.when(F.size(facts) > 0, F.round(F.size(F.filter(facts, covered)) / F.size(facts), 3)).otherwise(F.lit(0.0))


def has_filler(answer: Column) -> Column:
    return answer.rlike(V.FILLER)


def leads_with_answer(answer: Column) -> Column:
    """Whether an answer doesn't begin with an opening phrase."""
    return ~strip(answer).rlike(V.OPENER)


def codes_valid(answer: Column, facts: Column) -> Column:
    """Null without codes in the facts, true without codes in the answer, else whether the answer has all of them."""
    expected, given = codes(F.array_join(facts, " ")), codes(answer)
    return F.when(F.size(expected) == 0, F.lit(None).cast("boolean")).when(F.size(given) == 0, True).otherwise(F.size(F.array_except(expected, given)) == 0)


def links_traced(answer: Column, sources: Column, known: list[str]) -> Column:
    """Whether every link of the answer is of a known host or a prefix of, or prefixed by, a source."""
    links = F.regexp_extract_all(F.lower(answer), F.lit(V.LINK), F.lit(0))
    filled = F.filter(F.transform(sources, F.lower), lambda s: s != "")

    def traced(link: Column) -> Column:
        host = F.lit(False)
        for k in known:
            host = host | link.contains(k)
        return host | F.exists(filled, lambda s: link.startswith(s) | s.startswith(link))

    return F.forall(links, traced)


def word_count(answer: Column) -> Column:
    return F.size(F.filter(F.split(answer, r"\s+"), lambda w: w != ""))


def reading_ease(answer: Column) -> Column:
    """Flesch reading ease with syllables counted as runs of vowels; null for a text without words. Approximate."""
    n = F.regexp_count(answer, F.lit("[A-Za-z]+"))
    sentences = F.greatest(F.lit(1), F.regexp_count(answer, F.lit(r"[.!?]+")))
    syllables = F.regexp_count(F.lower(answer), F.lit("[aeiouy]+"))
    return F.when(n > 0, F.round(206.835 - 1.015 * n / sentences - 84.6 * syllables / F.greatest(n, F.lit(1)), 1))


def judge_total(scores: list[Column]) -> Column:
    """The mean of the scores over 3, null if any is missing (-1)."""
    good = F.lit(True)
    for s in scores:
        good = good & (F.coalesce(s, F.lit(-1)) >= 0)
    return F.when(good, F.round(sum(scores[1:], scores[0]) / len(scores) / 3, 6))


def parse_judge(raw: Column, names: list[str]) -> Column:
    """Scores from a judge's JSON, -1 for what is missing or broken."""
    parsed = F.from_json(raw, ", ".join(f"{n} int" for n in names))
    return F.struct(*[F.coalesce(parsed[n], F.lit(-1)).alias(n) for n in names])


def passed(redirect: Column, redirect_hit: Column, expected: Column, retrieval: Column, judge: Column | None = None) -> Column:
    none = F.coalesce(F.size(expected), F.lit(0)) <= 0
    if judge is None:
        return F.when(redirect, redirect_hit).when(none, True).otherwise(retrieval >= PASS)
    good = judge >= PASS
    verdict = F.when(redirect, redirect_hit & good).when(none, good).otherwise((retrieval >= PASS) & good)
    return F.when(judge.isNotNull(), verdict)


def category_summary(results: DataFrame, by: str = "category") -> DataFrame:
    """Counts, passes and means of each category, a missing one being `unknown`; averages leave nulls out."""
    rate = F.round(F.count_if("passed") / F.count("*"), 3)
    return results.groupBy(F.coalesce(F.col(by), F.lit("unknown")).alias(by)).agg(F.count("*").alias("n"), F.count_if("passed").alias("passed"), rate.alias("pass_rate"), F.round(F.avg("retrieval_score"), 3).alias("avg_retrieval"), F.round(F.avg("judge_total"), 3).alias("avg_judge"))


def run_summary(results: DataFrame) -> DataFrame:
    """One row of a run: questions, passes (true only), pass rate, and mean (cut) and 90th-percentile latency."""
    rate = F.when(F.count("*") > 0, F.round(F.count_if("passed") / F.nullif(F.count("*"), F.lit(0)), 3))
    counted = results.agg(F.count("*").alias("total_questions"), F.count_if("passed").alias("total_passed"), rate.alias("pass_rate"), F.floor(F.avg("latency")).cast("int").alias("avg_latency"))
    return counted.join(F.broadcast(nearest_rank(results, "latency", [])), F.lit(True), "left")  # one row each


def run_lists(results: DataFrame, low: float = PASS) -> DataFrame:
    """(list, question_id) of the questions that failed, had an error, or a retrieval score below `low`.

    Rows, and not arrays in one row, since a run may have any number of questions.
    """
    lists = [("failed", ~F.col("passed")), ("error", F.coalesce(F.col("error"), F.lit("")) != ""), ("low_retrieval", F.col("retrieval_score") < low)]
    found = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in lists]))
    return results.select(F.explode(found).alias("list"), "question_id")


def retrieved(chunks: Column) -> Column:
    """An array of chunks with just the fields that a result keeps of them."""
    return F.transform(chunks, lambda c: F.struct(*[c[f].alias(f) for f in V.RETRIEVED]))


def confusion(rows: DataFrame, judge: str, human: str) -> DataFrame:
    """One row: tp, tn, fp, fn, sensitivity, specificity, kappa and its label.

    Rows without a human verdict are left out; one without a judge's counts as a no in the table and not in kappa.
    """
    j, h = F.coalesce(F.col(judge), F.lit(False)), F.col(human)
    both = F.col(judge).isNotNull()
    n = F.count_if(both)
    same, yes_j, yes_h = F.count_if(both & (F.col(judge) == h)), F.count_if(both & F.col(judge)), F.count_if(both & h)
    counted = rows.where(h.isNotNull()).agg(F.count_if(j & h).alias("tp"), F.count_if(~j & ~h).alias("tn"), F.count_if(j & ~h).alias("fp"), F.count_if(~j & h).alias("fn"), n.alias("_n"), same.alias("_s"), yes_j.alias("_j"), yes_h.alias("_h"))
    share = lambda a, b: F.when(b > 0, F.round(a / F.nullif(b, F.lit(0)), 6))
    c = F.col
    total = F.nullif(c("_n"), F.lit(0))
    expected = (c("_j") * c("_h") + (c("_n") - c("_j")) * (c("_n") - c("_h"))) / (total * total)
    kappa = F.when(expected < 1, F.round((c("_s") / total - expected) / (1 - expected), 6))
    out = counted.withColumn("sensitivity", share(c("tp"), c("tp") + c("fn"))).withColumn("specificity", share(c("tn"), c("tn") + c("fp"))).withColumn("kappa", kappa)
    label = F.coalesce(*[F.when(c("kappa") >= x, F.lit(name)) for x, name in LABELS], F.when(c("kappa").isNotNull(), "slight"))
    return out.drop("_n", "_s", "_j", "_h").withColumn("label", label)


def agreement(rows: DataFrame, judge: str, human: str, by: str = "category") -> DataFrame:
    rate = lambda c: F.round(F.avg(c.cast("double")), 6)
    kept = rows.where(F.col(human).isNotNull() & F.col(judge).isNotNull())
    return kept.groupBy(by).agg(F.count("*").alias("n"), rate(F.col(judge)).alias("judge_rate"), rate(F.col(human)).alias("human_rate"), rate(F.col(judge) == F.col(human)).alias("agreement"))


def run_diff(old: DataFrame, new: DataFrame, k: int = 5) -> DataFrame:
    """(question_id, arrived, dropped, moved, status) from two runs (question_id, ids in order).

    Status: only_old, only_new, improved (more of the first k came than went), regressed, or unchanged.
    """
    a, b = F.slice(F.coalesce("a", F.array()), 1, k), F.slice(F.coalesce("b", F.array()), 1, k)
    both = old.select("question_id", F.col("ids").alias("a")).join(new.select("question_id", F.col("ids").alias("b")), "question_id", "full_outer")
    arrived, dropped = F.array_except(b, a), F.array_except(a, b)
    moved = F.filter(F.array_intersect(a, b), lambda x: F.array_position("a", x) != F.array_position("b", x))
    net = F.size("arrived") - F.size("dropped")
    status = F.when(F.col("b").isNull(), "only_old").when(F.col("a").isNull(), "only_new").when(net > 0, "improved").when(net < 0, "regressed").otherwise("unchanged")
    return both.withColumns({"arrived": arrived, "dropped": dropped, "moved": F.coalesce(moved, F.array().cast("array<string>"))}).withColumn("status", status).drop("a", "b")


def review_sample(scores: DataFrame, answers: DataFrame, clear: int = 10, excluded: list[str] | None = None) -> DataFrame:
    """All failures, all borderline passes and the first clear passes, with questions and answers."""
    kept = scores.where(~F.col("question_id").isin(excluded)) if excluded else scores
    stratum = F.when(~F.coalesce("passed", F.lit(False)), 0).when(F.coalesce("judge_total", F.lit(0.0)) < BORDERLINE, 1).otherwise(2)
    # the first `clear` of one stratum by rank: a limit pushed into the window, not a sort of everything
    ranked = kept.withColumn("stratum", stratum).withColumn("_n", F.row_number().over(Window.partitionBy("stratum").orderBy("question_id")))
    return ranked.where((F.col("stratum") < 2) | (F.col("_n") <= clear)).drop("_n").join(answers, "question_id", "left")


def review_sheet(scores: DataFrame, answers: DataFrame, clear: int = 10, excluded: list[str] | None = None) -> DataFrame:
    """The sampled questions as a sheet to fill in: failures, borderline and clear passes in turn, each by id, all columns text.

    What scores or answers lack is empty, as are the two columns that people fill in. `place` is the row's place in its stratum's turn.
    """
    rows = review_sample(scores, answers, clear, excluded)
    named = {"judge_pass": "passed", "human_pass": None, "human_notes": None}

    def text(column: str) -> Column:
        source = named.get(column, column)
        return F.coalesce(F.col(source).cast("string"), F.lit("")) if source in rows.columns else F.lit("")

    return rows.select("stratum", *[text(c).alias(c) for c in V.REVIEW])


def context(chunks: Column) -> Column:
    """A prompt's context: a block for each chunk, numbered."""
    field = lambda name, value: F.concat(F.lit(f"{name}: "), F.coalesce(value.cast("string"), F.lit("")))

    def block(c: Column, i: Column) -> Column:
        head = F.concat(F.lit("[Source "), (i + 1).cast("string"), F.lit("]"))
        shared = [field("Chunk Type", c["chunk_type"]), field("Heading", c["heading"])]
        pages = F.concat_ws("-", c["catalog_page"].cast("string"), c["catalog_page_end"].cast("string"))
        catalog = F.concat_ws("\n", head, F.lit("Content Source: catalog"), *shared, field("Degree", c["degree_full_title"]), field("Course", c["course_code"]), field("Catalog Year", c["catalog_year"]), field("Catalog Pages", pages), field("Referenced Courses", F.array_join(c["referenced_courses"], ", ")), field("Text", c["text"]), F.lit(""))
        web = F.concat_ws("\n", head, F.lit("Content Source: web"), *shared, field("Source", c["source"]), field("Course", c["course_code"]), field("Text", c["text"]), F.lit(""))
        return F.when(c["content_source"] == "catalog", catalog).otherwise(web)

    return F.array_join(F.transform(chunks, block), "\n---\n")


def citations(chunks: Column) -> Column:
    """Distinct citations in order: catalog year and pages, or the link of a web chunk that has one."""
    catalog = lambda c: F.concat(F.lit("Academic Catalog "), c["catalog_year"], F.lit(", pp. "), c["catalog_page"].cast("string"), F.lit("-"), c["catalog_page_end"].cast("string"))
    named = F.transform(chunks, lambda c: F.when(c["content_source"] == "catalog", catalog(c)).otherwise(F.coalesce(c["source"], F.lit(""))))
    return F.array_distinct(F.filter(named, lambda x: x != ""))
