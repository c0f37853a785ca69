"""Query planning and ranking: hard filters, dynamic K, metadata boosts, BM25, cosine and rank fusion."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import vocabulary as V
from .text import any_of, tokenize


def has(tokens: Column, *words: str) -> Column:
    return any_of(tokens, words)


def names_course(question: Column) -> Column:
    return F.upper(question).rlike(V.QUESTION_CODE)


def hard_filter(question: Column, tokens: Column, level: Column, chunk_type: Column) -> Column:
    """Whether a chunk may answer a question at all, by level and type."""
    yes = F.lit(True)
    by_level = F.when(any_of(tokens, V.UNDERGRADUATE), level != "graduate").when(any_of(tokens, V.GRADUATE), level != "undergraduate").otherwise(yes)
    structure = ~has(tokens, "courses", "course") & any_of(tokens, V.REQUIREMENT)
    degree = ~chunk_type.isin("minor_requirement", "minor_index") & (~structure | (chunk_type != "course_description"))
    topic = has(tokens, "courses") & any_of(tokens, V.TOPIC) & ~any_of(tokens, V.POLICY) & ~names_course(question)
    by_type = F.when(has(tokens, "minor", "minors"), chunk_type.isin(V.MINOR_TYPES)).when(any_of(tokens, V.DEGREE_TRIGGERS), degree).when(topic, chunk_type == "course_description").otherwise(yes)
    return by_level & by_type


def dynamic_k(question: Column, tokens: Column, k: int = V.TOP_K) -> Column:
    """How many chunks a question gets."""
    # The widths, and the words that ask for them.
    width = (
        F.when(any_of(tokens, V.COMPARISON), k)
        .when(has(tokens, "concentration", "concentrations", "track", "tracks", "specialization"), 15)
        .when(has(tokens, "minor", "minors"), 12)
        .when(has(tokens, "degree", "degrees", "program", "programs", "scholarship", "scholarships", "financial", "funding", "aid"), 10)
        .otherwise(k)
    )
    topic = F.when(has(tokens, "courses") & any_of(tokens, V.TOPIC) & ~names_course(question), 12).otherwise(k)
    policy = F.when(any_of(tokens, V.POLICY), 10).otherwise(k)
    return F.greatest(F.lit(k), width, topic, policy).cast("int")


def _met(tokens: Column, text: Column) -> Column:
    return F.arrays_overlap(tokens, tokenize(text))


def metadata_boost(question: Column, tokens: Column, chunk: dict[str, Column], strict_parity: bool = True) -> Column:
    """The sum of what the rules add to a chunk's score; chunk maps field names to columns, missing fields are empty.

    With strict_parity the two general-education rules never fire, since their set holds phrases of two words that no
    single token equals; without, they use the single words.
    """
    c = lambda name: chunk.get(name, F.lit(""))
    kind, level = c("chunk_type"), c("level")
    own = F.array_remove(tokenize(c("course_code")), "cs")
    asked = F.array_remove(tokens, "cs")
    referenced = F.array_join(F.coalesce(chunk.get("referenced_courses", F.array().cast("array<string>")), F.array().cast("array<string>")), " ")
    general = any_of(tokens, V.GENERAL_EDUCATION) if not strict_parity else F.lit(False)
    concentration, title = tokenize(c("concentration")), tokenize(c("degree_full_title"))
    younger, older = any_of(tokens, V.UNDERGRADUATE), any_of(tokens, V.GRADUATE)
    under, over = level == "undergraduate", level == "graduate"
    # What each rule adds.
    rules: list[tuple[Column, float]] = [
        (_met(asked, c("heading")), 0.08),
        (F.arrays_overlap(asked, tokenize(F.concat_ws(" ", c("course_code"), referenced))), 0.10),
        ((F.size(own) > 0) & (F.size(F.array_except(own, tokens)) == 0), 0.15),
        (_met(tokens, F.concat_ws(" ", c("degree_full_title"), level, c("degree_type"), c("concentration"))), 0.08),
        (_met(tokens, c("policy_topic")), 0.06),
        ((kind == "glossary") & _met(tokens, c("heading")), 0.06),
        ((kind == "course_schedule") & (any_of(tokens, V.SCHEDULE) | question.rlike(r"(?i)\bwhen\b")), 0.15),
        ((kind == "minor_requirement") & has(tokens, "minor", "minors"), 0.15),
        (kind.isin(V.REQUIREMENT_TYPES) & any_of(tokens, V.REQUIREMENT), 0.10),
        ((kind == "course_description") & has(tokens, "courses") & any_of(tokens, V.TOPIC), 0.15),
        (kind.isin("policy", "grad_program_info") & any_of(tokens, V.POLICY), 0.12),
        (kind.isin("policy", "grad_program_info") & general, 0.08),
        ((kind == "study_plan") & general, -0.12),
        ((kind == "faculty") & any_of(tokens, V.FACULTY), 0.15),
        ((kind == "enrollment") & any_of(tokens, V.ENROLLMENT), 0.12),
        # words of both levels in a question: those that agree with the chunk win
        ((under & younger) | (over & older), 0.08),
        ((over & younger & ~older) | (under & older & ~younger), -0.20),
        (_met(tokens, c("lab")), 0.05),
        ((kind == "study_plan") & (c("concentration") != "") & ~F.arrays_overlap(tokens, concentration), -0.20),
        ((kind == "concentration_requirement") & ~has(tokens, "concentration") & (F.size(title) > 0) & ~F.arrays_overlap(tokens, title), -0.15),
        (c("content_source") == "catalog", 0.02),
    ]
    return F.round(reduce(lambda a, b: a + b, [F.when(fits, F.lit(x)).otherwise(F.lit(0.0)) for fits, x in rules]), 6)


def top(df: DataFrame, by: str, order: list[Column], k: int | Column, rank: str = "rank") -> DataFrame:
    """Number the rows of each key in this order, from 1, and keep the first k."""
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return ranked.where(F.col(rank) <= k)


def bm25_scores(chunks: DataFrame, questions: DataFrame, k1: float = 1.2, b: float = 0.75, chunk: str = "doc_id", question: str = "item_id", text: str = "text") -> DataFrame:
    """(question, chunk, score) of all chunks that share a token with a question; distinct question tokens, 6 places.

    Tokens of questions are joined first with document frequencies and then with postings, so that only the postings of
    asked tokens are shuffled with a weight; nothing is collected.
    """
    # a generator's output is made once: what follows doesn't tokenise again for each use of the tokens
    words = chunks.select(F.col(chunk).alias("_c"), F.explode(F.array(tokenize(F.col(text)))).alias("_t"))
    stats = words.agg(F.count("*").alias("_n"), F.avg(F.size("_t")).alias("_mean"))
    asked = questions.select(F.col(question).alias("_q"), F.explode(F.array_distinct(tokenize(F.col(text)))).alias("_token"))
    single = words.select("_c", F.size("_t").alias("_len"), F.explode("_t").alias("_token"))
    wanted = single.join(asked.select("_token").distinct(), "_token", "left_semi").groupBy("_c", "_len", "_token").agg(F.count("*").alias("_tf"))
    # it reads the counts as well, so both sides of the join below have one exchange in common and postings are made once
    df = wanted.groupBy("_token").agg(F.sum(F.least("_tf", F.lit(1))).alias("_df"))
    hit = wanted.join(df, "_token").join(asked, "_token").crossJoin(F.broadcast(stats))  # stats is one row
    idf = F.log(1 + (F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    part = idf * F.col("_tf") * (k1 + 1) / (F.col("_tf") + k1 * (1 - b + b * F.col("_len") / F.col("_mean")))
    return hit.groupBy(F.col("_q").alias(question), F.col("_c").alias(chunk)).agg(F.round(F.sum(part), 6).alias("score"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, in double precision; 0 for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def reciprocal_ranks(lists: list[tuple[DataFrame, float]], keys: list[str], constant: int = 60) -> DataFrame:
    """Weighted reciprocal rank fusion of ranked lists (keys, rank)."""
    parts = [df.select(*keys, (F.lit(w) / (constant + F.col("rank"))).alias("_part")) for df, w in lists]
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(F.round(F.sum("_part"), 8).alias("score"))


def relative_scores(lists: list[tuple[DataFrame, float]], keys: list[str], by: str) -> DataFrame:
    """Weighted sum of scores scaled to 0..1 within each list and query (one value only: 1)."""
    w = Window.partitionBy(by)
    parts = []
    for df, weight in lists:
        low, high = F.min("score").over(w), F.max("score").over(w)
        parts.append(df.withColumn("_part", F.lit(weight) * F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0)).select(*keys, "_part"))
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(F.round(F.sum("_part"), 8).alias("score"))


#: Items and questions whose scores are made at once, 8 MB of them.
TILE = 1024


def nearest(vectors: DataFrame, questions: DataFrame, k: int, item: str = "doc_id", question: str = "item_id", vector: str = "embedding", most: int = 4096) -> DataFrame:
    """(question, item, score, rank): the k items of largest cosine for each question, 6 places, ties to the smaller item.

    Questions are broadcast as one matrix, at most `most` at a time (more take more passes); items stay where they are. A
    batch is scored in tiles of TILE items and questions, and what is below a question's k-th best so far doesn't go on.
    """
    spark, kinds = vectors.sparkSession, (dict(questions.dtypes)[question], dict(vectors.dtypes)[item])
    asked = questions.select(F.col(question).alias("q"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    passes, out = max(1, -(-asked.count() // most)), None
    for number in range(passes):
        rows = asked.where(F.pmod(F.xxhash64("q"), F.lit(passes)) == number).toArrow()
        shared = spark.sparkContext.broadcast((rows.column("q").combine_chunks(), unit(rows.column("v").combine_chunks())))

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, q = shared.value
            held = np.full((len(names), k), -np.inf)  # the k best scores of each question so far
            for batch in batches:
                batch = batch.filter(batch.column(1).is_valid())
                for start in range(0, len(batch) if len(names) else 0, TILE):
                    rows = batch.slice(start, TILE)
                    rows = rows.take(pc.sort_indices(rows.column(0)))  # ties go to the smaller item
                    x = unit(rows.column(1))
                    for lo in range(0, len(names), TILE):
                        score = np.round(q[lo : lo + TILE] @ x.T, 6)
                        rank = np.argsort(-score, axis=1, kind="stable")[:, :k]
                        top, mine = np.take_along_axis(score, rank, axis=1), held[lo : lo + TILE]
                        mine[:] = -np.partition(-np.concatenate((mine, top), axis=1), k - 1, axis=1)[:, :k]
                        of, place = np.nonzero(top >= mine.min(axis=1, keepdims=True))
                        if len(of):
                            yield pa.RecordBatch.from_arrays([names.take(pa.array(of + lo)), rows.column(0).take(pa.array(rank[of, place])), pa.array(top[of, place])], [question, item, "score"])

        one = vectors.select(item, F.col(vector).cast("array<double>")).mapInArrow(best, f"{question} {kinds[0]}, {item} {kinds[1]}, score double")
        out = one if out is None else out.unionByName(one)
    return top(out, question, [F.desc("score"), F.col(item)], k)


def unit(vectors: pa.ListArray) -> np.ndarray:
    """Rows of equal length as a matrix of unit vectors; zero vectors stay zero."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 1))
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)
