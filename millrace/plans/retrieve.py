"""The search plan: ranked chunks for a batch of questions."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rank as R
from ..functions import vocabulary as V
from ..functions.text import expand_acronyms, expand_dates, tokenize
from ..operators import index, ranked, versions
from .embedding import embed

FIELDS = "chunk_type level heading course_code referenced_courses degree_full_title degree_type concentration policy_topic lab content_source".split()


def prepared(questions: DataFrame, day: Column) -> DataFrame:
    """Questions (question_id, text) rewritten, tokenised and planned."""
    rewritten = expand_acronyms(expand_dates(F.col("text"), day))
    out = questions.withColumn("rewritten", rewritten)
    out = out.withColumn("tokens", tokenize(F.col("rewritten")))
    return out.withColumn("k", R.dynamic_k(F.col("rewritten"), F.col("tokens")))


#: The scopes by which an index of chunks is replaced.
SCOPES = ["department_id", "content_source"]


def label() -> Column:
    """What an index keeps of a chunk for the hard filters."""
    return F.concat_ws("\x01", "level", "chunk_type")


def with_fields(chunks: DataFrame) -> DataFrame:
    """Chunks with every column that filters and boosts read; what they lack is empty."""
    out = chunks.withColumns({c: F.lit("") for c in [*FIELDS, *SCOPES] if c not in chunks.columns and c != "referenced_courses"})
    return out if "referenced_courses" in out.columns else out.withColumn("referenced_courses", F.array().cast("array<string>"))


def store_index(chunks: DataFrame, path: str, scope: dict | None = None) -> int:
    """Index chunks (chunk_id, text and what metadata they have) for `search`, in place of those of their scopes and of `scope`."""
    own = with_fields(chunks)
    # a null level or type is an empty one
    return index.write(own.fillna("", ["level", "chunk_type"]), path, "chunk_id", "text", SCOPES, label(), scope)


def search(questions: DataFrame, chunks: DataFrame, day: Column, department: str | None = None, vectors: DataFrame | None = None, alpha: float = V.ALPHA, stored: str | None = None, asked_vectors: DataFrame | None = None) -> DataFrame:
    """Ranked chunks of each question: BM25, fused with vector ranks if given, filtered, boosted and ranked again.

    chunks has chunk_id, text and the fields of metadata, and `stored` the path of their index (see `store_index`; without one
    they are indexed for this search alone). The second list comes from `vectors`, rows (question_id, chunk_id, score), or from
    `asked_vectors`, rows (question_id, vector), by cosine with the column `vector` of the chunks. The lists are those of the chunks
    of the department that the hard filters admit, and their fusion is exact at any depth; each question's K best go on, and
    boosts re-rank them.
    """
    spark = questions.sparkSession
    q = prepared(questions, day)
    own = with_fields(chunks.where(F.col("department_id") == department) if department else chunks)
    if stored is None:
        stored = f"{versions.shared_folder(spark)}/index-{uuid.uuid4().hex}"
        store_index(own, stored)
    rows = index.read(spark, stored, {"department_id": department} if department else None)
    facts = q.select("question_id", "rewritten", "tokens", "k").persist()  # a row for each question of the batch
    labels = rows.where("bucket = -1").select(F.explode("labels").alias("label")).distinct().persist()  # levels and types
    level, kind = F.split("label", "\x01")[0], F.split("label", "\x01")[1]
    allowed = facts.crossJoin(F.broadcast(labels)).where(R.hard_filter(F.col("rewritten"), F.col("tokens"), level, kind)).select("question_id", "label")
    asked = facts.select("question_id", F.col("rewritten").alias("text"))
    second = vectors is not None or asked_vectors is not None
    lists = [(ranked.Words(rows, asked, "question_id", "chunk_id", allowed=allowed), 1 - alpha if second else 1.0)]
    if asked_vectors is not None:
        held = own.fillna("", ["level", "chunk_type"]).select("chunk_id", "vector", label().alias("label"))
        lists.append((ranked.Vectors(held, asked_vectors, "question_id", "chunk_id", "vector", "label", allowed), alpha))
    elif vectors is not None:
        labelled = own.fillna("", ["level", "chunk_type"]).select("chunk_id", label().alias("label"))
        admitted = vectors.join(labelled, "chunk_id").join(allowed, ["question_id", "label"])
        lists.append((ranked.Given(admitted, asked, "question_id", "chunk_id"), alpha))
    fused = ranked.fused_top(lists, facts.select("question_id", "k"), "question_id", "chunk_id")
    hybrid = fused.withColumnsRenamed({"rank": "hybrid_rank", "score": "hybrid_score"}).join(facts, "question_id")
    full = own.join(hybrid, "chunk_id")
    boost = R.metadata_boost(F.col("rewritten"), F.col("tokens"), {c: F.col(c) for c in FIELDS})
    scored = full.withColumn("metadata_boost", boost).withColumn("final_score", F.round(F.col("hybrid_score") + F.col("metadata_boost"), 8))
    return R.top(scored, "question_id", [F.desc("final_score"), F.col("hybrid_rank")], F.col("k")).drop("rewritten", "tokens", "k")


def search_stored(questions: DataFrame, path: str, day: Column, department: str | None = None, function: Callable[[list[str]], list[list[float]]] | None = None, alpha: float = V.ALPHA) -> DataFrame:
    """`search` over what `ingest.store` has written at `path`; with `function`, which embeds texts, by words and vectors."""
    spark = questions.sparkSession
    chunks = versions.current(spark, f"{path}/chunks", {"department_id": department} if department else None)
    asked = None
    if function is not None:
        rewritten = prepared(questions, day).select("question_id", F.col("rewritten").alias("text"))
        asked = embed(rewritten, "question_id", "text", function)
    return search(questions, chunks, day, department, stored=f"{path}/index", alpha=alpha, asked_vectors=asked)


#: What a hit has of its chunk, in this order; what a chunk lacks is empty.
HIT = "chunk_id chunk_type department_id campus text heading source level degree_type course_code referenced_courses content_source catalog_year catalog_page catalog_page_end degree_full_title concentration credits policy_topic lab".split()


def hit_columns(hits: DataFrame) -> DataFrame:
    """Hits with just these columns of their chunks, and question, rank and scores; no list of references is an empty one."""
    empty = F.array().cast("array<string>")
    fields = {c: F.col(c) if c in hits.columns else (empty if c == "referenced_courses" else F.lit("")) for c in HIT}
    fields["referenced_courses"] = F.coalesce(fields["referenced_courses"], empty)
    scores = [c for c in ("question_id", "rank", "hybrid_rank", "hybrid_score", "metadata_boost", "final_score") if c in hits.columns]
    return hits.select(*scores, *[v.alias(c) for c, v in fields.items()])
