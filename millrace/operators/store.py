"""Tables: replacing writes, upserts, snapshots and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.text import joined, uuid5_url
from . import versions

PARTITIONS = ["department_id", "content_source"]


def replace_partitions(df: DataFrame, path: str, by: list[str] | None = None, scope: dict[str, str] | None = None) -> int:
    """Replace just the partitions that df has rows of, and the one of `scope` in any case, in one step (see `versions`).

    scope names a value for each partition column, as in a run over one department; without new rows it is emptied. Readers
    (`stored`) see old rows or new ones, columns may be added, and a writer that fails leaves the table as it was.
    """
    return versions.publish(df, path, by or PARTITIONS, scope)


def stored(spark: SparkSession, path: str, scope: dict[str, str] | None = None) -> DataFrame:
    """The rows of a table that `replace_partitions` writes, or those of a scope."""
    return versions.current(spark, path, scope)


def replaced(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """What a table holds after rows with the keys of `new` have been replaced; either side may lack columns."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def scope_replaced(old: DataFrame, new: DataFrame, scope: dict[str, str]) -> DataFrame:
    """What a table holds after all rows of a scope (column and value) have gone and `new` has come, which may be empty."""
    inside = F.lit(True)
    for column, value in scope.items():
        inside = inside & F.col(column).eqNullSafe(value)
    return old.where(~inside).unionByName(new, allowMissingColumns=True)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of old, overwritten by those of new with the same keys; of several in new the last in `order` wins."""
    last = Window.partitionBy(*keys).orderBy(F.desc("_new"), F.desc(order))
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("_rank", F.row_number().over(last)).where("_rank = 1").drop("_new", "_rank")


def export_snapshot(chunks: DataFrame, vector: str = "vector") -> DataFrame:
    """(uuid, properties, vector) of every chunk, the properties as JSON; the uuid is the chunk's own, or made of its id."""
    own = F.col("uuid") if "uuid" in chunks.columns else uuid5_url(F.col("chunk_id"))
    fields = [c for c in chunks.columns if c not in ("uuid", vector)]
    return chunks.select(own.alias("uuid"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("properties"), F.col(vector).alias("vector"))


def import_snapshot(rows: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """What a table holds after an import: rows with a vector replace those of their uuid; without `old` it was cleared first.

    Rows without a vector are rejected (see `snapshot_counts`). An import may be repeated: it gives the same table.
    """
    good = rows.where("vector is not null")
    first = good.withColumn("_n", F.row_number().over(Window.partitionBy("uuid").orderBy("properties"))).where("_n = 1").drop("_n")
    return first if old is None else replaced(old, first, ["uuid"])


def snapshot_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("rows"), F.count_if(F.col("vector").isNull()).alias("rejected"))


def export_rows(answers: DataFrame) -> DataFrame:
    """One flat row for each retrieved chunk of an answer, with the columns of the export; without chunks one with blanks.

    answers have question, answer and chunks (an array of structs); department_id, timestamp_utc, sources and
    prompt_context if they are known. Lists are joined by bars, and what is missing is blank. question_id stays in front.
    """
    count = F.greatest(F.coalesce(F.size("chunks"), F.lit(0)), F.lit(0))
    rows = answers.select("*", count.alias("chunk_count"), F.explode_outer("chunks").alias("chunk"))
    fields = answers.schema["chunks"].dataType.elementType.fieldNames()
    flat = lambda c, kind: joined(c) if kind.startswith("array") else F.coalesce(c.cast("string"), F.lit(""))
    kinds, inner = dict(rows.dtypes), dict(rows.select("chunk.*").dtypes)

    def value(name: str) -> Column:
        own = "rank" if name == "chunk_rank" else name
        if name == "chunk_count":
            return F.col(name)
        if name in ("timestamp_utc", "department_id", "question", "answer", "sources", "prompt_context"):
            return flat(F.col(name), kinds[name]) if name in kinds else F.lit("")
        return flat(F.col("chunk")[own], inner[own]) if own in fields else F.lit("")

    return rows.select("question_id", *[value(c).alias(c) for c in V.EXPORT])


def result_tables(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The answers and the scores of results, each with its own columns; further ones are left out, missing ones null."""
    pick = lambda names: results.select(*[F.col(c) if c in results.columns else F.lit(None).cast("string").alias(c) for c in names])
    return pick(V.ANSWER_FIELDS), pick(V.SCORE_FIELDS)


def write_summary(row: DataFrame, path: str) -> None:
    """One row as one JSON object."""
    row.coalesce(1).write.mode("overwrite").json(path, ignoreNullFields=False)


def crawl_run(counts: DataFrame, department: str, version: str, at: Column | None = None) -> DataFrame:
    """The row of the crawl-run log for counted pages and chunks, to be appended."""
    made = F.current_timestamp() if at is None else at
    return counts.select(F.lit(department).alias("department_id"), F.lit(version).alias("crawl_version"), F.col("pages_scraped").cast("int"), F.col("chunks_indexed").cast("int"), made.alias("created_at"))


def write_csv(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


def top_lists(hits: DataFrame) -> DataFrame:
    """(question_id, top): each question's hits in order, scores to 4 places and 120 characters of text."""
    score = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 4).alias(c)
    item = F.struct("rank", "chunk_id", "heading", "content_source", "chunk_type", score("hybrid_score"), score("metadata_boost"), score("final_score"), F.substring(F.coalesce("text", F.lit("")), 1, 120).alias("text_preview"))
    return hits.groupBy("question_id").agg(F.array_sort(F.collect_list(item)).alias("top"))  # at most K hits a question


DDL = {
    "courses": "id bigint, course_code string, course_title string, credits string, suffix string, department_id string, campus string, catalog_year string",
    "chat_logs": "id bigint, department_id string, user_question string, answer string, sources string, created_at timestamp",
    "crawl_runs": "id bigint, department_id string, crawl_version string, pages_scraped int, chunks_indexed int, created_at timestamp",
}


def create_tables(spark) -> None:
    for name, columns in DDL.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet")
