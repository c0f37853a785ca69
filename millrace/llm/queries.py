"""Queries of the training-data operators, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bm25, ecoc, jaccard, lines, mixing, ordinal, packing, periodic, ppm, repair, ring, tokencount


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: str, n: int):
    """crc32 of a key as text, modulo n."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % n


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_anisotropic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "embeddings")
    return ann.search(x, x.where(F.col("vec_id") % 20 == 0), k=20)


def op2_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_documents(table(spark, sf_dir, "documents"), remainder("doc_id", 10) != 0)


def op3_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ring.shard_rows(table(spark, sf_dir, "documents"), shards=24, load_factor=1.0)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_ecoc_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ecoc.identify(table(spark, sf_dir, "documents"), remainder("doc_id", 3) != 1)


def op5_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer())


def op6_token_group_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_components(table(spark, sf_dir, "documents"), n=3, threshold=90)


def op7_block_max_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bm25.search(docs, docs.where(F.col("doc_id") % 100 == 0), k=10)


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded ratings from labels: 0 poor, 1 sound but toxic, 2 sound."""
    labels = table(spark, sf_dir, "labels")
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade"))


def op8_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = ordinal.grade_documents(table(spark, sf_dir, "documents"), ratings(spark, sf_dir), grades=3)
    return graded.select("doc_id", "expected_grade", "tail", ordinal.accept().alias("selected"))


def op9_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return mixed.select("doc_id", "source", "block", "release", "deadline", "slot", "position")


def op10_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.line_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "line_no", F.col("first_key").alias("first_doc_id"), "first_line_no", "keep")


def op11_rank_synchronous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole document, and whether they exceed 1024."""
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), limit=1024)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the periodic runs of every whole document, with the runs that the contract plants."""
    hash_ = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(hash_ / 10)
    out = periodic.find_runs(table(spark, sf_dir, "documents"), origin=F.when(hash_ % 10 == 0, g), period=3 + g % 8)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    found = out.withColumn("best", best).withColumn("runs_sha256", F.sha2(listed.cast("binary"), 256))
    length, period = F.col("best.length"), -F.col("best.period")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.before")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_trie_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repairs of all conversations, damaged as the contract has it."""
    turns = repair.turns_of(table(spark, sf_dir, "conversations"))
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv", "turn")]
    key = F.crc32(F.concat_ws(":", *named).cast("binary"))
    return repair.repair(repair.damage(turns, key)).withColumnRenamed("conv", "conv_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_anisotropic_search, op2_ppm_score, op3_bounded_ring, op4_ecoc_language, op5_best_two_fit, op6_token_group_jaccard, op7_block_max_wand, op8_ordinal_quality, op9_pfair_mix, op10_fuzzy_lines, op11_rank_synchronous, op12_periodic_runs, op13_trie_repair)
}
#: Words as the contracts have them, in DuckDB.
WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"

ORACLES: dict[str, str] = {
    "op6_token_group_jaccard": f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS t FROM documents),
 s AS (SELECT doc_id, list_distinct(CASE WHEN len(t) >= 3 THEN list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]) WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END) AS g FROM w),
 n AS (SELECT doc_id, len(g) AS n FROM s), u AS (SELECT doc_id, unnest(g) AS x FROM s),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
 l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
 e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 r(doc_id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT n.doc_id, n.n AS n_shingles, min(root) AS component_id FROM n JOIN r USING (doc_id) GROUP BY ALL""",
    "op7_block_max_wand": f"""
WITH w AS (SELECT doc_id, {WORDS} AS t FROM documents), stats AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM w),
 tf AS (SELECT doc_id, size, word, count(*) AS tf FROM (SELECT doc_id, len(t) AS size, unnest(t) AS word FROM w) GROUP BY ALL),
 q AS (SELECT doc_id AS query_id, unnest(list_distinct(t)) AS word FROM w WHERE doc_id % 100 = 0),
 df AS (SELECT word, count(*) AS df FROM tf WHERE word IN (SELECT word FROM q) GROUP BY word),
 s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score FROM q JOIN tf USING (word) JOIN df USING (word) CROSS JOIN stats GROUP BY ALL)
SELECT query_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""",
}
