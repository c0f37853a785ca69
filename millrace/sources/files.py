"""Files: JSON, CSV, settings and latest runs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, all columns text."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def last_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with the same key the last."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def golden(df: DataFrame, ids: list[str] | None = None, category: str | None = None) -> DataFrame:
    """Golden questions, by ids and category if given."""
    if ids:
        df = df.where(F.col("question_id").isin(ids))
    return df.where(F.col("category") == category) if category else df


def latest_run(df: DataFrame, name: str = "run_id") -> DataFrame:
    """The rows of the run whose name is greatest."""
    return df.join(F.broadcast(df.agg(F.max(name).alias(name))), name, "left_semi")


def settings(text: str) -> dict:
    """A department's settings from JSON, or from YAML where a YAML reader is installed."""
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        import yaml

        return yaml.safe_load(text)


def page_settings(spark: SparkSession, config: dict) -> DataFrame:
    """(url, chunk_type, level, degree_type) of the pages that the settings name; a few rows, for a broadcast."""
    urls = {*config.get("pages", {}), *config.get("page_levels", {}), *config.get("page_degree_types", {})}
    rows = [(u, config.get("pages", {}).get(u), config.get("page_levels", {}).get(u), config.get("page_degree_types", {}).get(u)) for u in sorted(urls)]
    return spark.createDataFrame(rows, "url string, chunk_type string, level string, degree_type string")


def with_settings(pages: DataFrame, table: DataFrame) -> DataFrame:
    """Pages with their settings; what isn't named gets the type general and empty levels."""
    out = pages.join(F.broadcast(table), "url", "left")
    return out.fillna({"chunk_type": "general", "level": "", "degree_type": ""})
