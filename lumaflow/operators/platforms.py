"""Platform taxonomy, specifications and duplicate rules as small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import books


def categories(spark: SparkSession, book: dict | None = None) -> DataFrame:
    listed = (book or books.platforms())["taxonomy"]["unified_categories"]
    names = lambda v: [v["name"]] if isinstance(v, dict) else [str(x) for x in v] if isinstance(v, list) else [str(v)]
    rows = [(c["id"], p, names(v), v.get("tid") if isinstance(v, dict) else None) for c in listed for p, v in c["platforms"].items()]
    return spark.createDataFrame(rows, "category STRING, platform STRING, names ARRAY<STRING>, tid INT")


def specs(spark: SparkSession, book: dict | None = None) -> DataFrame:
    rows = [(p, s["aspect"], int(s["max_seconds"]), int(s["recommend_seconds"])) for p, s in (book or books.platforms())["taxonomy"]["platform_specs"].items()]
    return spark.createDataFrame(rows, "platform STRING, aspect STRING, max_seconds INT, recommend_seconds INT")


def dedup_rules(spark: SparkSession, book: dict | None = None) -> DataFrame:
    rows = [(p, [str(x) for x in r.get("detection") or []], r.get("window_days")) for p, r in (book or books.platforms())["dedup_rules"]["platforms"].items()]
    return spark.createDataFrame(rows, "platform STRING, detection ARRAY<STRING>, window_days INT")


def tids(spark: SparkSession, book: dict | None = None) -> DataFrame:
    rows = [(int(k), v) for k, v in (book or books.platforms())["taxonomy"].get("bilibili_tid_reference", {}).items()]
    return spark.createDataFrame(rows, "tid INT, name STRING")


def thresholds(book: dict | None = None) -> dict[str, float]:
    """Limits of the duplicate verdict, as ``fingerprints.verdict`` takes them."""
    return {k: float(v) for k, v in (book or books.platforms())["dedup_rules"]["thresholds"].items()}


def mapped(df: DataFrame, category: str = "category", book: dict | None = None) -> DataFrame:
    """Rows by platform of their category; the tables are as large as the configuration."""
    spark = df.sparkSession
    m = df.join(F.broadcast(categories(spark, book).withColumnRenamed("category", category)), category)
    return m.join(F.broadcast(specs(spark, book)), "platform", "left")
