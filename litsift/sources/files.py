"""File sources and sinks: id lists, curated CSVs, tables, fitted models."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litsift.session import ensure_checkpoint_dir

ARTICLE_CSV_SCHEMA = "pmid string, year string, title string, abstract string, class string"


def read_id_file(spark: SparkSession, path: str) -> DataFrame:
    """Headerless text, first whitespace-separated column = id, one per line."""
    first = F.split(F.trim(F.col("value")), r"\s+").getItem(0)
    return (spark.read.text(path).select(first.alias("pmid"))
            .where(F.col("pmid").isNotNull() & (F.col("pmid") != "")))


def read_article_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, columns forced to (pmid, year, title, abstract, class)."""
    return (spark.read.schema(ARTICLE_CSV_SCHEMA).option("header", True)
            .option("multiLine", True).option("escape", '"').csv(path))


def write_article_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; text kept verbatim (no whitespace trimming, quotes escaped)."""
    (df.select("pmid", "year", "title", "abstract", "class").write.mode("overwrite")
     .option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))


def write_table(df: DataFrame, path: str) -> None:
    """Parquet sink (runtime logs, metrics, predictions)."""
    df.write.mode("overwrite").parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's checkpoint folder (shared storage on a cluster)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/litsift-scratch/{name}-{uuid.uuid4().hex[:12]}"
