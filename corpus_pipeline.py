"""The corpus pipeline: each stage's result is written as Parquet and reread as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from litsift.llm import pipeline
from litsift.llm.common import Scratch

#: (name, function); each takes (spark, docs, sf_dir). All but the last return the columns of documents.
STAGES = [
    ("language", pipeline.language),
    ("near_dedup", pipeline.deduplicate),
    ("decontaminate", pipeline.decontaminate),
    ("secrets", pipeline.redact),
    ("tokens", pipeline.encode),
]

#: SQL can't express the stages (language models, sketches, a suffix index, merges); tests/llm has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the whole table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"{number}-{name}")
    return docs
