"""The stages of the corpus pipeline. Each takes (spark, docs, sf_dir).

All stages but the last return the columns of ``docs``. A changed text gets its n_chars anew,
if there is such a column. Rows are told apart as they stand: a stage that looks a decision up
by doc_id applies it to all rows of that id, and never drops a row with a null id for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, langid, secretscan, setsketch
from .common import Scratch


def _with_text(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with a new text, its own columns in their order, and n_chars to match."""
    out = docs.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def _without(spark: SparkSession, docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` without the rows of the ids in ``found``, which are written first so that their size is known."""
    ids = found.filter(F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return docs.join(Scratch(spark, "rejected").keep(ids, "ids", docs.count()), "doc_id", "left_anti").select(docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID (5): documents that it rejects go.

    Rejected are texts without a letter (or null), and those whose best code takes 8 bits a
    byte or more, which no learned language explains. Learned from all documents with a lang;
    nothing but texts without a letter is rejected if there are none.
    """
    known = docs.filter(F.col("lang").isNotNull()) if "lang" in docs.columns else docs.limit(0).withColumn(
        "lang", F.lit(None).cast("string"))
    model = langid.fit(known)
    found = langid.predict(docs, model)
    bad = F.col("lang_pred") == langid.UNKNOWN if model else F.lit(False)
    return _without(spark, docs, found.filter(bad | (F.col("bits") >= 8 * F.col("n_bytes")) & (F.col("n_bytes") > 0)))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup (10) at five words and 0.8: of each group the least doc_id stays.

    Rows that repeat that id are one document and stay together.
    """
    found = setsketch.near_duplicates(docs.select("doc_id", "text"))
    return _without(spark, docs, found.filter("doc_id <> component_id"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination (3): documents with an occurring phrase go."""
    found = decontam.contamination(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(spark, docs, found.filter(F.size("spans") > 0))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans (6): every span gives way to a mark; no document goes."""
    scanned = secretscan.scan(docs.withColumn("_row", F.struct(*docs.columns)), "_row")
    scanned = scanned.select("_row.*", F.col("found").alias("_found"))
    return _with_text(scanned, secretscan.redact(F.col("text"), F.col("_found"))).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE (4): doc_id, the tokens of every text, and their number."""
    import public_tokenizers

    tokens = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return tokens.withColumn("n_tokens", F.size("ids").cast("long"))
