"""Score articles as they arrive with a fitted recipe and model.

Scoring is a stateless, narrow transform (tokens -> fixed-vocabulary TF-IDF ->
model), so a streaming source feeds it directly; no state, watermark or shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from litsift.models.cv import predict

ARTICLE_SCHEMA = "pmid string, year string, title string, abstract string"


def score_stream(spark: SparkSession, source_dir: str, featurizer, fitted,
                 schema: str = ARTICLE_SCHEMA, fmt: str = "parquet") -> DataFrame:
    """Streaming DataFrame of scored articles read from files landing in ``source_dir``."""
    arts = spark.readStream.schema(schema).format(fmt).load(source_dir)
    arts = arts.where("pmid IS NOT NULL AND abstract IS NOT NULL")
    return predict(featurizer, fitted, arts).select("pmid", "year", "title", "p_positive",
                                                    "pred_class")


def start_scoring(scored: DataFrame, sink_dir: str, checkpoint_dir: str, fmt: str = "parquet"):
    """Append scored rows to ``sink_dir`` (exactly-once file sink with a checkpoint)."""
    return (scored.writeStream.format(fmt).option("path", sink_dir)
            .option("checkpointLocation", checkpoint_dir).outputMode("append").start())
