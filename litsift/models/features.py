"""The feature recipe: tokens -> top-500 vocabulary -> TF-IDF sparse vectors.

Fitting is two DataFrame aggregates over the training rows only (term totals for
the vocabulary, document frequencies for idf); both results are bounded by the
vocabulary size (500) and come back to the driver.  Transforming is three JVM
transformers -- count vector over the fixed vocabulary, L1 normalisation (tf =
count / kept tokens), element-wise idf -- so scoring is a narrow, shuffle-free map.
"""

from __future__ import annotations

import json
import math

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsift.functions.text import analyze
from litsift.operators.terms import MAX_TOKENS


def add_tokens(df: DataFrame, text_col: str = "abstract", stem: bool = True,
               out: str = "tokens") -> DataFrame:
    """Append the analysed token array (tokenise, stop words, stem)."""
    return df.withColumn(out, analyze(F.col(text_col), stem=stem))


class TfidfFeaturizer:
    """Estimator: ``fit(df_with_tokens) -> FittedFeaturizer``."""

    def __init__(self, max_tokens: int = MAX_TOKENS, tokens_col: str = "tokens",
                 out: str = "features"):
        self.max_tokens = max_tokens
        self.tokens_col = tokens_col
        self.out = out

    def fit(self, df: DataFrame) -> "FittedFeaturizer":
        """Two jobs over the (cached) token column: term totals -> top-k vocabulary,
        then document count and per-term document frequency together."""
        toks = df.select(F.col(self.tokens_col).alias("t"))
        top = (toks.select(F.explode("t").alias("term"))
               .groupBy("term").agg(F.count(F.lit(1)).alias("n"))
               .orderBy(F.desc("n"), F.asc("term")).limit(self.max_tokens).collect())
        vocab = [r["term"] for r in top]
        vocab_df = df.sparkSession.createDataFrame([(t,) for t in vocab], "term string")
        # document frequency over distinct terms of each document, restricted to the
        # vocabulary (<= 500 rows, broadcast); the empty-term row counts documents
        per_doc = toks.select(F.explode(F.array_union(F.array(F.lit("")),
                                                      F.array_distinct("t"))).alias("term"))
        rows = (per_doc.join(F.broadcast(vocab_df.union(
                    df.sparkSession.createDataFrame([("",)], "term string"))), "term")
                .groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect())
        dfs = {r["term"]: r["df"] for r in rows}
        n_docs = dfs.pop("", 0)
        idf = [math.log(1.0 + n_docs / dfs[t]) for t in vocab]
        return FittedFeaturizer(vocab, idf, self.tokens_col, self.out)


class FittedFeaturizer:
    def __init__(self, vocab: list[str], idf: list[float], tokens_col: str = "tokens",
                 out: str = "features"):
        self.vocab = vocab
        self.idf = idf
        self.tokens_col = tokens_col
        self.out = out

    @property
    def size(self) -> int:
        return len(self.vocab)

    def transform(self, df: DataFrame) -> DataFrame:
        if not self.vocab:
            return df.withColumn(self.out, F.lit(None))
        cv = CountVectorizerModel.from_vocabulary(self.vocab, inputCol=self.tokens_col,
                                                  outputCol="_counts")
        l1 = Normalizer(inputCol="_counts", outputCol="_tf", p=1.0)
        ep = ElementwiseProduct(scalingVec=Vectors.dense(self.idf), inputCol="_tf",
                                outputCol=self.out)
        return ep.transform(l1.transform(cv.transform(df))).drop("_counts", "_tf")

    def save(self, spark, path: str) -> None:
        """Write vocabulary and idf through Spark (any Hadoop file system)."""
        rows = [(i, t, float(v)) for i, (t, v) in enumerate(zip(self.vocab, self.idf))]
        (spark.createDataFrame(rows, "idx int, term string, idf double").coalesce(1)
         .write.mode("overwrite").parquet(path.rstrip("/") + "/featurizer"))
        spark.createDataFrame([(json.dumps({"tokens_col": self.tokens_col, "out": self.out}),)],
                              "meta string").coalesce(1).write.mode("overwrite") \
            .parquet(path.rstrip("/") + "/featurizer_meta")

    @staticmethod
    def load(spark, path: str) -> "FittedFeaturizer":
        rows = spark.read.parquet(path.rstrip("/") + "/featurizer").orderBy("idx").collect()
        meta = json.loads(spark.read.parquet(path.rstrip("/") + "/featurizer_meta")
                          .first()["meta"])
        return FittedFeaturizer([r["term"] for r in rows], [r["idf"] for r in rows],
                                meta["tokens_col"], meta["out"])
