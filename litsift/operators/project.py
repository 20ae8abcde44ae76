"""PCA projection of standardised TF-IDF: loadings, top terms per component, scores.

Standardisation and the covariance are distributed (``StandardScaler`` statistics,
``pyspark.ml.feature.PCA`` = tree-aggregated Gram matrix); the eigen-decomposition
is over the <= 500-term vocabulary.  Signs are fixed so the largest-|loading| term
of each component is positive; scores are computed JVM-side from those loadings.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA, StandardScaler, VectorSlicer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litsift.models.classifiers import dot_expr


def pca(feats: DataFrame, vocab: list[str], k: int = 5, alpha_only: bool = True):
    """Fit PCA on ``features`` of ``feats`` (pmid, class, features).

    Returns ``(loadings, scores)``: loadings (terms, value, component, component_no)
    and scores (pmid, class, PC1..PCk).
    """
    spark = feats.sparkSession
    keep = [i for i, t in enumerate(vocab)
            if (not alpha_only) or any("a" <= ch <= "z" or "A" <= ch <= "Z" for ch in t)]
    sliced = VectorSlicer(inputCol="features", outputCol="_f", indices=keep).transform(feats)
    # drop zero-variance terms (they cannot be standardised)
    stats = StandardScaler(inputCol="_f", outputCol="_z", withMean=True, withStd=True).fit(sliced)
    sd = np.array(stats.std.toArray())
    nz = [j for j, s in enumerate(sd) if s > 0]
    terms = [vocab[keep[j]] for j in nz]
    sliced2 = VectorSlicer(inputCol="_f", outputCol="_g", indices=nz).transform(sliced)
    scaler = StandardScaler(inputCol="_g", outputCol="_z", withMean=True, withStd=True).fit(sliced2)
    z = scaler.transform(sliced2)
    kk = min(k, len(terms))
    model = PCA(k=kk, inputCol="_z", outputCol="_pc").fit(z)
    pc = np.array(model.pc.toArray(), dtype=float, copy=True)  # d x k
    for j in range(kk):
        col = pc[:, j]
        if col[int(np.argmax(np.abs(col)))] < 0:
            pc[:, j] = -col
    rows = [(terms[i], float(pc[i, j]), f"PC{j + 1}", j + 1)
            for j in range(kk) for i in range(len(terms))]
    loadings = spark.createDataFrame(rows, "terms string, value double, component string, "
                                           "component_no int")
    score_cols = [dot_expr("_z", list(pc[:, j])).alias(f"PC{j + 1}") for j in range(kk)]
    scores = z.select("pmid", "class", *score_cols)
    return loadings, scores


def top_loadings(loadings: DataFrame, n: int = 8, components: int = 4) -> DataFrame:
    """Top ``n`` terms by |loading| per component (PC1..PC4), ties kept, with sign flag."""
    w = Window.partitionBy("component").orderBy(F.desc(F.abs("value")))
    w2 = Window.partitionBy("component").orderBy(F.desc(F.abs("value")), F.asc("terms"))
    return (loadings.where(F.col("component_no") <= components)
            .withColumn("_rk", F.rank().over(w)).where(F.col("_rk") <= n)
            .select("component", "terms", "value", F.abs("value").alias("abs_value"),
                    (F.col("value") > 0).alias("positive"),
                    F.row_number().over(w2).alias("order_in_component")))
