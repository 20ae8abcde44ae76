"""The classifier registry.  Every spec: ``fit(df) -> fitted``; ``fitted.transform(df)``
appends ``p_positive`` (P(class = Positive)) and ``pred_class``.

Training frames carry ``features`` (sparse TF-IDF vector over <= 500 terms) and
``label`` (1.0 = Positive).  Built-in ``pyspark.ml`` estimators are used where Spark
has the model; the rest are expressed as distributed aggregates plus a small solve
on the driver over 500 x 500 statistics, or (k-NN) as a search over blocks of labelled rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC,
                                       LogisticRegression, MultilayerPerceptronClassifier,
                                       NaiveBayes)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litsift.models import forest
from litsift.models.forest import ForestModel, ForestSpec
from litsift.models.neighbours import KnnModel, KnnSpec, load_parts, save_parts

POS, NEG = "Positive", "Negative"


def with_class(df: DataFrame) -> DataFrame:
    """Derive ``pred_class`` from ``p_positive`` (Positive when p >= 0.5)."""
    return df.withColumn("pred_class", F.when(F.col("p_positive") >= 0.5, F.lit(POS))
                         .otherwise(F.lit(NEG)))


def dot_expr(features: str, weights: list[float]) -> Column:
    """x . w for a fixed weight vector, JVM-side (array HOFs)."""
    w = F.array(*[F.lit(float(v)) for v in weights])
    prod = F.zip_with(vector_to_array(F.col(features)), w, lambda a, b: a * b)
    return F.aggregate(prod, F.lit(0.0), lambda acc, x: acc + x)


# ---------------------------------------------------------------- pyspark.ml wrappers

class _SparkModel:
    def __init__(self, model):
        self.model = model

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(df)
        out = out.withColumn("p_positive", vector_to_array(F.col("probability"))[1])
        return with_class(out.drop("rawPrediction", "probability", "prediction"))

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)


class SparkSpec:
    def __init__(self, name: str, factory):
        self.name = name
        self.factory = factory

    def fit(self, df: DataFrame) -> _SparkModel:
        return _SparkModel(self.factory().fit(df))


def logit_spec() -> SparkSpec:
    """Elastic-net logistic regression, penalty 0.1, mixture 0.5 (standardised inputs)."""
    return SparkSpec("logit", lambda: LogisticRegression(
        featuresCol="features", labelCol="label", regParam=0.1, elasticNetParam=0.5,
        family="binomial", maxIter=100))


def mr_spec() -> SparkSpec:
    """Multinomial regression, penalty 0.01, mixture 0.5."""
    return SparkSpec("mr", lambda: LogisticRegression(
        featuresCol="features", labelCol="label", regParam=0.01, elasticNetParam=0.5,
        family="multinomial", maxIter=100))


def nb_spec() -> SparkSpec:
    """Naive Bayes on continuous features (Gaussian); Laplace 1 applies to counts only."""
    return SparkSpec("nb", lambda: NaiveBayes(featuresCol="features", labelCol="label",
                                              modelType="gaussian", smoothing=1.0))


def xgboost_spec() -> SparkSpec:
    """Boosted trees: 15 rounds, depth 6, learning rate 0.3."""
    return SparkSpec("xgboost", lambda: GBTClassifier(
        featuresCol="features", labelCol="label", maxIter=15, maxDepth=6, stepSize=0.3,
        seed=42, maxMemoryInMB=1024))


def rf_spec(num_trees: int = 1000) -> ForestSpec:
    """Random forest of 1,000 trees grown to a depth of 30, ten rows a leaf at least."""
    return ForestSpec(num_trees, least=10)


# Older documented algorithms (optional; not in the default model list).

def tree_spec() -> SparkSpec:
    """Single decision tree."""
    return SparkSpec("tree", lambda: DecisionTreeClassifier(
        featuresCol="features", labelCol="label", maxDepth=5, seed=42))


def bagging_spec(num_trees: int = 100) -> ForestSpec:
    """Bagged trees: a forest that considers every feature at every split."""
    return ForestSpec(num_trees, all_features=True)


class MlpSpec:
    """Neural network: one hidden layer of ``hidden`` units, softmax output."""
    name = "mlp"

    def __init__(self, hidden: int = 10, max_iter: int = 100):
        self.hidden, self.max_iter = hidden, max_iter

    def fit(self, df: DataFrame) -> "_SparkModel":
        dim = df.select(F.size(vector_to_array("features")).alias("d")).first()["d"]
        mlp = MultilayerPerceptronClassifier(featuresCol="features", labelCol="label",
                                             layers=[dim, self.hidden, 2],
                                             maxIter=self.max_iter, seed=42)
        return _SparkModel(mlp.fit(df))


# ---------------------------------------------------------------- null model

class _NullModel:
    def __init__(self, prior: float):
        self.prior = prior

    def arrays(self) -> tuple:
        return "prior", float(self.prior)

    def transform(self, df: DataFrame) -> DataFrame:
        p = F.lit(float(self.prior))
        pred = F.lit(POS if self.prior >= 0.5 else NEG)
        return df.withColumn("p_positive", p).withColumn("pred_class", pred)


class NullSpec:
    """Majority class with the training prior as probability."""
    name = "null"

    def fit(self, df: DataFrame) -> _NullModel:
        r = df.agg(F.avg("label").alias("p")).first()
        return _NullModel(float(r["p"]) if r["p"] is not None else 0.5)


# ---------------------------------------------------------------- linear SVM + Platt

class _SvmModel:
    def __init__(self, svc, platt):
        self.svc, self.platt = svc, platt

    def transform(self, df: DataFrame) -> DataFrame:
        m = self.svc.transform(df).withColumn(
            "_margin", vector_to_array(F.col("rawPrediction"))[1])
        m = m.drop("rawPrediction", "prediction")
        a, b = self.platt
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(a) * F.col("_margin") + F.lit(b))))
        return with_class(m.withColumn("p_positive", p).drop("_margin"))


class SvmSpec:
    """Linear SVM (hinge loss, C = 1) with a Platt sigmoid fitted on held-out margins.

    The sigmoid is fitted on margins of 3 internal folds (each row scored by a model
    that did not see it), then the SVM is refitted on all rows.
    """
    name = "svm_linear"

    def __init__(self, cost: float = 1.0, inner_folds: int = 3, seed: int = 7):
        self.cost, self.inner_folds, self.seed = cost, inner_folds, seed

    def _svc(self, n: int):
        # Spark's own stopping rule: the hinge loss is not smooth, so the fit ends at its
        # tolerance or after 100 iterations
        return LinearSVC(featuresCol="features", labelCol="label", maxIter=100, tol=1e-6,
                         regParam=1.0 / (self.cost * max(n, 1)))

    def fit(self, df: DataFrame) -> _SvmModel:
        from concurrent.futures import ThreadPoolExecutor
        h = F.abs(F.xxhash64(F.col("pmid"), F.lit(self.seed))) % self.inner_folds
        df_f = df.withColumn("_if", h)
        # label counts per inner fold in one small aggregate (<= 2 x folds rows)
        counts = df_f.groupBy("_if", "label").count().collect()
        n = sum(r["count"] for r in counts)
        usable = []
        for k in range(self.inner_folds):
            labels_out = {r["label"] for r in counts if r["_if"] != k}
            if len(labels_out) == 2:
                usable.append(k)

        def inner(k):
            m = self._svc(n).fit(df_f.where(F.col("_if") != k)) \
                .transform(df_f.where(F.col("_if") == k))
            return m.select(vector_to_array(F.col("rawPrediction"))[1].alias("margin"), "label")

        with ThreadPoolExecutor(max_workers=self.inner_folds + 1) as pool:
            final = pool.submit(lambda: self._svc(n).fit(df))
            parts = list(pool.map(inner, usable))
            svc = final.result()
        a, b = 1.0, 0.0
        if parts:
            margins = parts[0]
            for p in parts[1:]:
                margins = margins.unionByName(p)
            lr = LogisticRegression(featuresCol="m", labelCol="label", regParam=0.0,
                                    maxIter=100)
            lm = lr.fit(VectorAssembler(inputCols=["margin"], outputCol="m").transform(margins))
            a, b = float(lm.coefficients[0]), float(lm.intercept)
        return _SvmModel(svc, (a, b))


# ---------------------------------------------------------------- moment statistics

def class_moments(df: DataFrame, dim: int):
    """Per-class count, mean and (unbiased) covariance of ``features``; JVM-side aggregates.

    Means/variances from ``Summarizer``, correlations from ``Correlation`` (a tree
    aggregate of the Gram matrix); results are bounded by dim x dim.
    """
    out = {}
    for lab in (0.0, 1.0):
        part = df.where(F.col("label") == lab).select("features")
        s = part.select(Summarizer.metrics("count", "mean", "variance")
                        .summary(F.col("features")).alias("s")).first()["s"]
        n = int(s["count"])
        mean = np.zeros(dim) if n == 0 else s["mean"].toArray()
        var = np.zeros(dim) if n < 2 else s["variance"].toArray()
        if n >= 2:
            corr = Correlation.corr(part, "features").first()[0].toArray()
            corr = np.nan_to_num(corr, nan=0.0)
            sd = np.sqrt(np.maximum(var, 0.0))
            cov = corr * np.outer(sd, sd)
            np.fill_diagonal(cov, var)
        else:
            cov = np.zeros((dim, dim))
        out[lab] = (n, mean, cov)
    return out


def _pinv(m: np.ndarray) -> np.ndarray:
    return np.linalg.pinv(m, rcond=1e-10, hermitian=True)


# ---------------------------------------------------------------- LDA

class _LinearScoreModel:
    """p_positive = sigmoid(x . w + b) -- one fused JVM expression."""

    def __init__(self, w: np.ndarray, b: float):
        self.w, self.b = [float(v) for v in w], float(b)

    def arrays(self) -> tuple:
        return "linear", np.array(self.w), self.b

    def transform(self, df: DataFrame) -> DataFrame:
        s = dot_expr("features", self.w) + F.lit(self.b)
        return with_class(df.withColumn("p_positive", F.lit(1.0) / (F.lit(1.0) + F.exp(-s))))


class _QuadraticScoreModel:
    """p_positive = sigmoid(x . w + x^2 . q + b)."""

    def __init__(self, w: np.ndarray, q: np.ndarray, b: float):
        self.w, self.q, self.b = [float(v) for v in w], [float(v) for v in q], float(b)

    def arrays(self) -> tuple:
        return "quadratic", np.array(self.w), self.b, np.array(self.q)

    def transform(self, df: DataFrame) -> DataFrame:
        x = vector_to_array(F.col("features"))
        w = F.array(*[F.struct(F.lit(a).alias("w"), F.lit(b).alias("q")) for a, b in zip(self.w, self.q)])
        terms = F.zip_with(x, w, lambda v, c: v * (c["w"] + v * c["q"]))
        s = F.aggregate(terms, F.lit(0.0), lambda acc, v: acc + v) + F.lit(self.b)
        # beyond 700 the exponential leaves a double
        s = F.greatest(F.least(s, F.lit(700.0)), F.lit(-700.0))
        return with_class(df.withColumn("p_positive", F.lit(1.0) / (F.lit(1.0) + F.exp(-s))))


def nb_model(neg, pos) -> _QuadraticScoreModel:
    """Gaussian naive Bayes from both classes' moments.

    Variances are those of the whole class, each raised by 1e-9 of the largest feature variance of
    all rows, so a feature without variance in a class has a density.
    """
    n = neg.n + pos.n
    mean, square = (neg.n * neg.mean + pos.n * pos.mean) / n, (neg.n * neg.square + pos.n * pos.square) / n
    floor = 1e-9 * float((square - mean * mean).max(initial=0.0)) or 1e-300
    w, q, b = np.zeros_like(mean), np.zeros_like(mean), 0.0
    for sign, c in ((-1.0, neg), (1.0, pos)):
        var = np.maximum(c.square - c.mean * c.mean, 0.0) + floor
        w = w + sign * c.mean / var
        q = q - sign / (2 * var)
        b += sign * (math.log(c.n / n) - 0.5 * float((np.log(var) + c.mean * c.mean / var).sum()))
    return _QuadraticScoreModel(w, q, b)


class LdaSpec:
    """Linear discriminant analysis: class means, pooled covariance, class priors.

    Log-odds of Positive = x'S^-1(m1 - m0) - (m1 + m0)'S^-1(m1 - m0)/2 + log(p1/p0).
    The pooled covariance is scaled to unit within-class variance and inverted on its
    eigen-directions with variance above 1e-8 (text covariance is typically singular).
    """
    name = "ldm"

    def fit(self, df: DataFrame) -> _LinearScoreModel:
        dim = df.select(F.size(vector_to_array("features")).alias("d")).first()["d"]
        mom = class_moments(df, dim)
        return _lda(*mom[0.0], *mom[1.0])


def lda_model(neg, pos) -> _LinearScoreModel:
    """Linear discriminant from both classes' moments."""
    return _lda(neg.n, neg.mean, neg.cov, pos.n, pos.mean, pos.cov)


def _lda(n0, m0, c0, n1, m1, c1) -> _LinearScoreModel:
    n = n0 + n1
    if n0 == 0 or n1 == 0:
        return _LinearScoreModel(np.zeros(len(m0)), 30.0 if n1 else -30.0)
    pooled = ((n0 - 1) * c0 + (n1 - 1) * c1) / max(n - 2, 1)
    # scale to unit within-class variance, drop directions with variance < tol^2
    sd = np.sqrt(np.maximum(np.diag(pooled), 0.0))
    keep = sd > 1e-12
    inv_sd = np.where(keep, 1.0 / np.where(keep, sd, 1.0), 0.0)
    scaled = pooled * np.outer(inv_sd, inv_sd)
    evals, evecs = np.linalg.eigh(scaled)
    good = evals > 1e-8
    inv = (evecs[:, good] / evals[good]) @ evecs[:, good].T
    w = inv_sd * (inv @ (inv_sd * (m1 - m0)))
    b = -0.5 * float((m1 + m0) @ w) + math.log(n1 / n0)
    return _LinearScoreModel(w, b)


# ---------------------------------------------------------------- PLS-DA

class _PlsModel:
    def __init__(self, coef: np.ndarray, intercept: float):
        self.coef, self.intercept = [float(v) for v in coef], float(intercept)

    def arrays(self) -> tuple:
        return "linear", 2.0 * np.array(self.coef), 2.0 * self.intercept - 1.0

    def transform(self, df: DataFrame) -> DataFrame:
        yhat = dot_expr("features", self.coef) + F.lit(self.intercept)
        # two dummy responses (y, 1 - y): softmax of the pair = sigmoid(2y - 1)
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(2.0) * yhat - F.lit(1.0))))
        return with_class(df.withColumn("p_positive", p))


class PlsSpec:
    """Sparse PLS discriminant analysis: ``num_comp`` components, each using the
    ``predictor_prop`` share of predictors with the largest covariance weight.

    Works on the centred cross-product statistics (Cov(X), Cov(X, y)) from distributed
    aggregates (``Summarizer``, ``Correlation``); components are extracted on the driver
    from the 500 x 500 statistics.
    """
    name = "pls"

    def __init__(self, num_comp: int = 10, predictor_prop: float = 1 / 3):
        self.num_comp, self.predictor_prop = num_comp, predictor_prop

    def fit(self, df: DataFrame) -> _PlsModel:
        xy = VectorAssembler(inputCols=["features", "label"], outputCol="_xy",
                             handleInvalid="keep").transform(df).select("_xy")
        s = xy.select(Summarizer.metrics("count", "mean", "variance")
                      .summary(F.col("_xy")).alias("s")).first()["s"]
        mean = s["mean"].toArray()
        var = s["variance"].toArray()
        corr = np.nan_to_num(Correlation.corr(xy, "_xy").first()[0].toArray(), nan=0.0)
        sd = np.sqrt(np.maximum(var, 0.0))
        cov = corr * np.outer(sd, sd)
        np.fill_diagonal(cov, var)
        d = len(mean) - 1
        return _pls(mean[:d], mean[d], cov[:d, :d], cov[:d, d], self.num_comp, self.predictor_prop)


def pls_model(neg, pos, num_comp: int = 10, predictor_prop: float = 1 / 3) -> _PlsModel:
    """Sparse partial least squares from both classes' moments."""
    n = neg.n + pos.n
    mean, share = (neg.n * neg.mean + pos.n * pos.mean) / n, pos.n / n
    gap = pos.mean - neg.mean
    between = neg.n * pos.n / n
    cov = ((neg.n - 1) * neg.cov + (pos.n - 1) * pos.cov + between * np.outer(gap, gap)) / max(n - 1, 1)
    return _pls(mean, share, cov, between * gap / max(n - 1, 1), num_comp, predictor_prop)


def _pls(mean, share, sxx, sxy, num_comp: int, predictor_prop: float) -> _PlsModel:
    """Components from centred statistics of predictors scaled to unit variance."""
    d = len(mean)
    sd = np.sqrt(np.maximum(np.diag(sxx), 0.0))
    scale = np.where(sd > 1e-12, 1.0 / np.where(sd > 1e-12, sd, 1.0), 0.0)
    sxx, sxy = sxx * np.outer(scale, scale), sxy * scale
    keep = max(1, int(math.floor(predictor_prop * d)))
    W, P, Q = [], [], []
    for _ in range(min(num_comp, d)):
        w = sxy.copy()
        if not np.any(np.abs(w) > 1e-12):
            break
        if keep < d:
            # equal weights go by column; digits beyond the tenth don't decide
            cut = np.argsort(-np.round(np.abs(w), 10), kind="stable")[keep:]
            w[cut] = 0.0
        w /= np.linalg.norm(w)
        c = float(w @ sxx @ w)
        if c <= 1e-15:
            break
        p = sxx @ w / c
        q = float(w @ sxy) / c
        W.append(w), P.append(p), Q.append(q)
        sxx = sxx - np.outer(p, p) * c
        sxy = sxy - p * (q * c)
    if not W:
        return _PlsModel(np.zeros(d), float(share))
    Wm, Pm, Qv = np.array(W).T, np.array(P).T, np.array(Q)
    coef = scale * (Wm @ np.linalg.pinv(Pm.T @ Wm) @ Qv)
    return _PlsModel(coef, float(share - mean @ coef))


# ---------------------------------------------------------------- registry

def registry(rf_trees: int = 1000) -> dict:
    """Model name -> spec, in the reference's spec-list order (BART is not built)."""
    return {
        "xgboost": xgboost_spec(),
        "ldm": LdaSpec(),
        "logit": logit_spec(),
        "mr": mr_spec(),
        "nb": nb_spec(),
        "knn": KnnSpec(),
        "null": NullSpec(),
        "pls": PlsSpec(),
        "rf": rf_spec(rf_trees),
        "svm_linear": SvmSpec(),
        "tree": tree_spec(),
        "mlp": MlpSpec(),
        "bagging": bagging_spec(),
    }


DEFAULT_MODELS = ["xgboost", "ldm", "logit", "mr", "nb", "knn", "null", "pls", "rf",
                  "svm_linear"]
OPTIONAL_MODELS = ["tree", "mlp", "bagging"]


# ---------------------------------------------------------------- persistence

def _write_meta(spark, path: str, meta: dict) -> None:
    import json
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1) \
        .write.mode("overwrite").parquet(path.rstrip("/") + "/meta")


def _read_meta(spark, path: str) -> dict:
    import json
    return json.loads(spark.read.parquet(path.rstrip("/") + "/meta").first()["meta"])


def _write_vector(spark, path: str, values) -> None:
    rows = [(i, float(v)) for i, v in enumerate(values)]
    spark.createDataFrame(rows, "i int, v double").coalesce(1).write.mode("overwrite") \
        .parquet(path)


def _read_vector(spark, path: str) -> list[float]:
    return [r["v"] for r in spark.read.parquet(path).orderBy("i").collect()]


_SPARK_MODEL_CLASSES = {
    "LogisticRegressionModel": "pyspark.ml.classification.LogisticRegressionModel",
    "NaiveBayesModel": "pyspark.ml.classification.NaiveBayesModel",
    "GBTClassificationModel": "pyspark.ml.classification.GBTClassificationModel",
    "DecisionTreeClassificationModel":
        "pyspark.ml.classification.DecisionTreeClassificationModel",
    "MultilayerPerceptronClassificationModel":
        "pyspark.ml.classification.MultilayerPerceptronClassificationModel",
    "LinearSVCModel": "pyspark.ml.classification.LinearSVCModel",
}


def _load_spark_model(cls_name: str, path: str):
    import importlib
    mod, _, name = _SPARK_MODEL_CLASSES[cls_name].rpartition(".")
    return getattr(importlib.import_module(mod), name).load(path)


def save_model(spark, fitted, path: str) -> None:
    """Write a fitted model (any spec of the registry) through Spark's file systems."""
    base = path.rstrip("/")
    if isinstance(fitted, _SparkModel):
        fitted.model.write().overwrite().save(base + "/model")
        _write_meta(spark, base, {"kind": "spark", "cls": type(fitted.model).__name__})
    elif isinstance(fitted, ForestModel):
        _write_meta(spark, base, {"kind": "forest", **forest.save_parts(fitted, base)})
    elif isinstance(fitted, _NullModel):
        _write_meta(spark, base, {"kind": "null", "prior": fitted.prior})
    elif isinstance(fitted, _LinearScoreModel):
        _write_vector(spark, base + "/w", fitted.w)
        _write_meta(spark, base, {"kind": "linear", "b": fitted.b})
    elif isinstance(fitted, _QuadraticScoreModel):
        _write_vector(spark, base + "/w", fitted.w)
        _write_vector(spark, base + "/q", fitted.q)
        _write_meta(spark, base, {"kind": "quadratic", "b": fitted.b})
    elif isinstance(fitted, _PlsModel):
        _write_vector(spark, base + "/w", fitted.coef)
        _write_meta(spark, base, {"kind": "pls", "b": fitted.intercept})
    elif isinstance(fitted, _SvmModel):
        fitted.svc.write().overwrite().save(base + "/model")
        _write_meta(spark, base, {"kind": "svm", "platt": list(fitted.platt)})
    elif isinstance(fitted, KnnModel):
        _write_meta(spark, base, {"kind": "knn", **save_parts(fitted, spark, base)})
    else:
        raise TypeError(f"cannot save {type(fitted).__name__}")


def load_model(spark, path: str):
    """Read a model written by :func:`save_model`."""
    base = path.rstrip("/")
    meta = _read_meta(spark, base)
    kind = meta["kind"]
    if kind == "spark":
        return _SparkModel(_load_spark_model(meta["cls"], base + "/model"))
    if kind == "forest":
        return forest.load_parts(spark, base, meta)
    if kind == "null":
        return _NullModel(meta["prior"])
    if kind == "linear":
        return _LinearScoreModel(np.array(_read_vector(spark, base + "/w")), meta["b"])
    if kind == "quadratic":
        return _QuadraticScoreModel(np.array(_read_vector(spark, base + "/w")),
                                    np.array(_read_vector(spark, base + "/q")), meta["b"])
    if kind == "pls":
        return _PlsModel(np.array(_read_vector(spark, base + "/w")), meta["b"])
    if kind == "svm":
        return _SvmModel(_load_spark_model("LinearSVCModel", base + "/model"),
                         tuple(meta["platt"]))
    if kind == "knn":
        return load_parts(spark, base, meta)
    raise ValueError(f"unknown model kind {kind}")
