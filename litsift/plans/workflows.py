"""End-to-end workflows and the model-based (rows-only) registered queries."""

from __future__ import annotations

import time

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from litsift.models import cv, study
from litsift.models.classifiers import DEFAULT_MODELS, OPTIONAL_MODELS
from litsift.models.features import TfidfFeaturizer, add_tokens
from litsift.operators import corpus, evaluate, project, rank, sampling
from litsift.plans import fixtures as fx
from litsift.plans.queries import Ctx, r6
from litsift.sources import files, xml


def _split(spark: SparkSession, sf_dir: str):
    c = Ctx(spark, sf_dir)
    return c, c.train, c.test


def ranked_from_predictions(test_pred: DataFrame) -> DataFrame:
    return rank.ranked_list(test_pred.select("pmid", "year", "title", "pred_class",
                                             "p_positive"))


def flagship(spark: SparkSession, sf_dir: str, model: str = "logit") -> DataFrame:
    """Minimum slice: corpus -> recipe -> one model fitted on all training rows ->
    scored test rows -> ranked reading list."""
    _, train, test = _split(spark, sf_dir)
    fz, fitted = cv.fit_all_rows(train, [model])
    pred = cv.predict(fz, fitted[model], test)
    return ranked_from_predictions(pred)


def q_flagship(spark, sf):
    return flagship(spark, sf)


def q_features(spark, sf):
    _, train, _ = _split(spark, sf)
    tok = add_tokens(train.select("pmid", "abstract", "class", "label"))
    fz = TfidfFeaturizer().fit(tok)
    out = fz.transform(tok)
    a = vector_to_array("features")
    return out.select("pmid", "class",
                      F.size(F.filter(a, lambda x: x != 0)).alias("n_terms"),
                      F.round(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x), 6)
                      .alias("tfidf_sum"))


def _model_query(name: str):
    def q(spark, sf):
        _, train, test = _split(spark, sf)
        fz, fitted = cv.fit_all_rows(train, [name])
        pred = cv.predict(fz, fitted[name], test)
        return r6(pred.select(F.lit(name).alias("model_name"), "pmid", "p_positive",
                              "pred_class"))
    q.__name__ = f"q_model_{name}"
    return q


def _plain_model_query(name: str):
    """A model on the recipe without stemming, which the SQL can build as well."""
    def q(spark, sf):
        _, train, test = _split(spark, sf)
        fz, fitted = cv.fit_all_rows(train, [name], stem=False)
        pred = cv.predict(fz, fitted[name], test, stem=False)
        return r6(pred.select(F.lit(name).alias("model_name"), "pmid", "p_positive", "pred_class"))
    q.__name__ = f"q_model_{name}_plain"
    return q


def q_features_plain(spark, sf):
    """Feature rows of the articles to be classified, on the recipe without stemming."""
    _, train, test = _split(spark, sf)
    fz = TfidfFeaturizer().fit(add_tokens(train.select("pmid", "abstract"), stem=False).select("pmid", "tokens"))
    a = vector_to_array("features")
    out = fz.transform(add_tokens(test.select("pmid", "abstract"), stem=False))
    return r6(out.select("pmid", F.size(F.filter(a, lambda x: x != 0)).alias("n_terms"),
                         F.aggregate(a, F.lit(0.0), lambda s, x: s + x).alias("tfidf_sum"),
                         F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x).alias("tfidf_square")))


def q_cross_validate_null(spark, sf):
    """Out-of-fold metrics of the null model through the cross-validation of all folds together."""
    _, train, _ = _split(spark, sf)
    _, metrics = cv.cross_validate(train, ["null"])
    return r6(metrics.filter("estimate is not null"))


def q_cross_validate(spark, sf):
    _, train, _ = _split(spark, sf)
    _, metrics = cv.cross_validate(train, DEFAULT_MODELS)
    return metrics


def q_classify(spark, sf):
    _, train, test = _split(spark, sf)
    res = cv.classify(train, test, metric="roc_auc", models=DEFAULT_MODELS)
    return ranked_from_predictions(res.test_pred)


def q_all_predictions(spark, sf):
    """Fit every model on all training rows; union their test predictions by model."""
    c, train, test = _split(spark, sf)
    fz, fitted = cv.fit_all_rows(train, DEFAULT_MODELS)
    # words and features are made once a row and written once: every model reads them
    feats = fz.transform(add_tokens(test.select("pmid", "abstract"))).select("pmid", "features").checkpoint()
    out = None
    for name in DEFAULT_MODELS:
        p = fitted[name].transform(feats).select(F.lit(name).alias("model_name"), "pmid", "p_positive", "pred_class")
        out = p if out is None else out.unionByName(p)
    return evaluate.model_names(out)


def q_model_evaluation(spark, sf):
    """Held-out evaluation of every fitted model: AUC and specificity at 95% sensitivity."""
    c = Ctx(spark, sf)
    preds = q_all_predictions(spark, sf).drop("pred_class")
    # a few columns a row, written once: both measures read them, and no model scores twice
    tp = corpus.attach_truth(preds, c.truth).checkpoint()
    return evaluate.model_summary(evaluate.spec_at_sens(tp), evaluate.auc_by_model(tp))


def _pca(spark, sf):
    _, train, _ = _split(spark, sf)
    tok = add_tokens(train.select("pmid", "abstract", "class", "label"))
    fz = TfidfFeaturizer().fit(tok)
    feats = fz.transform(tok).select("pmid", "class", "features").checkpoint()
    return project.pca(feats, fz.vocab)


def q_pca_loadings(spark, sf):
    loadings, _ = _pca(spark, sf)
    return loadings.where(F.col("component_no") <= 5)


def q_pca_top_terms(spark, sf):
    loadings, _ = _pca(spark, sf)
    return project.top_loadings(loadings)


def q_pca_scores(spark, sf):
    _, scores = _pca(spark, sf)
    return scores


def q_xml_articles(spark, sf):
    """Articles rendered as XML records, written as files, read back by the XML source."""
    c = Ctx(spark, sf)
    path = files.scratch_path(spark, "xml")
    xml.to_xml_records(c.articles).write.mode("overwrite").text(path)
    return xml.read_xml_articles(spark, path)


def q_xml_articles_wide(spark, sf):
    """All documents as records of every field, written as files, read back in one parse a record."""
    path = files.scratch_path(spark, "xml")
    xml.to_xml_records(fx.wide_articles(fx.load(spark, sf, "documents"))).write.mode("overwrite").text(path, lineSep="\n")
    wide = xml.read_xml_articles(spark, path, wide=True)
    return wide.withColumn("keywords", F.array_join("keywords", ";"))


def q_csv_articles(spark, sf):
    c = Ctx(spark, sf)
    path = files.scratch_path(spark, "csv")
    files.write_article_csv(fx.curated_sets(c.docs, c.labels), path)
    return files.read_article_csv(spark, path)


def q_id_file_scan(spark, sf):
    c = Ctx(spark, sf)
    path = files.scratch_path(spark, "ids")
    c.index.where("class = 1").select("pmid").write.mode("overwrite").text(path)
    return files.read_id_file(spark, path)


def q_two_stage(spark, sf):
    """Classify, then classify again inside the predicted-positive category.

    Stage 2 trains on the positive training articles split by a second label
    (``labels.toxic``) and ranks the stage-1 positives.
    """
    c, train, test = _split(spark, sf)
    # words are made once a row: both fits read those of the training rows, one pass scores the others by both models
    tok = add_tokens(train.select("pmid", "abstract", "class", "label")).drop("abstract").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fz, fitted = cv.fit_all_rows(tok, ["logit"])
        sub = (tok.where(F.col("label") == 1.0).drop("label", "class")
               .join(c.labels.select(F.col("doc_id").cast("string").alias("pmid"), "toxic"), "pmid")
               .withColumn("label", F.col("toxic").cast("double"))
               .withColumn("class", F.when(F.col("toxic") == 1, "Positive").otherwise("Negative")))
        fz2, fitted2 = cv.fit_all_rows(sub, ["logit"])
    finally:
        tok.unpersist()
    stage1 = cv.predict(fz, fitted["logit"], test, keep_tokens=True).withColumnRenamed("pred_class", "stage1").drop("p_positive")
    # a few columns a row, written once: the filter can't move below the join, where it would score every article
    both = cv.predict(fz2, fitted2["logit"], stage1).select("pmid", "year", "title", "stage1", "pred_class", "p_positive").checkpoint()
    return ranked_from_predictions(both.where(F.col("stage1") == "Positive"))


def learning_curve(train: DataFrame, start: int = 50, step: int = 10, stop: int | None = None,
                   model: str = "logit", v: int = 5, seed: int = 42, repeats: int = 1) -> DataFrame:
    """CV score and wall seconds of a run by training-set size, averaged over seeded repeats.

    Sizes run from ``start`` by ``step`` to ``stop`` (the smaller class's size without one),
    which is always the last. Each class is cut to its first rows in id order, train part of
    the 80/20 positional split.
    """
    smallest = train.groupBy("class").count().agg(F.min("count")).first()[0] or 0
    stop = min(stop or smallest, smallest)
    rows = []
    for size in sorted({*range(start, stop, step), stop}):
        sub = sampling.prefix_split(train, "class", "pmid", size=size).where("split = 'train'") \
            .drop("split")
        found, seconds = [], 0.0
        for k in range(repeats):
            began = time.perf_counter()
            _, metrics = cv.cross_validate(sub, [model], v=v, seed=seed + k)
            m = evaluate.metric_summary(metrics).where("metric = 'roc_auc'").first()
            seconds += time.perf_counter() - began
            if m is not None and m["mean"] is not None:
                found.append(float(m["mean"]))
        rows.append((int(sub.count()), len(found), sum(found) / len(found) if found else None,
                     seconds / repeats if repeats else None))
    return train.sparkSession.createDataFrame(rows, "n_docs long, n_runs int, mean_auc double, seconds double")


def runtime_trend(log: DataFrame) -> DataFrame:
    """Linear trend of seconds on documents (slope, intercept) over a log of runs."""
    return log.agg(F.regr_slope("seconds", "n_docs").alias("slope"),
                   F.regr_intercept("seconds", "n_docs").alias("intercept"),
                   F.count(F.lit(1)).alias("n_runs"))


def q_learning_curve(spark, sf):
    """Naive Bayes by training-set size: mean and spread over ten draws of other rows."""
    _, train, _ = _split(spark, sf)
    return r6(study.learning_curve(train, start=10, step=10))


def q_learning_curve_null(spark, sf):
    _, train, _ = _split(spark, sf)
    return r6(study.learning_curve(train, start=10, step=10, model="null", stem=False))


def q_study_draws(spark, sf):
    """The order of each class in ten draws, which every sample of the studies is a prefix of."""
    _, train, _ = _split(spark, sf)
    rows = train.select("pmid", "class").withColumn("row", F.monotonically_increasing_id()).checkpoint()
    return study.ordered_draws(rows, 10, 42).join(rows.select("row", "pmid"), "row").select(
        "draw", "class", "rank", "n", "pmid")


def q_runtime_trend(spark, sf):
    return r6(runtime_trend(fx.run_log(fx.load(spark, sf, "events"))))


def q_table_sink(spark, sf):
    """Predictions written by the table sink and read back."""
    c = Ctx(spark, sf)
    path = files.scratch_path(spark, "table")
    files.write_table(c.scored, path)
    return r6(spark.read.parquet(path))


def q_model_save_load(spark, sf):
    """The null model fitted, saved, loaded and applied."""
    from litsift.models.classifiers import load_model, save_model
    _, train, test = _split(spark, sf)
    fz, fitted = cv.fit_all_rows(train, ["null"])
    path = files.scratch_path(spark, "model")
    save_model(spark, fitted["null"], path)
    pred = cv.predict(fz, load_model(spark, path), test)
    return r6(pred.select("pmid", "p_positive", "pred_class"))


def balance_sweep(train: DataFrame, shares, model: str = "logit", seed: int = 42, repeats: int = 1) -> DataFrame:
    """F1 of both classes by class mix: CV on samples with a given positive share, seeded repeats averaged."""
    sizes = {r["class"]: r["count"] for r in train.groupBy("class").count().collect()}
    rows = []
    for share in shares:
        total = int(min(sizes.get("Positive", 0) / share, sizes.get("Negative", 0) / (1 - share)))
        found = {"Positive": [], "Negative": []}
        for k in range(repeats):
            sub = sampling.sample_to_ratio(train, share, total, positive="Positive", seed=seed + k)
            preds, _ = cv.cross_validate(sub, [model], seed=seed + k)
            for r in evaluate.f_by_class(preds, ["model_name"]).collect():
                if r["f_score"] is not None:
                    found[r["class"]].append(r["f_score"])
        rows.append((float(share), int(total), *(sum(f) / len(f) if f else None for f in found.values())))
    return train.sparkSession.createDataFrame(
        rows, "pos_share double, n_docs long, f_positive double, f_negative double")


def q_balance_sweep(spark, sf):
    """F1 of both classes by class mix at one total, mean and spread over ten draws."""
    _, train, _ = _split(spark, sf)
    return r6(study.class_mix(train))


WORKFLOW_QUERIES = {
    "flagship": q_flagship,
    "features": q_features,
    **{f"model_{m}": _model_query(m) for m in DEFAULT_MODELS + OPTIONAL_MODELS},
    "features_plain": q_features_plain,
    "model_nb_plain": _plain_model_query("nb"),
    "model_knn_plain": _plain_model_query("knn"),
    "cross_validate_null": q_cross_validate_null,
    "study_draws": q_study_draws,
    "learning_curve_null": q_learning_curve_null,
    "cross_validate": q_cross_validate,
    "classify": q_classify,
    "all_predictions": q_all_predictions,
    "model_evaluation": q_model_evaluation,
    "pca_loadings": q_pca_loadings,
    "pca_top_terms": q_pca_top_terms,
    "pca_scores": q_pca_scores,
    "xml_articles": q_xml_articles,
    "xml_articles_wide": q_xml_articles_wide,
    "csv_articles": q_csv_articles,
    "id_file_scan": q_id_file_scan,
    "table_sink": q_table_sink,
    "model_save_load": q_model_save_load,
    "two_stage": q_two_stage,
    "learning_curve": q_learning_curve,
    "runtime_trend": q_runtime_trend,
    "balance_sweep": q_balance_sweep,
}
