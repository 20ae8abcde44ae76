"""v-fold cross-validation, model selection, refit and prediction.

The recipes of all folds come from one aggregate (:mod:`litsift.models.crossfit`). Models that
follow from sums over the rows are fitted for all folds together, a few passes in all. The
others (trees, nearest neighbours, or models given by the caller) are fitted fold by fold from a
driver thread pool; each of these fits is itself a set of distributed Spark jobs. Fold
predictions are checkpointed into the session's checkpoint folder so the rows can be released.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsift.models import crossfit
from litsift.models.classifiers import DEFAULT_MODELS, registry, with_class
from litsift.models.features import TfidfFeaturizer, add_tokens
from litsift.operators.evaluate import fold_metrics, metric_summary, model_select

PRED_COLS = ["pmid", "class", "label", "p_positive", "pred_class"]


def _specs(models: list[str], specs: dict | None) -> dict:
    reg = specs or registry()
    missing = [m for m in models if m not in reg]
    if missing:
        raise ValueError(f"unknown models: {missing}")
    return {m: reg[m] for m in models}


def _fit_partitions(df: DataFrame) -> int:
    """Partitions for an iterative fit: one for so many rows, at most one for each core the session has."""
    return crossfit.fit_tasks(df.sparkSession, df.count())


def _fold_frames(design: crossfit.Design, k: int):
    """Features of the rows that train fold ``k``'s models and of the fold's own rows."""
    fz = design.recipes[k].featurizer()
    ana, ass = design.tokens.where(F.col("fold") != k), design.tokens.where(F.col("fold") == k)
    n_classes = ana.agg(F.countDistinct("label")).first()[0]
    fa = (fz.transform(ana).select("pmid", "class", "label", "features")
          .repartition(design.tasks).persist(StorageLevel.MEMORY_AND_DISK))
    return fa, fz.transform(ass).select("pmid", "class", "label", "features"), n_classes


def _together(names: list[str], specs: dict | None) -> list[str]:
    """The models that are fitted for all folds at once; a caller's own specs are fitted one by one."""
    return [m for m in names if m in crossfit.TOGETHER and specs is None]


def cross_validate(train: DataFrame, models: list[str] | None = None, v: int = 5,
                   seed: int = 42, stem: bool = True, specs: dict | None = None,
                   parallel: int = 8) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold predictions and per-fold metrics for each model.

    ``train``: (pmid, abstract, class, label).  Returns ``(predictions, metrics)``:
    predictions (model_name, fold, pmid, class, label, p_positive, pred_class) and
    metrics (model_name, fold, metric, estimate).
    """
    models = models or DEFAULT_MODELS
    chosen = _specs(models, specs)
    design = crossfit.Design(train, v=v, seed=seed, stem=stem)
    try:
        together = _together(models, specs)

        def batched() -> list[DataFrame]:
            if not together:
                return []
            fitted = crossfit.fit(design, together, design.folds)
            return [with_class(crossfit.predictions(design, fitted)).select("model_name", "fold", *PRED_COLS)
                    .checkpoint(eager=True)]

        with ThreadPoolExecutor(max_workers=1) as pool:  # the solver's passes run beside the fits of the others
            first = pool.submit(batched)
            outs = _each_fold(design, [m for m in models if m not in together], chosen, parallel)
            outs = first.result() + outs
    finally:
        design.release()
    preds = outs[0]
    for p in outs[1:]:
        preds = preds.unionByName(p)
    return preds, fold_metrics(preds)


def _each_fold(design: crossfit.Design, models: list[str], chosen: dict, parallel: int) -> list[DataFrame]:
    """Fold predictions of models that are fitted fold by fold, several fits at a time."""
    if not models:
        return []
    with ThreadPoolExecutor(max_workers=max(1, min(parallel, len(design.folds)))) as pool:
        frames = dict(zip(design.folds, pool.map(lambda k: _fold_frames(design, k), design.folds)))

    def run(job):
        k, name = job
        fa, fs, n_classes = frames[k]
        spec = chosen[name] if n_classes > 1 else registry()["null"]
        out = (spec.fit(fa).transform(fs)
               .select(F.lit(name).alias("model_name"), F.lit(k).alias("fold"), *PRED_COLS))
        return out.checkpoint(eager=True)

    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        outs = list(pool.map(run, [(k, m) for m in models for k in design.folds]))
    for fa, _, _ in frames.values():
        fa.unpersist()
    return outs


class Classification:
    """Result of :func:`classify`."""

    def __init__(self, predictions, metrics, summary, best, featurizer, fitted, test_pred):
        self.predictions = predictions      # out-of-fold predictions
        self.metrics = metrics              # per-fold metrics
        self.summary = summary              # mean per (model, metric)
        self.best = best                    # best model name
        self.featurizer = featurizer        # recipe fitted on all training rows
        self.fitted = fitted                # name -> fitted model (best, or all)
        self.test_pred = test_pred          # best model's predictions on the test rows


def fit_models(train_tok: DataFrame, names: list[str], specs: dict | None = None,
               parallel: int = 8):
    """Fit the recipe on all training rows and the named models on its features."""
    chosen = _specs(names, specs)
    cached = train_tok.persist(StorageLevel.MEMORY_AND_DISK)
    fz = TfidfFeaturizer().fit(cached)
    feats = (fz.transform(cached).repartition(_fit_partitions(cached))
             .persist(StorageLevel.MEMORY_AND_DISK))
    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        fitted = dict(zip(names, pool.map(lambda n: chosen[n].fit(feats), names)))
    feats.unpersist()
    cached.unpersist()
    return fz, fitted


def fit_all_rows(train: DataFrame, names: list[str], stem: bool = True, specs: dict | None = None,
                 parallel: int = 8):
    """The recipe of all training rows and the named models on it."""
    chosen = _specs(names, specs)
    design = crossfit.Design(train, v=0, stem=stem)
    try:
        fz = design.recipes[crossfit.WHOLE].featurizer()
        together = _together(names, specs)

        def batched() -> dict:
            return {name: model for (_, name), model in crossfit.fit(design, together, [crossfit.WHOLE]).items()} if together else {}

        rest = [m for m in names if m not in together]
        with ThreadPoolExecutor(max_workers=1) as solver:  # the solver's passes run beside the other fits
            first = solver.submit(batched)
            fitted = {}
            if rest:
                feats = (fz.transform(design.tokens).select("pmid", "class", "label", "features")
                         .repartition(design.tasks).persist(StorageLevel.MEMORY_AND_DISK))
                with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
                    fitted.update(zip(rest, pool.map(lambda m: chosen[m].fit(feats), rest)))
                feats.unpersist()
            fitted.update(first.result())
    finally:
        design.release()
    return fz, fitted


def predict(featurizer, fitted, test: DataFrame, stem: bool = True, keep_tokens: bool = False) -> DataFrame:
    """Score rows to classify: one narrow transform (tokens -> features -> p_positive).

    Rows that have ``tokens`` are not analysed again; ``keep_tokens`` leaves them for another model.
    """
    tok = test if "tokens" in test.columns else add_tokens(test, stem=stem)
    out = fitted.transform(featurizer.transform(tok))
    return out.drop("features") if keep_tokens else out.drop("tokens", "features")


def classify(train: DataFrame, test: DataFrame, metric: str = "roc_auc", v: int = 5,
             models: list[str] | None = None, fit_all: bool = False, seed: int = 42,
             stem: bool = True, specs: dict | None = None,
             parallel: int = 8) -> Classification:
    """Cross-validate, pick the best model by ``metric``, refit it, score ``test``."""
    models = models or DEFAULT_MODELS
    preds, metrics = cross_validate(train, models, v=v, seed=seed, stem=stem, specs=specs,
                                    parallel=parallel)
    summary = metric_summary(metrics)
    best_row = model_select(summary, metric).first()
    best = best_row["model_name"] if best_row else models[0]
    fz, fitted = fit_all_rows(train, models if fit_all else [best], stem, specs, parallel)
    test_pred = predict(fz, fitted[best], test, stem=stem)
    return Classification(preds, metrics, summary, best, fz, fitted, test_pred)
