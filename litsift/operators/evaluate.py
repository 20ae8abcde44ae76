"""Evaluation of scored predictions: confusion metrics, exact AUC, ROC curves, summaries.

Predictions are ``(<group cols>, pmid, class, p_positive)`` with class 'Positive' /
'Negative'; Positive is the event and is predicted when p_positive >= 0.5.
Every curve/AUC first aggregates equal scores per group, then runs the
range-partitioned running sums of :func:`grouped_cumsum`, so a group (one model
over billions of scored rows) never lands in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litsift.functions.numeric import sprintf3
from litsift.operators.prefix import grouped_cumsum
from litsift.operators.scalars import with_group_values

POS = "Positive"
THRESHOLD = 0.5

# Abbreviation -> display name of models and metrics.
MODEL_NAMES = {
    "bart": "Bayesian additive regression trees (BART)",
    "xgboost": "Boosted Trees",
    "ldm": "Linear Discriminant",
    "logit": "Logistic Regression",
    "mr": "Multinomial Regression",
    "nb": "Naive Bayes",
    "knn": "K-Nearest Neighbors",
    "null": "Null model",
    "pls": "Partial least squares (PLS)",
    "rf": "Random Forest",
    "svm_linear": "Linear support vector machines",
}
METRIC_NAMES = {
    "roc_auc": "AUC",
    "sens": "Sensitivity",
    "spec": "Specificity",
    "accuracy": "Accuracy",
    "precision": "Precision",
}
METRICS = ["roc_auc", "sens", "spec", "accuracy", "precision"]


def _is_pos(col: str = "class") -> Column:
    return F.col(col) == F.lit(POS)


def predicted_positive(p: str = "p_positive") -> Column:
    return F.col(p) >= F.lit(THRESHOLD)


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num.cast("double") / den)


def confusion_counts(pred: DataFrame, group_cols: list[str]) -> DataFrame:
    """tp, fp, tn, fn per group (rows with NULL class or score dropped)."""
    p = pred.na.drop(subset=["class", "p_positive"])
    hit = predicted_positive()
    return p.groupBy(*group_cols).agg(
        F.sum(F.when(_is_pos() & hit, 1).otherwise(0)).alias("tp"),
        F.sum(F.when(~_is_pos() & hit, 1).otherwise(0)).alias("fp"),
        F.sum(F.when(~_is_pos() & ~hit, 1).otherwise(0)).alias("tn"),
        F.sum(F.when(_is_pos() & ~hit, 1).otherwise(0)).alias("fn"))


def confusion_metrics(pred: DataFrame, group_cols: list[str]) -> DataFrame:
    """Sensitivity (= recall), specificity, accuracy, precision and F1; NULL on a zero denominator."""
    return _ratios(confusion_counts(pred, group_cols), group_cols)


def confusion_of_counts(counts: DataFrame, group_cols: list[str]) -> DataFrame:
    """:func:`confusion_metrics` of tp, fp, tn, fn that were counted over parts of the groups."""
    return _ratios(counts.groupBy(*group_cols).agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "tn", "fn")]), group_cols)


def _ratios(c: DataFrame, group_cols: list[str]) -> DataFrame:
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    sens = _ratio(tp, tp + fn)
    prec = _ratio(tp, tp + fp)
    return c.select(*group_cols, "tp", "fp", "tn", "fn",
                    sens.alias("sens"), _ratio(tn, tn + fp).alias("spec"),
                    _ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"),
                    prec.alias("precision"), sens.alias("recall"),
                    _ratio(2 * tp, 2 * tp + fp + fn).alias("f_score"))


def _score_counts(pred: DataFrame, group_cols: list[str]) -> DataFrame:
    p = pred.na.drop(subset=["class", "p_positive"])
    return p.groupBy(*group_cols, F.col("p_positive").alias("score")).agg(
        F.sum(F.when(_is_pos(), 1).otherwise(0)).alias("n_pos"),
        F.sum(F.when(_is_pos(), 0).otherwise(1)).alias("n_neg"))


def f_by_class(pred: DataFrame, group_cols: list[str]) -> DataFrame:
    """F1 of either class taken as the event: (<groups>, class, f_score)."""
    c = confusion_counts(pred, group_cols)
    wrong = F.col("fp") + F.col("fn")
    per_class = F.explode(F.array(*[
        F.struct(F.lit(name).alias("class"), _ratio(2 * F.col(hit), 2 * F.col(hit) + wrong).alias("f_score"))
        for name, hit in ((POS, "tp"), ("Negative", "tn"))]))
    return c.select(*group_cols, per_class.alias("_f")).select(*group_cols, "_f.class", "_f.f_score")


def auc(pred: DataFrame, group_cols: list[str]) -> DataFrame:
    """Exact ROC AUC with ties (Mann-Whitney form) per group; NULL for a single-class group."""
    sc = _score_counts(pred, group_cols)
    cum = grouped_cumsum(sc, group_cols, "score", ["n_neg"], ascending=True)
    part = cum.select(*group_cols, "n_pos", "n_neg",
                      (F.col("n_pos") * ((F.col("n_neg_cum") - F.col("n_neg"))
                                         + 0.5 * F.col("n_neg"))).alias("_u"))
    return auc_of_pairs(part.withColumnsRenamed({"_u": "won", "n_pos": "n1", "n_neg": "n0"}), group_cols)


def auc_of_pairs(pairs: DataFrame, group_cols: list[str]) -> DataFrame:
    """AUC per group from parts of its pairs of a positive and a negative row; NULL for a single-class group.

    ``won``: pairs in the right order, ties by half. ``n1``, ``n0``: positive and negative rows, each in one part.
    """
    g = pairs.groupBy(*group_cols).agg(F.sum("won").alias("_u"), F.sum("n1").alias("n1"),
                                       F.sum("n0").alias("n0"))
    return g.select(*group_cols, F.when((F.col("n1") > 0) & (F.col("n0") > 0),
                                        F.col("_u") / (F.col("n1") * F.col("n0")))
                    .alias("auc"))


def roc_counts(pred: DataFrame, group_cols: list[str]) -> DataFrame:
    """Per group and distinct score: tp/fp at threshold ``score`` (predict p >= score), P, N."""
    sc = _score_counts(pred, group_cols)
    cum = grouped_cumsum(sc, group_cols, "score", ["n_pos", "n_neg"], ascending=False)
    tot = sc.groupBy(*group_cols).agg(F.sum("n_pos").alias("P"), F.sum("n_neg").alias("N"))
    return (with_group_values(cum, tot, group_cols)
            .select(*group_cols, F.col("score").alias("threshold"),
                    F.col("n_pos_cum").alias("tp"), F.col("n_neg_cum").alias("fp"), "P", "N")
            .where((F.col("P") > 0) & (F.col("N") > 0)))


def roc_curve(pred: DataFrame, group_cols: list[str]) -> DataFrame:
    """ROC points per group: one per distinct score plus the (-inf) and (+inf) end points.

    ``specificity`` = share of negatives scored below the threshold, ``sensitivity`` =
    share of positives at or above it.  Groups without both classes are dropped.
    """
    rc = roc_counts(pred, group_cols)
    pts = rc.select(*group_cols, "threshold",
                    (1.0 - F.col("fp") / F.col("N")).alias("specificity"),
                    (F.col("tp") / F.col("P")).alias("sensitivity"))
    groups = rc.select(*group_cols).distinct()
    lo = groups.select(*group_cols, F.lit(float("-inf")).alias("threshold"),
                       F.lit(0.0).alias("specificity"), F.lit(1.0).alias("sensitivity"))
    hi = groups.select(*group_cols, F.lit(float("inf")).alias("threshold"),
                       F.lit(1.0).alias("specificity"), F.lit(0.0).alias("sensitivity"))
    return lo.unionByName(pts).unionByName(hi)


def _sens_rounds_to(tp: Column, p: Column, target_pct: int) -> Column:
    """round(tp / P, 2) == target / 100, decided on integers.

    Exact halves round to the even digit: 0.945 gives 0.94 and 0.955 gives 0.96, so for an
    odd target neither end belongs to it, for an even one both do.
    """
    lo = 10 * target_pct - 5
    hi = 10 * target_pct + 5
    share = F.lit(1000) * tp
    if target_pct % 2:
        return (share > F.lit(lo) * p) & (share < F.lit(hi) * p)
    return (share >= F.lit(lo) * p) & (share <= F.lit(hi) * p)


def spec_at_sens(pred: DataFrame, group_col: str = "Model", target_pct: int = 95,
                 rule: str = "round") -> DataFrame:
    """Best specificity among ROC thresholds whose sensitivity rounds to the target.

    A model with no such threshold is absent (as in the reference).  The end point
    at -inf has sensitivity 1 and is included like any other point.  ``rule='at_least'``
    takes thresholds with sensitivity >= target instead (every model then has one).
    """
    rc = roc_counts(pred, [group_col])
    lo = rc.select(group_col, "P", "N").distinct().select(
        group_col, F.col("P").alias("tp"), F.col("N").alias("fp"), "P", "N")
    pts = rc.select(group_col, "tp", "fp", "P", "N").unionByName(lo)
    if rule == "round":
        cond = _sens_rounds_to(F.col("tp"), F.col("P"), target_pct)
    elif rule == "at_least":
        cond = F.lit(100) * F.col("tp") >= F.lit(target_pct) * F.col("P")
    else:
        raise ValueError(f"unknown rule {rule!r}")
    hit = pts.where(cond)
    best = hit.groupBy(group_col).agg(F.max(1.0 - F.col("fp") / F.col("N")).alias("max_spec"))
    return best.withColumn("spec_label", sprintf3("Specificity = ", F.col("max_spec")))


def roc_markers(best: DataFrame, group_col: str = "Model", target: float = 0.95) -> DataFrame:
    """Marker points (max_spec, 0) and (max_spec, target) per model."""
    return best.select(group_col, F.col("max_spec").alias("x"),
                       F.explode(F.array(F.lit(0.0), F.lit(target))).alias("y"))


def model_names(df: DataFrame, col: str = "model_name", out: str = "Model") -> DataFrame:
    """Abbreviation -> display name; unknown values pass through unchanged."""
    m = F.create_map(*[F.lit(x) for kv in MODEL_NAMES.items() for x in kv])
    return df.withColumn(out, F.coalesce(F.element_at(m, F.col(col)), F.col(col)))


def metric_names(df: DataFrame, col: str = "metric", out: str = "metric_name") -> DataFrame:
    m = F.create_map(*[F.lit(x) for kv in METRIC_NAMES.items() for x in kv])
    return df.withColumn(out, F.coalesce(F.element_at(m, F.col(col)), F.col(col)))


def fold_metrics(pred: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """Long metric table ``(model_name, fold, metric, estimate)`` of out-of-fold predictions."""
    group_cols = group_cols or ["model_name", "fold"]
    cm = confusion_metrics(pred, group_cols)
    a = auc(pred, group_cols)
    wide = cm.join(a, group_cols, "full")
    stacked = F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col("auc" if m == "roc_auc" else m)
                 .cast("double").alias("estimate"))
        for m in METRICS]))
    return wide.select(*group_cols, stacked.alias("_m")).select(*group_cols, "_m.metric",
                                                                 "_m.estimate")


def metric_summary(metrics: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """Mean estimate per (model, metric); NULL when any fold's estimate is NULL."""
    group_cols = group_cols or ["model_name", "metric"]
    return metrics.groupBy(*group_cols).agg(
        F.when(F.count("estimate") == F.count(F.lit(1)), F.avg("estimate")).alias("mean"),
        F.count(F.lit(1)).alias("n_folds"))


def model_select(summary: DataFrame, metric: str = "roc_auc") -> DataFrame:
    """The best model by mean of ``metric`` (NULL means ignored; ties -> first model name)."""
    s = summary.where((F.col("metric") == metric) & F.col("mean").isNotNull())
    return s.orderBy(F.desc("mean"), F.asc("model_name")).limit(1)


def mean_auc(metrics: DataFrame) -> DataFrame:
    """Mean cross-validated AUC per model after dropping NULL folds, with its label."""
    a = metrics.where((F.col("metric") == "roc_auc") & F.col("estimate").isNotNull())
    g = a.groupBy("model_name").agg(F.avg("estimate").alias("mean_auc"))
    return g.withColumn("label_auc", sprintf3("AUC = ", F.col("mean_auc")))


def auc_by_model(test_pred: DataFrame, group_col: str = "Model") -> DataFrame:
    """Test AUC per model (single-class models dropped) with its label."""
    a = auc(test_pred, [group_col]).where(F.col("auc").isNotNull())
    return a.withColumn("label_auc", sprintf3("AUC = ", F.col("auc")))


def model_summary(best_spec: DataFrame, aucs: DataFrame, group_col: str = "Model") -> DataFrame:
    """Specificity-at-95%-sensitivity label joined with the AUC label per model."""
    return best_spec.select(group_col, "spec_label").join(
        aucs.select(group_col, "label_auc"), group_col, "inner")


def compare_models(aucs: DataFrame, curves: DataFrame, n: int = 3,
                   group_col: str = "Model") -> DataFrame:
    """ROC curves of the ``n`` best and ``n`` worst models by AUC (no ties; name breaks ties)."""
    top = aucs.orderBy(F.desc("auc"), F.asc(group_col)).limit(n).select(group_col)
    bottom = aucs.orderBy(F.asc("auc"), F.asc(group_col)).limit(n).select(group_col)
    chosen = [r[0] for r in top.unionByName(bottom).distinct().collect()]  # 2 n names at most
    return curves.where(F.col(group_col).isin(chosen))
