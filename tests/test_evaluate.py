import random

import pytest
from pyspark.sql import functions as F

from litsift.operators import evaluate


def _pred(spark, rows):
    return spark.createDataFrame(rows, "g string, pmid string, class string, p_positive double")


def brute_auc(rows):
    pos = [p for _, _, c, p in rows if c == "Positive"]
    neg = [p for _, _, c, p in rows if c != "Positive"]
    s = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg)
    return s / (len(pos) * len(neg))


def test_auc_with_ties_matches_pairs(spark):
    rnd = random.Random(3)
    rows = [("m", str(i), rnd.choice(["Positive", "Negative"]), rnd.randint(0, 6) / 6)
            for i in range(300)]
    got = evaluate.auc(_pred(spark, rows), ["g"]).first()["auc"]
    assert got == pytest.approx(brute_auc(rows))
    flipped = [(g, i, c, -p) for g, i, c, p in rows]
    got2 = evaluate.auc(_pred(spark, flipped), ["g"]).first()["auc"]
    assert got + got2 == pytest.approx(1.0)


def test_constant_score_and_single_class(spark):
    rows = [("m", str(i), "Positive" if i % 3 else "Negative", 0.3) for i in range(30)]
    rows += [("one", str(i), "Positive", i / 10) for i in range(5)]
    out = {r["g"]: r["auc"] for r in evaluate.auc(_pred(spark, rows), ["g"]).collect()}
    assert out["m"] == pytest.approx(0.5)
    assert out["one"] is None


def test_roc_curve_points(spark):
    rows = [("m", "1", "Positive", 0.9), ("m", "2", "Negative", 0.9), ("m", "3", "Positive", 0.4),
            ("m", "4", "Negative", 0.1)]
    pts = sorted((r["threshold"], r["specificity"], r["sensitivity"])
                 for r in evaluate.roc_curve(_pred(spark, rows), ["g"]).collect())
    assert pts == [(float("-inf"), 0.0, 1.0), (0.1, 0.0, 1.0), (0.4, 0.5, 1.0),
                   (0.9, 0.5, 0.5), (float("inf"), 1.0, 0.0)]


def test_confusion_metrics_null_denominator(spark):
    rows = [("m", str(i), "Positive" if i % 2 else "Negative", 0.1) for i in range(10)]
    r = evaluate.confusion_metrics(_pred(spark, rows), ["g"]).first()
    assert r["precision"] is None and r["sens"] == 0.0 and r["spec"] == 1.0


def test_spec_at_sens_integer_rule(spark):
    # 20 positives: tp = 19 gives sensitivity 0.95 exactly
    rows = [("m", f"p{i}", "Positive", 1.0 - i / 100) for i in range(20)]
    rows += [("m", f"n{i}", "Negative", 0.5 - i / 100) for i in range(10)]
    pred = _pred(spark, rows).withColumnRenamed("g", "Model")
    r = evaluate.spec_at_sens(pred).first()
    assert r["max_spec"] == pytest.approx(1.0)
    assert r["spec_label"] == "Specificity = 1.000"


def test_spec_at_sens_at_least_rule(spark):
    rows = [("m", f"p{i}", "Positive", 1.0 - i / 100) for i in range(10)]
    rows += [("m", f"n{i}", "Negative", 0.5 - i / 100) for i in range(10)]
    pred = _pred(spark, rows).withColumnRenamed("g", "Model")
    # 10 positives: sensitivity jumps 0.9 -> 1.0, never rounds to 0.95
    assert evaluate.spec_at_sens(pred).count() == 0
    r = evaluate.spec_at_sens(pred, rule="at_least").first()
    assert r["max_spec"] == pytest.approx(1.0)


def test_labels_round_exact_halves_to_even(spark):
    from litsift.functions.numeric import sprintf3
    values = [0.8125, 0.0625, 0.1875, 0.6125, 0.0005, 0.9995, 0.12345, 1.0, 0.0, 0.3335, 0.5, 2 / 3, 0.4375]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r.v: r.s for r in df.select("v", sprintf3("x = ", F.col("v")).alias("s")).collect()}
    assert got == {v: "x = %.3f" % v for v in values}


def test_sensitivity_ends_of_the_rounding_interval(spark):
    from litsift.operators.evaluate import _sens_rounds_to
    df = spark.createDataFrame([(k, 1000) for k in (944, 945, 946, 954, 955, 956)], "tp long, p long")
    got = {r.tp for r in df.where(_sens_rounds_to(F.col("tp"), F.col("p"), 95)).collect()}
    assert got == {946, 954}
    got = {r.tp for r in df.where(_sens_rounds_to(F.col("tp"), F.col("p"), 96)).collect()}
    assert got == {955, 956}
