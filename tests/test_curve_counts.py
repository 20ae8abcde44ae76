"""The learning curve's counts, made in tasks of a run of sizes and two blocks, against its scores row by row."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from litsift.models import study
from litsift.operators import evaluate


@pytest.fixture(scope="module")
def train(spark):
    draw = np.random.default_rng(4)
    rows = []
    for i in range(170):
        positive = i % 7 < 4
        p = np.ones(25)
        p[:7] += 1.5 * positive
        own = draw.choice(25, size=int(draw.integers(0, 14)), p=p / p.sum())
        rows.append((f"id{i % 160}", " ".join(f"word{j}" for j in own), "Positive" if positive else "Negative", float(positive)))
    rows.append(("odd", "word1 word2", None, None))
    return spark.createDataFrame(rows, "pmid string, abstract string, class string, label double").cache()


def plain(train, sizes, model):
    """AUC and accuracy from the scores of all held-out rows."""
    keys = ["draw", "size"]
    scores = study.held_out_scores(train.filter("class is not null"), [(n, n) for n in sizes], model, draws=3, stem=False) \
        .withColumnRenamed("n_pos", "size").drop("n_neg").cache()
    both = evaluate.auc(scores, keys).join(evaluate.confusion_metrics(scores, keys), keys)
    return {(r.draw, r["size"]): (r.auc, r.accuracy, r.tp, r.fp, r.tn, r.fn) for r in both.collect()}


@pytest.mark.parametrize("model,run,held", [("nb", 2, 3), ("nb", 1024, 50_000), ("null", 1, 7)])
def test_counts_equal_all_scores(train, monkeypatch, model, run, held):
    monkeypatch.setattr(study, "RUN", run)
    monkeypatch.setattr(study, "HELD", held)
    monkeypatch.setattr(study, "SCORED", 1)
    sizes = [20, 30, 40, 50]
    whole = train.filter("class is not null")
    counts = study.curve_counts(whole, sizes, model, draws=3, stem=False).cache()
    auc = evaluate.auc_of_pairs(counts, ["draw", "size"])
    got = auc.join(evaluate.confusion_of_counts(counts, ["draw", "size"]), ["draw", "size"]).collect()
    want = plain(train, sizes, model)
    assert len(got) == len(want) == 12
    for r in got:
        assert all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip((r.auc, r.accuracy, r.tp, r.fp, r.tn, r.fn), want[r.draw, r["size"]], strict=True))


def test_rows_without_class_are_no_part(train):
    assert study.curve_counts(train, [10, 20], draws=2, stem=False).agg(F.count(F.lit(1)), F.min("tp")).first()[0] == 4


def test_texts_without_words(spark):
    rows = [(str(i), "of the", "Positive" if i % 2 else "Negative", float(i % 2)) for i in range(40)]
    train = spark.createDataFrame(rows, "pmid string, abstract string, class string, label double")
    got = study.learning_curve(train, start=10, draws=2, stem=False).collect()
    assert [(r["size"], r.mean_auc, r.mean_accuracy) for r in got] == [(10, 0.5, 0.5)]
