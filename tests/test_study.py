"""Studies over nested samples against samples taken one by one."""

import hashlib

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from litsift.models import classifiers, study
from litsift.models.features import TfidfFeaturizer, add_tokens


@pytest.fixture(scope="module")
def train(spark):
    draw = np.random.default_rng(9)
    rows = []
    for i in range(130):
        positive = i % 5 < 2
        p = np.ones(30)
        p[:8] += 2.0 * positive
        own = draw.choice(30, size=int(draw.integers(5, 25)), p=p / p.sum())
        rows.append((f"id{i}", " ".join(f"word{j}" for j in own), "Positive" if positive else "Negative", float(positive)))
    return spark.createDataFrame(rows, "pmid string, abstract string, class string, label double").cache()


def order(rows, draw):
    return sorted(rows, key=lambda r: hashlib.md5(f"{r.pmid}:{draw}".encode()).hexdigest())


def test_scores_equal_separate_fits(spark, train):
    tok = add_tokens(train, stem=False)
    fz = TfidfFeaturizer().fit(tok)
    rows = fz.transform(tok).select("pmid", "class", "label", "features", vector_to_array("features").alias("x")).collect()
    got = {}
    for r in study.held_out_scores(train, [(10, 20), (30, 30)], draws=2, seed=7, stem=False).collect():
        got.setdefault((r.draw, r.n_pos, r.n_neg), []).append((r["class"], round(r.p_positive, 6)))
    assert len(got) == 4
    for draw in (7, 8):
        by_class = {c: order([r for r in rows if r["class"] == c], draw) for c in ("Positive", "Negative")}
        held = [r for own in by_class.values() for r in own[len(own) - len(own) // 5:]]
        for n_pos, n_neg in ((10, 20), (30, 30)):
            used = by_class["Positive"][:n_pos] + by_class["Negative"][:n_neg]
            assert not {r.pmid for r in used} & {r.pmid for r in held}
            df = spark.createDataFrame([(r.label, r.features) for r in used], train.sparkSession.createDataFrame(
                [(1.0, rows[0].features)], ["label", "features"]).schema)
            model = classifiers.registry()["nb"].fit(df)
            test = spark.createDataFrame([(r["class"], r.features) for r in held], spark.createDataFrame(
                [("a", rows[0].features)], ["class", "features"]).schema)
            want = sorted((r["class"], round(r.p_positive, 6)) for r in model.transform(test).collect())
            for (a, p), (b, q) in zip(sorted(got[draw, n_pos, n_neg]), want, strict=True):
                assert a == b and abs(p - q) < 2e-5


def test_sizes_and_mixes(train):
    curve = study.learning_curve(train, start=10, step=10, draws=3, stem=False).orderBy("size").collect()
    assert [r["size"] for r in curve] == [10, 20, 30, 40]
    assert all(r.n_draws == 3 and 0 <= r.mean_accuracy <= 1 and r.sd_auc is not None for r in curve)
    assert curve[-1].mean_auc > 0.6
    mix = study.class_mix(train, total=750, draws=2, stem=False).orderBy("n_pos").collect()
    assert {r.n_pos + r.n_neg for r in mix} == {50} and [r.n_pos for r in mix] == [10, 20, 30, 40]
    mix = study.class_mix(train, total=30, draws=2, stem=False).orderBy("n_pos").collect()
    assert [(r.n_pos, r.n_neg) for r in mix] == [(10, 20), (20, 10)]


def test_too_few_rows(train):
    few = train.filter(F.col("pmid").isin("id0", "id1", "id2", "id3"))
    assert study.learning_curve(few, stem=False).count() == 0
    assert study.class_mix(few, stem=False).count() == 0
    with pytest.raises(ValueError):
        study.held_out_scores(train, [(5, 10)])
