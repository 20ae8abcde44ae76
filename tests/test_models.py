"""Every model beats the null model on a separable corpus (F12); persistence round trip."""

import random

import pytest
from pyspark.sql import functions as F

from litsift.models import cv
from litsift.models.classifiers import load_model, registry, save_model
from litsift.models.features import FittedFeaturizer, TfidfFeaturizer, add_tokens
from litsift.operators.evaluate import auc

POS_WORDS = ["allergen", "antibody", "histamine", "mast", "ige", "eosinophil"]
NEG_WORDS = ["galaxy", "orbit", "telescope", "comet", "nebula", "quasar"]
NOISE = ["study", "result", "method", "analysis", "sample", "data", "group", "effect"]


def corpus(spark, n=40, seed=11):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        pos = i % 2 == 0
        # varying marker and noise counts: no exact linear constraint within a class
        words = (rnd.choices(POS_WORDS if pos else NEG_WORDS, k=rnd.randint(3, 8))
                 + rnd.choices(NOISE, k=rnd.randint(6, 14)))
        rnd.shuffle(words)
        rows.append((str(1000 + i), " ".join(words), "Positive" if pos else "Negative",
                     1.0 if pos else 0.0))
    return spark.createDataFrame(rows, "pmid string, abstract string, class string, label double")


@pytest.fixture(scope="module")
def fitted_all(spark):
    train = corpus(spark, 40, 11)
    test = corpus(spark, 20, 12)
    tok = add_tokens(train)
    specs = registry(rf_trees=50)
    names = list(specs)
    fz, fitted = cv.fit_models(tok, names, specs=specs)
    return fz, fitted, test


def test_every_model_beats_null(spark, fitted_all):
    fz, fitted, test = fitted_all
    aucs = {}
    for name, m in fitted.items():
        pred = cv.predict(fz, m, test).withColumn("g", F.lit(name))
        aucs[name] = auc(pred, ["g"]).first()["auc"]
    assert aucs["null"] == pytest.approx(0.5)
    for name, a in aucs.items():
        if name != "null":
            assert a > 0.6, (name, a)


def test_save_load_round_trip(spark, fitted_all, tmp_path):
    fz, fitted, test = fitted_all
    fz.save(spark, str(tmp_path / "fz"))
    fz2 = FittedFeaturizer.load(spark, str(tmp_path / "fz"))
    assert fz2.vocab == fz.vocab
    _, together = cv.fit_all_rows(corpus(spark, 40, 11), ["nb", "svm_linear"])
    own = dict(fitted, quadratic=together["nb"], sigmoid=together["svm_linear"])
    for name in ["logit", "ldm", "null", "svm_linear", "knn", "nb", "pls", "mr", "rf", "quadratic", "sigmoid"]:
        fitted = own
        save_model(spark, fitted[name], str(tmp_path / name))
        m2 = load_model(spark, str(tmp_path / name))
        a = {r["pmid"]: r["p_positive"] for r in cv.predict(fz, fitted[name], test).collect()}
        b = {r["pmid"]: r["p_positive"] for r in cv.predict(fz2, m2, test).collect()}
        assert a.keys() == b.keys()
        assert all(a[k] == pytest.approx(b[k]) for k in a), name


def test_fold_vocabulary_never_sees_assessment_rows(spark):
    train = corpus(spark, 40, 13)
    tok = add_tokens(train)
    from litsift.operators.sampling import assign_folds
    folds = assign_folds(tok, 5, 42)
    ana = folds.where("fold != 1")
    fz = TfidfFeaturizer().fit(ana)
    ana_terms = {t for r in ana.select("tokens").collect() for t in r[0]}
    assert set(fz.vocab) <= ana_terms


def _knn_frame(spark, x, label):
    from pyspark.ml.functions import array_to_vector
    rows = [(str(i), [float(v) for v in x[i]], float(label[i])) for i in range(len(x))]
    return spark.createDataFrame(rows, "pmid string, x array<double>, label double").select(
        "pmid", array_to_vector("x").alias("features"), "label")


@pytest.mark.parametrize("scale, block", [(False, 2048), (True, 2048), (False, 17)])
def test_knn_is_exact(spark, monkeypatch, scale, block):
    import numpy as np
    from litsift.models import neighbours
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", block)
    draw = np.random.default_rng(5)
    x = draw.integers(0, 3, (300, 4)).astype(float)  # many ties and equal rows
    df = _knn_frame(spark, x, np.arange(300) % 2)
    out = neighbours.KnnSpec(scale=scale).fit(df).transform(df).collect()
    assert len(out) == 300
    sd = x.std(axis=0, ddof=1) if scale else 1.0
    for r in out:
        d = np.sqrt((((x - x[int(r.pmid)]) / sd) ** 2).sum(axis=1))
        near = sorted((round(d[i], 9), i % 2) for i in range(300))[:5]
        weight = [1 / (a + 1e-9) for a, _ in near]
        want = sum(w * b for w, (_, b) in zip(weight, near)) / sum(weight)
        assert r.p_positive == pytest.approx(want, abs=1e-6)


def test_knn_rows_keep_their_best_over_many_blocks():
    import numpy as np
    from litsift.models import neighbours
    draw = np.random.default_rng(8)
    x, y, q = draw.integers(0, 3, (200, 9)) * 1.5, np.arange(200) % 2.0, draw.integers(0, 3, (30, 9)) * 1.5
    far = float(np.abs(x).sum())
    best = neighbours._Best(neighbours._pack(np.arange(30), q), 9, 5, np.zeros((1, 9)), [(0, 0.0, far, 20, [far] * 5)], np.ones(9))
    for a in range(0, 200, 10):  # 20 blocks
        best.meet(0, *neighbours._unpack(neighbours._pack(y[a:a + 10], x[a:a + 10]), 9, "<f8"))
    out = best.found().to_pydict()
    assert len(out["row"]) == 30 * 5  # k for each row, not k for each row and block
    for i in range(30):
        d = np.round(np.sqrt(((x - q[i]) ** 2).sum(1)), 9)
        want = sorted(zip(d.tolist(), y.tolist()))[:5]
        assert sorted((b, c) for a, b, c in zip(out["row"], out["distance"], out["label"]) if a == i) == want


def test_knn_leaves_far_blocks_out_and_takes_few_rows(spark):
    import numpy as np
    from litsift.models import neighbours
    draw = np.random.default_rng(6)
    centres = draw.standard_normal((8, 5)) * 100
    x = centres[np.arange(1200) % 8] + draw.standard_normal((1200, 5))
    model = neighbours.KnnSpec().fit(_knn_frame(spark, x, np.arange(1200) % 2))
    assert len(model.pivots) > 1
    one = _knn_frame(spark, x[:40], np.zeros(40))
    got = {int(r.pmid): r.p_positive for r in model.transform(one).collect()}
    for i in range(40):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        near = np.argsort(d, kind="stable")[:5]
        w = 1 / (np.round(d[near], 9) + 1e-9)
        assert got[i] == pytest.approx((w * (near % 2)).sum() / w.sum(), abs=1e-6)
    few = neighbours.KnnSpec().fit(_knn_frame(spark, x[:3], [1, 1, 0]))
    assert few.transform(one).count() == 40  # fewer labelled rows than neighbours
    assert few.transform(one.limit(0)).count() == 0
    with pytest.raises(ValueError):
        neighbours.KnnSpec().fit(_knn_frame(spark, x[:3], [1, 1, 0]).limit(0))


def test_knn_takes_few_distances_however_the_blocks_come(monkeypatch):
    import numpy as np
    from litsift.models import neighbours
    taken = []

    class Counting:
        def __getattr__(self, name):
            return getattr(np, name)

        def lexsort(self, keys, **kw):
            if not kw:  # the rows whose distances were taken in double precision
                taken.append(len(keys[0]))
            return np.lexsort(keys, **kw)

    monkeypatch.setattr(neighbours, "np", Counting())
    draw = np.random.default_rng(9)
    for scale in (1e-9, 1.0, 1e18):
        taken.clear()
        q = draw.random((20, 40)) * (draw.random((20, 40)) < 0.2)
        blocks = [q[draw.integers(0, 20, 200)] + draw.random((200, 40)) * far for far in np.linspace(3, 0.1, 10)]  # each nearer than the last
        x, y, q = np.concatenate(blocks) * scale, np.arange(2000) % 2.0, q * scale
        far = float(np.abs(x).sum())
        best = neighbours._Best(neighbours._pack(np.arange(20), q), 40, 5, np.zeros((1, 40)), [(0, 0.0, far, 10, [far] * 5)], np.ones(40))
        for a in range(0, 2000, 200):
            best.meet(0, *neighbours._unpack(neighbours._pack(y[a:a + 200], x[a:a + 200]), 40, "<f8"))
        d = np.round(np.sqrt(((q[:, None, :] - x[None]) ** 2).sum(2)), 9)
        want = np.sort(d, axis=1)[:, :5]
        assert np.allclose(best.distance, want, rtol=1e-12, atol=0)
        if scale >= 1:
            assert sum(taken) < 20 * 10 * 5 * 3  # of 20 x 2,000
