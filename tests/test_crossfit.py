"""Fits of all folds together against separate fits."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from litsift.models import classifiers, crossfit
from litsift.models.features import TfidfFeaturizer
from litsift.operators.sampling import assign_folds


@pytest.fixture(scope="module")
def train(spark):
    draw = np.random.default_rng(5)
    words = [f"word{i}" for i in range(60)]
    rows = []
    for i in range(150):
        positive = draw.random() < 0.45
        p = np.ones(60)
        p[:12] += 1.6 * positive
        own = draw.choice(60, size=int(draw.integers(3, 40)), p=p / p.sum())
        rows.append((f"id{i}", " ".join(words[j] for j in own), "Positive" if positive else "Negative", float(positive)))
    return spark.createDataFrame(rows, "pmid string, abstract string, class string, label double").repartition(3).cache()


@pytest.fixture(scope="module")
def design(train):
    made = crossfit.Design(train, v=3, stem=False)
    yield made
    made.release()


def separate(design, k):
    rows = design.tokens.where(F.col("fold") != k)
    fz = TfidfFeaturizer().fit(rows)
    return rows, fz, fz.transform(rows).cache()


def test_folds_are_those_of_the_row_order(train, design):
    want = {r.pmid: r.fold for r in assign_folds(train, v=3, tie=["class"]).collect()}
    assert {r.pmid: r.fold for r in design.tokens.collect()} == want


def test_recipes_equal_separate_ones(design):
    for k in [0, 1, 2, 3]:
        _, fz, _ = separate(design, k)
        assert design.recipes[k].vocab == fz.vocab
        assert np.allclose(design.recipes[k].idf, fz.idf, rtol=0, atol=1e-12)


def test_moments_equal_separate_ones(design):
    moments = crossfit.class_moments(design, [1, 2])
    for k in (1, 2):
        _, fz, feats = separate(design, k)
        want = classifiers.class_moments(feats, fz.size)
        for c in (0, 1):
            n, mean, cov = want[float(c)]
            assert moments[k][c].n == n
            assert np.allclose(moments[k][c].mean, mean, atol=1e-9)
            assert np.allclose(moments[k][c].cov, cov, atol=1e-9)


def test_closed_models_equal_separate_fits(design):
    models = crossfit.fit(design, ["ldm", "pls", "nb", "null"], [1])
    _, fz, feats = separate(design, 1)
    own = fz.transform(design.tokens.where("fold = 1"))
    specs = classifiers.registry()
    got = {(r.model_name, r.pmid): r.p_positive for r in crossfit.predictions(design, {
        (k, n): m for k in (1, 2, 3) for (_, n), m in models.items()}).where("fold = 1").collect()}
    for name in ("ldm", "pls", "nb", "null"):
        want = {r.pmid: r.p_positive for r in specs[name].fit(feats).transform(own).collect()}
        again = {r.pmid: r.p_positive for r in models[1, name].transform(own).collect()}
        for pmid, p in want.items():
            assert abs(got[name, pmid] - p) < 1e-6, name
            assert abs(again[pmid] - p) < 1e-6, name


def objective(x, y, w, b, l1, l2, loss):
    m = x @ w + b
    z = (2 * y - 1) * m
    fit = np.logaddexp(0, -z).mean() if loss == "logistic" else np.maximum(1 - z, 0).mean()
    scaled = w * x.std(0, ddof=1)
    return fit + l1 * np.abs(scaled).sum() + l2 / 2 * (scaled @ scaled)


@pytest.mark.parametrize("name", ["logit", "mr", "svm_linear"])
def test_penalised_fits_reach_the_single_fits(design, name):
    rows, fz, feats = separate(design, 1)
    data = feats.select(vector_to_array("features").alias("x"), "label").collect()
    x, y = np.array([r.x for r in data]), np.array([r.label for r in data])
    problem = crossfit.penalised(design, name, 1, len(y))[0]
    crossfit.solve(design, [problem])
    assert problem.done
    u, b = problem.raw(problem.at)
    own = objective(x, y, u, b, problem.l1, problem.l2, problem.loss)
    if name == "svm_linear":
        single = classifiers.SvmSpec()._svc(len(y)).fit(feats)
        w, c = single.coefficients.toArray(), single.intercept
    else:
        single = classifiers.registry()[name].fit(feats).model
        two = single.coefficientMatrix.toArray()
        w = two[1] - two[0] if name == "mr" else two[0]
        c = single.interceptVector.toArray()
        c = c[1] - c[0] if name == "mr" else c[0]
    assert own <= objective(x, y, w, c, problem.l1, problem.l2, problem.loss) + 1e-6
    if name != "svm_linear":
        assert problem.residual() < 1e-4
        assert problem.passes < 30


def test_all_problems_in_the_same_passes(design):
    problems = [p for k in (1, 2, 3) for name in ("logit", "mr") for p in crossfit.penalised(design, name, k, 100)]
    crossfit.solve(design, problems)
    alone = crossfit.penalised(design, "logit", 2, 100)
    crossfit.solve(design, alone)
    assert np.allclose(alone[0].at, problems[2].at, atol=1e-9)


def test_one_class_and_empty(spark):
    rows = [(f"p{i}", "some words here", "Positive", 1.0) for i in range(7)]
    made = crossfit.Design(spark.createDataFrame(rows, "pmid string, abstract string, class string, label double"), v=2)
    models = crossfit.fit(made, list(crossfit.TOGETHER), [1, 2])
    assert all(type(m).__name__ == "_NullModel" for m in models.values())
    assert {r.p_positive for r in crossfit.predictions(made, models).collect()} == {1.0}
    made.release()
    empty = crossfit.Design(spark.createDataFrame([], "pmid string, abstract string, class string, label double"), v=2)
    assert crossfit.predictions(empty, crossfit.fit(empty, ["logit", "null"], [1, 2])).count() == 0
    empty.release()


def test_hinge_derivatives():
    m = np.linspace(-2, 3, 401)
    for y in (0.0, 1.0):
        label = np.full(len(m), y)
        loss, g, h = crossfit.losses("hinge", 0.5, label, m)
        assert np.allclose(np.gradient(loss, m)[1:-1], g[1:-1], atol=0.02)
        assert np.all(np.abs(loss - np.maximum(1 - (2 * y - 1) * m, 0)) <= 0.25 + 1e-12)
        assert math.isclose(h.max(), 2.0)


def test_driver_gets_vectors_of_a_penalised_fit_only(design, monkeypatch):
    sizes, summed = [], design.summed

    def seen(*args, **kw):
        found = summed(*args, **kw)
        sizes.extend(len(v) for v in found.values())
        return found

    monkeypatch.setattr(design, "summed", seen)
    width = len(design.recipes[1].vocab)
    problems = crossfit.solve(design, crossfit.penalised(design, "svm_linear", 1, 100))
    assert all(p.done for p in problems)
    assert max(sizes) <= 2 * (width + 1) + len(crossfit.STEPS) + 2


def test_outer_products_travel_as_the_fewer_numbers():
    import numpy as np
    import pyarrow as pa
    from litsift.models import crossfit
    draw = np.random.default_rng(3)
    for counts in ([2, 1], [4, 9, 0, 3], [30, 1]):
        sums, parts = {}, [draw.standard_normal((n, 8)) for n in counts]
        for x in parts:
            crossfit.add(sums, 5, np.array([len(x), x.sum()]), x)
        x = np.concatenate(parts)
        assert np.allclose(sums[5].whole(), np.concatenate([[len(x), x.sum()], (x.T @ x).ravel()]))
        sent = sums[5].table(5)
        assert sum(len(sent.column(c)[0].as_py()) for c in ("rows", "triangle")) <= 8 * (8 * 4 + 36)
        both = crossfit._added(pa.concat_tables([sent, sent]))
        assert np.allclose(both.whole(), 2 * sums[5].whole())
    few = {}
    crossfit.add(few, 0, np.zeros(1), np.ones((2, 500)))
    assert few[0].table(0).nbytes < 500 * 500


def test_hinge_fits_end_at_the_bound_in_few_passes(spark):
    draw = np.random.default_rng(11)
    rows = []
    for i in range(900):
        own = draw.choice(80, size=25)
        positive = float(draw.random() < 1 / (1 + np.exp(-(own < 20).sum() + 6.25)))
        rows.append((f"id{i}", " ".join(f"word{j}" for j in own), "Positive" if positive else "Negative", positive))
    made = crossfit.Design(spark.createDataFrame(rows, "pmid string, abstract string, class string, label double"), v=0, stem=False)
    problems = crossfit.solve(made, crossfit.penalised(made, "svm_linear", crossfit.WHOLE, 900))
    assert all(p.done for p in problems)
    assert max(p.passes for p in problems) < 100
    fz = made.recipes[crossfit.WHOLE].featurizer()
    data = fz.transform(made.tokens).select(vector_to_array("features").alias("x"), "label", "inner").collect()
    for p in problems:
        own = [r for r in data if r.inner != p.inner]
        x, y = np.array([r.x for r in own]), np.array([r.label for r in own])
        w, b = p.raw(p.at)
        here = objective(x, y, w, b, p.l1, p.l2, "hinge")
        for step in (1e-4, -1e-4):  # no coordinate leads lower
            for j in range(0, x.shape[1], 8):
                near = w.copy()
                near[j] += step / x[:, j].std(ddof=1)
                assert objective(x, y, near, b, p.l1, p.l2, "hinge") >= here - 1e-9
            assert objective(x, y, w, b + step, p.l1, p.l2, "hinge") >= here - 1e-9
    made.release()
