"""The forest: rows that go to one task and nodes that are split over all tasks make the same trees."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from litsift.models import forest
from litsift.models.classifiers import load_model, save_model


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = np.where(rng.random((700, 12)) < 0.4, rng.integers(1, 60, (700, 12)) / 7.0, 0.0)
    y = ((x[:, 0] > 2) ^ (x[:, 3] > 1)).astype(float)
    y = np.where(rng.random(700) < 0.1, 1 - y, y)
    data = [(i, Vectors.sparse(12, [(j, float(c)) for j, c in enumerate(v) if c]), float(own))
            for i, (v, own) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, ["pmid", "features", "label"]).repartition(3).cache()


def scores(model, rows):
    return {r.pmid: r.p_positive for r in model.transform(rows).collect()}


def test_tops_split_over_tasks_make_the_same_trees(spark, rows, monkeypatch):
    whole = scores(forest.ForestSpec(25, least=3).fit(rows), rows)
    monkeypatch.setattr(forest, "LOCAL_ROWS", 60)
    monkeypatch.setattr(forest, "PASS_CELLS", 40 * 2 * 4 * forest.BINS)  # several passes a level
    model = forest.ForestSpec(25, least=3).fit(rows)
    assert max(len(t) for t in model.tops) > 10
    parts = scores(model, rows)
    assert len(whole) == 700
    assert all(abs(parts[k] - v) < 1e-12 for k, v in whole.items())
    right = sum((whole[r.pmid] >= 0.5) == (r.label == 1.0) for r in rows.collect())
    assert right > 560


@pytest.mark.parametrize("every", [False, True])
def test_saved_forest_scores_alike(spark, rows, tmp_path, every):
    model = forest.ForestSpec(12, all_features=every, least=2).fit(rows)
    save_model(spark, model, str(tmp_path / "m"))
    assert scores(load_model(spark, str(tmp_path / "m")), rows) == pytest.approx(scores(model, rows), abs=1e-12)


def test_grow_agrees_with_a_scan_of_all_splits(spark):
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 6, (80, 4)).astype(np.uint8), (rng.random(80) < 0.4).astype(float)
    w = rng.integers(0, 3, 80).astype(float)
    tree = forest.grow(x, y, w, forest._root(0, 1), 0, forest.Shape(4, 5, 4))

    def gini(use):
        n, k = w[use].sum(), (w * y)[use].sum()
        return 2 * k * (n - k) / n if n else 0.0

    def check(node, use, depth):
        n, k = w[use].sum(), (w * y)[use].sum()
        assert tree["p"][node] == pytest.approx(k / n)
        gains = {}
        for f in range(4):
            for c in range(forest.BINS - 1):
                left, right = use & (x[:, f] <= c), use & (x[:, f] > c)
                if min(w[left].sum(), w[right].sum()) >= 5:
                    gains[f, c] = (gini(use) - gini(left) - gini(right)) / n
        best = max(gains.values(), default=0.0)
        if tree["feature"][node] < 0:
            assert depth == 4 or best <= 1e-12 or n < 10
            return
        f, c = tree["feature"][node], tree["bin"][node]
        assert gains[f, c] == pytest.approx(best)
        check(tree["left"][node], use & (x[:, f] <= c), depth + 1)
        check(tree["left"][node] + 1, use & (x[:, f] > c), depth + 1)

    check(0, w > 0, 0)


def test_limits_are_middles_of_distinct_values():
    assert forest.limits(np.array([1.0, 3.0, 3.0]), 2).tolist() == [0.5, 2.0]
    many = forest.limits(np.arange(1.0, 1001.0), 0)
    assert len(many) <= forest.BINS - 1 and np.all(np.diff(many) > 0) and abs(len(many) - 31) <= 1


def test_rows_of_all_blocks_come_in_the_order_of_their_numbers():
    import pyarrow as pa
    rng = np.random.default_rng(4)
    x, row, y = rng.integers(0, 3, (50, 11)).astype(np.uint8), rng.permutation(50) + 7, rng.random(50).round()
    packed = pa.chunked_array([pa.array([forest._pack(x[a:b], row[a:b], y[a:b]) for a, b in ends], pa.binary())
                               for ends in ([(0, 20), (20, 21)], [(21, 50)])])
    got = forest._gathered(packed, 11)
    order = np.argsort(row)
    assert all(np.array_equal(a, b) for a, b in zip(got, (x[order], row[order], y[order])))
