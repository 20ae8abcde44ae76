import numpy as np

from litsift.llm import quality

from .rows import ROWS, documents


def test_expectation_maximisation_finds_the_accuracies():
    draw = np.random.default_rng(4)
    good = draw.random(20000) < 0.8
    n = len(quality.MEASURES)
    hit, wrong = draw.uniform(0.4, 0.8, n), draw.uniform(0.005, 0.03, n)
    cast = np.where(draw.random((20000, n)) < np.where(good[:, None], wrong, hit), 1, 0)
    prose = np.where(draw.random(20000) < np.where(good, 0.9, 0.02), 2, 0)
    patterns, counts = np.unique(np.concatenate([cast, prose[:, None]], 1) @ quality._POWERS, return_counts=True)
    posterior, shares, prior = quality.learn(patterns, counts)
    assert abs(prior - good.mean()) < 0.01
    assert np.abs(shares[0, :n, 1] - hit).max() < 0.04 and np.abs(shares[1, :n, 1] - wrong).max() < 0.01
    assert np.all((posterior >= 0) & (posterior <= 1))
    assert quality.learn(np.zeros(0, np.int64), np.zeros(0, np.int64))[2] == 0.5


def test_measures_against_plain_counts(spark):
    text = "ONE one one ## a-b c.\nThe end.\nno stop"
    own = quality.Texts(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text), len(text)]))
    got = dict(zip([m[0] for m in quality.MEASURES], own.measures()[0]))
    words = text.split()
    assert own.counts.tolist() == [len(words), 0]
    assert got["symbols"] == 2 / len(text) and got["marks"] == 1 / len(words) and got["repeats"] == 1 / len(words)
    letters = [c for c in text if c.isalpha()]
    assert got["capitals"] == sum(c.isupper() for c in letters) / len(letters)
    assert np.isnan(got["top_word"]) and got["open_lines"] == 1 / 3 and got["odd_words"] == 2 / len(words)


def test_awkward_rows(spark):
    docs = documents(spark, "score long, posterior string")
    got = quality.predict(docs, quality.fit(docs)).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert 0 <= r.score <= 1 and r.keep == (r.score >= quality.KEEP)
        if r.doc_id in (3, 4, 5):
            assert r.score == 0 and r.posterior == 0
    assert quality.predict(docs.limit(0), quality.fit(docs.limit(0))).count() == 0


def test_held_out_accuracy_on_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.op7_weak_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good = [r.keep for r in got if r.quality == 1]
    bad = [r.keep for r in got if r.quality == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.1 * len(bad)
