"""Rows that have their words already are fitted on and scored without their texts."""

import numpy as np
from pyspark import StorageLevel

from litsift.models import cv
from litsift.models.features import add_tokens


def test_fits_and_scores_of_words_equal_those_of_texts(spark):
    draw = np.random.default_rng(2)
    rows = []
    for i in range(80):
        p = np.ones(20)
        p[:6] += 2.0 * (i % 2)
        rows.append((f"id{i % 75}", " ".join(f"running{j}s" for j in draw.choice(20, size=int(draw.integers(1, 12)), p=p / p.sum())),
                     "Positive" if i % 2 else "Negative", float(i % 2)))
    train = spark.createDataFrame(rows, "pmid string, abstract string, class string, label double")
    fz, fitted = cv.fit_all_rows(train, ["logit"])
    want = sorted(tuple(r) for r in cv.predict(fz, fitted["logit"], train).select("pmid", "p_positive", "pred_class").collect())
    for kept in (True, False):
        tok = add_tokens(train).drop("abstract")
        if kept:
            tok = tok.persist(StorageLevel.MEMORY_AND_DISK)
        fz2, fitted2 = cv.fit_all_rows(tok, ["logit"])
        assert tok.storageLevel.useMemory == kept  # a caller's own rows are not released
        assert fz2.vocab == fz.vocab and fz2.idf == fz.idf
        once = cv.predict(fz2, fitted2["logit"], tok, keep_tokens=True)
        twice = cv.predict(fz, fitted["logit"], once.drop("p_positive", "pred_class"))
        assert "tokens" in once.columns and "tokens" not in twice.columns
        for got in (once, twice):
            got = sorted(tuple(r) for r in got.select("pmid", "p_positive", "pred_class").collect())
            assert [(a, c) for a, _, c in got] == [(a, c) for a, _, c in want]
            assert np.allclose([b for _, b, _ in got], [b for _, b, _ in want], atol=1e-9)
        tok.unpersist()
