import time

from litsift.models import cv
from litsift.operators import evaluate
from litsift.plans import workflows


def test_rows_hold_wall_seconds(spark, monkeypatch):
    summary = spark.createDataFrame([("roc_auc", 0.5)], "metric string, mean double")
    monkeypatch.setattr(cv, "cross_validate", lambda *a, **k: (None, time.sleep(0.05)))
    monkeypatch.setattr(evaluate, "metric_summary", lambda metrics: summary)
    train = spark.createDataFrame([(str(i), "Positive" if i % 2 else "Negative") for i in range(20)], "pmid string, class string")
    rows = workflows.learning_curve(train, start=5, step=5, repeats=2).collect()
    assert [r.n_docs for r in rows] == [8, 16] and all(r.n_runs == 2 and r.mean_auc == 0.5 for r in rows)
    assert all(0.05 <= r.seconds < 60 for r in rows)
