"""Benchmark: headline triage queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value" (total seconds), "unit", "queries", "sf"}.
Each query is executed in full with the no-op sink (no driver collect).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from litsift.session import get_spark  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=int(cpus))

    from litsift.models import cv
    from litsift.plans import queries as q
    from litsift.plans import workflows as w

    def cv_logit(spark, sf):
        _, train, _ = w._split(spark, sf)
        _, metrics = cv.cross_validate(train, ["logit"])
        return metrics

    headline = {
        "corpus": q.q_labelled_articles,
        "tfidf": q.q_tfidf,
        "term_rank_sum": q.q_term_rank_sum,
        "term_weights": q.q_term_weights,
        "roc_curve_folds": q.q_roc_curve_folds,
        "auc_by_fold": q.q_auc_by_fold,
        "ranked_list": q.q_ranked_list,
        "flagship": w.q_flagship,
        "cv_logit": cv_logit,
    }
    # warm-up: JVM start, first scan
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    times = {}
    for name, fn in headline.items():
        spark.catalog.clearCache()  # cold: nothing an earlier query cached is served again
        t0 = time.time()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "triage_headline_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
