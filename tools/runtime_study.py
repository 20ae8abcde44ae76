"""

Usage: python tools/runtime_study.py sf_dir [sf_dir ...] > runtime.jsonl
One JSON line per (sf, stage) with wall seconds; each stage runs to completion with
the no-op sink.  The last line is the linear trend of total seconds on documents.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    from pyspark.sql import functions as F

    from litsift.models import cv
    from litsift.models.classifiers import DEFAULT_MODELS
    from litsift.models.features import TfidfFeaturizer, add_tokens
    from litsift.plans import queries as q
    from litsift.plans.queries import Ctx
    from litsift.session import get_spark

    spark = get_spark()

    def run(df):
        df.write.format("noop").mode("overwrite").save()

    totals = []
    for sf_dir in sys.argv[1:]:
        sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
        out = {}
        c = Ctx(spark, sf_dir)
        t = time.time()
        n_train = c.train.count()
        n_test = c.test.count()
        out["corpus_build"] = time.time() - t
        tok = add_tokens(c.train.select("pmid", "abstract", "class", "label")).cache()
        t = time.time()
        fz = TfidfFeaturizer().fit(tok)
        run(fz.transform(tok))
        out["feature_fit"] = time.time() - t
        for m in DEFAULT_MODELS:
            t = time.time()
            _, metrics = cv.cross_validate(c.train, [m])
            run(metrics)
            out[f"cv_{m}"] = time.time() - t
        t = time.time()
        _, fitted = cv.fit_models(tok, ["logit"])
        out["final_fit_logit"] = time.time() - t
        t = time.time()
        run(cv.predict(fz, fitted["logit"], c.test))
        out["scoring"] = time.time() - t
        t = time.time()
        run(q.q_term_rank_sum(spark, sf_dir))
        out["term_rank_sum"] = time.time() - t
        t = time.time()
        run(q.q_roc_curve(spark, sf_dir))
        out["roc_curve"] = time.time() - t
        n_docs = n_train + n_test
        for k, v in out.items():
            print(json.dumps({"sf": sf, "n_docs": n_docs, "stage": k, "sec": round(v, 3)}),
                  flush=True)
        totals.append((n_docs, sum(out.values())))
    log = spark.createDataFrame(totals, "n_docs long, seconds double")
    r = log.agg(F.regr_slope("seconds", "n_docs").alias("slope"),
                F.regr_intercept("seconds", "n_docs").alias("intercept")).first()
    print(json.dumps({"trend_sec_per_doc": r["slope"], "intercept_sec": r["intercept"]}))


if __name__ == "__main__":
    main()
