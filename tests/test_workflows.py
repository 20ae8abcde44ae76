"""All models' predictions: the articles are analysed once."""

from pyspark.sql import functions as F

from litsift.models import cv
from litsift.plans import workflows
from litsift.plans.queries import Ctx


def test_articles_are_analysed_once_for_all_models(spark, tmp_path, monkeypatch):
    docs = [(i, " ".join(f"word{(i * j) % 23}" for j in range(1, 9 + i % 5)), "en" if i % 11 else "de", "web") for i in range(240)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 == 0), 0) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(workflows, "DEFAULT_MODELS", ["nb", "null", "ldm"])
    out = workflows.q_all_predictions(spark, str(tmp_path))
    assert "regexp_extract_all" not in out._jdf.queryExecution().toString()
    c = Ctx(spark, str(tmp_path))
    fz, fitted = cv.fit_all_rows(c.train, ["nb"])
    want = sorted((r.pmid, round(r.p_positive, 9)) for r in cv.predict(fz, fitted["nb"], c.test).collect())
    names = [r.model_name for r in out.select("model_name").distinct().collect()]
    assert len(names) == 3
    name = [n for n in names if "ayes" in n or n == "nb"][0]
    got = sorted((r.pmid, round(r.p_positive, 9)) for r in out.where(F.col("model_name") == name).collect())
    assert len(got) > 50 and got == want
