"""The streaming scorer applies a fitted recipe + model to arriving article files."""

from litsift.models import cv
from litsift.models.features import add_tokens
from litsift.streaming.score import score_stream


def test_score_stream(spark, tmp_path):
    train = spark.createDataFrame(
        [(str(i), ("allergen ige mast " if i % 2 else "galaxy orbit comet ") + "study data",
          "Positive" if i % 2 else "Negative", float(i % 2)) for i in range(20)],
        "pmid string, abstract string, class string, label double")
    fz, fitted = cv.fit_models(add_tokens(train), ["logit"])
    src = tmp_path / "incoming"
    spark.createDataFrame([("900", "2020", "t1", "allergen ige study"),
                           ("901", "2021", "t2", "galaxy comet data"),
                           ("902", "2021", "t3", None)],
                          "pmid string, year string, title string, abstract string") \
        .write.parquet(str(src))
    scored = score_stream(spark, str(src), fz, fitted["logit"])
    q = scored.writeStream.format("memory").queryName("scored_out").start()
    q.processAllAvailable()
    q.stop()
    rows = {r["pmid"]: r for r in spark.sql("SELECT * FROM scored_out").collect()}
    assert set(rows) == {"900", "901"}
    assert rows["900"]["p_positive"] > rows["901"]["p_positive"]
