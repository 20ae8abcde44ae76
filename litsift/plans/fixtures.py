"""Stand-in inputs derived from the given tables (documents, labels).

These only put rows into the schemas the triage jobs expect -- they do none of the
jobs' work.  The reference reads id lists and fetched article records; here
``documents`` plays the article store and ``labels.quality`` the curated classes:

* ``articles``       (pmid, year, title, abstract): English documents; every 17th id
  has a NULL abstract and every 29th id gets an extra NULL-abstract record, so the
  missing-abstract logic has work to do.
* ``article_index``  (pmid, class): labelled documents are positive/negative by
  quality, unlabelled ones and every 5th id are to be determined; ids that cannot be
  retrieved (non-English and ``doc_id + 10000000``) are mixed in.
* ``truth``          (pmid, class): the true class of the held-out labelled ids.
* ``scored``         scores in [0, 1] of every labelled document per pseudo model and fold:
  a weighted mean of its class and a hash, in steps, so there are ties.
* ``id_text``        free-text id boxes (ids joined by ", " or newline) per source and
  id block.
The SQL versions (DuckDB dialect) live in :mod:`litsift.plans.oracle`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["documents", "labels"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def articles(docs: DataFrame) -> DataFrame:
    en = docs.where(F.col("lang") == "en").select("doc_id", "text")
    title = F.substring_index("text", "\n", 1)
    year = (F.lit(2000) + F.col("doc_id") % 25).cast("string")
    base = en.select(F.col("doc_id").cast("string").alias("pmid"), year.alias("year"),
                     title.alias("title"),
                     F.when(F.col("doc_id") % 17 == 0, F.lit(None).cast("string"))
                     .otherwise(F.col("text")).alias("abstract"))
    extra = en.where(F.col("doc_id") % 29 == 0).select(
        F.col("doc_id").cast("string").alias("pmid"), year.alias("year"),
        title.alias("title"), F.lit(None).cast("string").alias("abstract"))
    return base.unionByName(extra)


def wide_articles(docs: DataFrame) -> DataFrame:
    """Every document as a record of all fields; every 13th has no doi, every 17th no abstract."""
    n = F.col("doc_id")
    return docs.select(
        n.cast("string").alias("pmid"), F.when(n % 13 != 0, F.concat(F.lit("10.1000/<"), n.cast("string"), F.lit(">"))).alias("doi"),
        F.concat(F.lit("On "), F.coalesce("lang", F.lit("-")), F.lit(" & "), n.cast("string")).alias("title"),
        F.when(n % 17 != 0, F.regexp_replace(F.coalesce("text", F.lit("")), "[^\\x20-\\x7E]", " ")).alias("abstract"),
        (F.lit(2000) + n % 25).cast("string").alias("year"), (F.lit(1) + n % 12).cast("string").alias("month"),
        (F.lit(1) + n % 28).cast("string").alias("day"), F.col("source").alias("journal"),
        F.concat(F.substring("source", 1, 3), F.lit(".")).alias("jabbrv"),
        F.array("lang", F.concat(F.lit("n<"), n.cast("string"))).alias("keywords"))


def article_index(docs: DataFrame, labels: DataFrame) -> DataFrame:
    d = docs.select("doc_id")
    joined = d.join(labels.select("doc_id", "quality"), "doc_id", "left")
    cls = F.when(F.col("quality").isNull() | (F.col("doc_id") % 5 == 0), F.lit(2)) \
        .otherwise(F.col("quality"))
    main = joined.select(F.col("doc_id").cast("string").alias("pmid"),
                         cls.cast("int").alias("class"))
    ghosts = d.where(F.col("doc_id") % 50 == 0).select(
        (F.col("doc_id") + 10000000).cast("string").alias("pmid"),
        F.lit(2).cast("int").alias("class"))
    return main.unionByName(ghosts)


def truth(labels: DataFrame) -> DataFrame:
    return labels.where(F.col("doc_id") % 5 == 0).select(
        F.col("doc_id").cast("string").alias("pmid"),
        F.when(F.col("quality") == 1, F.lit("Positive")).otherwise(F.lit("Negative"))
        .alias("class"))


# Pseudo models with the weight (percent) of the true class in their score and
# the number of steps their scores have. The last scores every document alike.
SCORE_MODELS = [("logit", 45, 1000), ("nb", 30, 1000), ("rf", 55, 100), ("xgboost", 40, 1000),
                ("svm_linear", 25, 1000), ("knn", 20, 5), ("pls", 15, 1000), ("ldm", 35, 50),
                ("mr", 10, 1000), ("null", 0, 1)]


def _draw(*parts) -> Column:
    """0..65535 from a hash, standing in for a model's noise."""
    return F.conv(F.substring(F.md5(F.concat(*parts)), 1, 4), 16, 10).cast("long")


def scored(labels: DataFrame) -> DataFrame:
    models = F.array(*[F.struct(F.lit(m).alias("model_name"), F.lit(w).cast("long").alias("w"),
                                F.lit(n).cast("long").alias("steps")) for m, w, n in SCORE_MODELS])
    d = labels.select("doc_id", "quality").select("*", F.inline(models))
    d = d.withColumn("noise", _draw(F.col("doc_id").cast("string"), F.lit(":"), F.col("model_name")))
    step = F.expr("((w * quality * 65535 + (100 - w) * noise) * steps) div 6553500")
    return d.select(
        "model_name", (F.lit(1) + F.col("doc_id") % 5).cast("int").alias("fold"),
        F.col("doc_id").cast("string").alias("pmid"),
        F.when(F.col("quality") == 1, F.lit("Positive")).otherwise(F.lit("Negative"))
        .alias("class"),
        (step / F.col("steps")).alias("p_positive"))


def rank_scores(test: DataFrame) -> DataFrame:
    """(pmid, p_positive) for every row to be ranked, in steps of 0.0001."""
    noise = _draw(F.col("pmid"), F.lit(":rank")) * F.lit(10000)
    return test.select("pmid", (F.shiftright(noise, 16) / F.lit(10000.0)).alias("p_positive"))


def run_log(events: DataFrame) -> DataFrame:
    """(n_docs, seconds): a log of runs, one for each user of ``events``."""
    return events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("value").alias("seconds")) \
        .select("n_docs", "seconds")


def id_text(docs: DataFrame) -> DataFrame:
    """One free-text id box per (source, block of 50 ids): ids joined by ', ' or newline."""
    item = F.concat(F.col("doc_id").cast("string"),
                    F.when(F.col("doc_id") % 3 == 0, F.lit("\n")).otherwise(F.lit(", ")))
    return (docs.select("source", (F.floor(F.col("doc_id") / 50)).cast("long").alias("block"),
                        item.alias("item"))
            .groupBy("source", "block")
            .agg(F.array_join(F.array_sort(F.collect_list("item")), "").alias("id_text")))


def curated_sets(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """CSV-like curated set (pmid, year, title, abstract, class yes/no) of labelled English docs."""
    a = articles(docs).where(F.col("abstract").isNotNull())
    lab = labels.select(F.col("doc_id").cast("string").alias("pmid"),
                        F.when(F.col("quality") == 1, F.lit("yes")).otherwise(F.lit("no"))
                        .alias("class"))
    return a.join(lab, "pmid")
