"""Corpus assembly: id lists -> class index -> retrieved, cleaned, labelled articles.

Index rows are a bag ``(pmid: string, class: int)`` with class 1 = positive,
0 = negative, 2 = to be determined (TBD).  Articles are ``(pmid, year, title,
abstract)`` strings.  Every function is DataFrame -> DataFrame.  How an id list is joined
with the article store is left to Spark, which goes by measured bytes (broadcast, or a
shuffle join with skewed partitions split).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litsift.operators.prefix import global_row_number
from litsift.operators.scalars import with_scalars

POSITIVE, NEGATIVE, TBD = 1, 0, 2
POS_LABEL, NEG_LABEL = "Positive", "Negative"
# Fixed value: retrieval batches hold fewer than this many ids.
MAX_BATCH = 400


# ---------------------------------------------------------------- ids

def parse_ids(df: DataFrame, text_col: str, keep: list[str] | None = None,
              out_col: str = "pmid") -> DataFrame:
    """Every digit run of a free-text id box becomes one id row (blank text -> no rows)."""
    keep = keep or []
    txt = F.nullif(F.trim(F.col(text_col)), F.lit(""))
    return (df.where(txt.isNotNull())
            .select(*keep, F.explode(F.regexp_extract_all(F.col(text_col), F.lit(r"\d+"),
                                                          F.lit(0))).alias(out_col)))


def tag_class(ids: DataFrame, cls: int, pmid_col: str = "pmid") -> DataFrame:
    """Constant class tag for one id set, pmid as string."""
    return ids.select(F.col(pmid_col).cast("string").alias("pmid"),
                      F.lit(cls).cast("int").alias("class"))


def category_union(ids: DataFrame | None, query_ids: DataFrame | None) -> DataFrame:
    """A category given as ids, a query's ids, or both: bag union (no dedup)."""
    parts = [d.select(F.col("pmid").cast("string").alias("pmid"))
             for d in (ids, query_ids) if d is not None]
    if not parts:
        raise ValueError("a category needs ids or a query")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def build_index(positive: DataFrame | None, negative: DataFrame | None,
                tbd: DataFrame | None) -> DataFrame:
    """Union of the three tagged id sets (bag; an id may appear under two classes)."""
    parts = [tag_class(d, c) for d, c in ((positive, POSITIVE), (negative, NEGATIVE),
                                          (tbd, TBD)) if d is not None]
    if not parts:
        raise ValueError("no ids given")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def check_inputs(pos_ids: str = "", pos_query: str = "", neg_ids: str = "",
                 neg_query: str = "", tbd_ids: str = "", tbd_query: str = "") -> None:
    """Each category needs ids or a query (the app's input check)."""
    for name, ids, q in (("positive", pos_ids, pos_query), ("negative", neg_ids, neg_query),
                         ("to be determined", tbd_ids, tbd_query)):
        if not (ids or "").strip() and not (q or "").strip():
            raise ValueError(f"Please provide ids or a search query for the {name} category")


# ---------------------------------------------------------------- retrieval

def retrieve_by_id(articles: DataFrame, index: DataFrame) -> DataFrame:
    """Articles whose pmid occurs in the index (semi join; one row per stored record)."""
    return (articles.join(index.select("pmid").distinct(), "pmid", "left_semi")
            .select("pmid", "year", "title", "abstract"))


def index_retrieved(index: DataFrame, articles: DataFrame) -> DataFrame:
    """Index rows whose pmid was retrieved (only ids of the article store are read)."""
    return index.join(articles.select("pmid").distinct(), "pmid", "left_semi")


def batch_chunk_len(n: Column) -> Column:
    """floor(N / K) for the smallest K with floor(N / K) < 400; K = floor(N / 400) + 1."""
    k = F.floor(n / F.lit(MAX_BATCH)) + F.lit(1)
    return F.floor(n / k)


def index_order(index: DataFrame) -> list[Column]:
    """Input order of the index: positives, negatives, TBD; numeric pmid inside."""
    cls_order = (F.when(F.col("class") == POSITIVE, 0)
                 .when(F.col("class") == NEGATIVE, 1).otherwise(2))
    return [cls_order, F.col("pmid").try_cast("long"), F.col("pmid")]


def batch_plan(index: DataFrame) -> DataFrame:
    """Retrieval batches: ``(batch_id, n_ids, ids)`` with ``ids`` comma-joined in order.

    Batch i holds rows [1 + i*len, (i+1)*len] of the ordered index; the last batch is
    clipped.  Numbering is the distributed global row number, and each batch is a
    bounded group (< 400 ids).
    """
    n = index.agg(F.count(F.lit(1)).alias("n"))
    numbered = global_row_number(
        index.withColumn("_o1", index_order(index)[0])
             .withColumn("_o2", F.col("pmid").try_cast("long")),
        [F.col("_o1"), F.col("_o2"), F.col("pmid")], name="rn")
    with_len = with_scalars(numbered, n.select(batch_chunk_len(F.col("n")).alias("len")))
    batched = with_len.withColumn("batch_id", F.floor((F.col("rn") - 1) / F.col("len")).cast("long"))
    return (batched.groupBy("batch_id")
            .agg(F.count(F.lit(1)).alias("n_ids"),
                 F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "pmid"))),
                                          lambda s: s["pmid"]), ",").alias("ids")))


# ---------------------------------------------------------------- cleaning

def missing_abstracts(articles: DataFrame) -> DataFrame:
    """pmids whose every article row has a NULL abstract."""
    return (articles.groupBy("pmid")
            .agg(F.bool_and(F.col("abstract").isNull()).alias("_all_null"))
            .where("_all_null").select("pmid"))


def drop_missing(df: DataFrame, missing: DataFrame) -> DataFrame:
    """Remove rows of missing-abstract pmids (anti join)."""
    return df.join(missing, "pmid", "left_anti")


def labelled_articles(articles: DataFrame, index: DataFrame) -> DataFrame:
    """Articles joined to their class tags (inner, many-to-many allowed)."""
    return articles.join(index.select("pmid", "class"), "pmid", "inner") \
        .select("pmid", "year", "title", "abstract", "class")


def assemble_corpus(index: DataFrame, articles: DataFrame) -> DataFrame:
    """The post-fetch retrieval pipeline: semi-join cut, missing-abstract removal, label join.

    ``articles`` is the article store; only records of indexed ids are used.  The store is
    read twice: once for the ids that have an abstract (a map-side combined aggregate, so
    a pmid with very many records is safe), which cut the index, and once for the records.
    The label join then drops records that are not indexed or have no abstract anywhere.
    """
    with_abstract = articles.where(F.col("abstract").isNotNull()).select("pmid").distinct()
    return labelled_articles(articles, index.join(with_abstract, "pmid", "left_semi"))


def coverage(index: DataFrame, articles: DataFrame) -> DataFrame:
    """Retrieval coverage: % of (retrieved) index rows with an abstract, and % retrieved.

    ``pct_with_abstract`` follows the reference: article rows with an abstract whose
    pmid is indexed, over index rows cut to retrieved ids, ``round(x, 4) * 100``.  One
    aggregate per id on either side, one join, one sum; a share of nothing is NULL.
    """
    stored = articles.groupBy("pmid").agg(F.count(F.lit(1)).alias("_records"),
                                          F.bool_or(F.col("abstract").isNotNull()).alias("_has"))
    listed = index.groupBy("pmid").agg(F.count(F.lit(1)).alias("_listed"))
    both = listed.join(stored, "pmid", "left")
    out = both.agg(
        F.coalesce(F.sum("_listed"), F.lit(0)).alias("n_index"),
        F.coalesce(F.sum(F.when(F.col("_records") > 0, F.col("_listed"))), F.lit(0)).alias("n_retrieved"),
        F.coalesce(F.sum(F.when(F.col("_has"), F.col("_records"))), F.lit(0)).alias("n_with_abstract"))

    def share(a: str, b: str) -> Column:
        return F.bround(F.try_divide(F.col(a), F.col(b)), 4) * 100

    return out.select("n_index", "n_retrieved", "n_with_abstract",
                      share("n_retrieved", "n_index").alias("pct_retrieved"),
                      share("n_with_abstract", "n_retrieved").alias("pct_with_abstract"))


def class_counts(df: DataFrame, col: str = "class") -> DataFrame:
    """Rows per class."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- splits

def split_train(labelled: DataFrame) -> DataFrame:
    """Training rows: class < 2 with pmid and abstract; class -> Positive/Negative + label."""
    return (labelled.where((F.col("class") < 2) & F.col("pmid").isNotNull()
                           & F.col("abstract").isNotNull())
            .withColumn("label", F.when(F.col("class") == POSITIVE, 1.0).otherwise(0.0))
            .withColumn("class", F.when(F.col("class") == POSITIVE, F.lit(POS_LABEL))
                        .otherwise(F.lit(NEG_LABEL))))


def split_test(labelled: DataFrame) -> DataFrame:
    """Rows to classify: class == 2 with pmid and abstract."""
    return labelled.where((F.col("class") == TBD) & F.col("pmid").isNotNull()
                          & F.col("abstract").isNotNull())


def split_data(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    return split_train(labelled), split_test(labelled)


def year_filter(df: DataFrame, before: int = 2020) -> DataFrame:
    """Keep rows published before ``before`` (applied to training sources only).

    A year that is no number is not before any.
    """
    return df.where(F.col("year").try_cast("int") < before)


def recode_labels(train: DataFrame, held_out: DataFrame, yes: str = "yes") -> DataFrame:
    """yes/no training rows -> 1/0, held-out rows -> 2; one bag of (pmid, ..., class)."""
    tr = train.withColumn("class", F.when(F.col("class") == yes, 1).otherwise(0).cast("int"))
    ho = held_out.withColumn("class", F.lit(TBD).cast("int"))
    return tr.unionByName(ho)


def truth_from_yes_no(held_out: DataFrame, yes: str = "yes") -> DataFrame:
    """True classes of held-out rows from their yes/no tag."""
    return held_out.select(F.col("pmid").cast("string").alias("pmid"),
                           F.when(F.col("class") == yes, F.lit(POS_LABEL))
                           .otherwise(F.lit(NEG_LABEL)).alias("class"))


def truth_labels(held_out: DataFrame, positive_ids: DataFrame) -> DataFrame:
    """Held-out rows are Positive when their id is in the positive list, else Negative."""
    pos = positive_ids.select(F.col("pmid").cast("string").alias("pmid")).distinct() \
        .withColumn("_hit", F.lit(True))
    return (held_out.select(F.col("pmid").cast("string").alias("pmid"))
            .join(pos, "pmid", "left")
            .select("pmid", F.when(F.col("_hit").isNotNull(), F.lit(POS_LABEL))
                    .otherwise(F.lit(NEG_LABEL)).alias("class")))


def attach_truth(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Replace the placeholder class of predictions with the true class (inner join)."""
    return predictions.drop("class").join(truth.select("pmid", "class"), "pmid", "inner")


# ---------------------------------------------------------------- guard

def corpus_guard(labelled: DataFrame, min_per_class: int = 20) -> DataFrame:
    """Per-class counts with a warning flag below the recommended minimum."""
    counts = labelled.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(
        "class", "n",
        F.when((F.col("class") < 2) & (F.col("n") < min_per_class),
               F.lit(f"fewer than {min_per_class} articles"))
        .otherwise(F.lit(None).cast("string")).alias("warning"))
