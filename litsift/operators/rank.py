"""The ranked reading list and its re-sorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litsift.operators.prefix import global_row_number

# Display column names and link format of the reading list.
COL_ARTICLE = "Article"
COL_YEAR = "Year of publication"
COL_LABEL = "Label"
COL_RANK = "Rank of article (ordered by probability of correct classification)"
COL_PMID = "PMID"
LINK_PREFIX = '<a href="http://www.ncbi.nlm.nih.gov/pubmed/'
LINK_MIDDLE = '", target="_blank">'
LINK_SUFFIX = "</a>"


def article_link(pmid: Column, title: Column) -> Column:
    """HTML anchor to the article page with the title, escaped, as text."""
    text = F.coalesce(title, F.lit("NA"))
    for char, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(reference))
    return F.concat(F.lit(LINK_PREFIX), pmid, F.lit(LINK_MIDDLE), text, F.lit(LINK_SUFFIX))


def ranked_list(pred: DataFrame, negative_order: str = "p_positive") -> DataFrame:
    """Reading list: predicted positives by P(Positive) descending, then negatives.

    ``pred`` has (pmid, year, title, pred_class, p_positive).  Negatives follow the
    reference and are ordered by P(Positive) descending; ``negative_order='confidence'``
    orders them by P(Negative) descending instead.  Ties break on pmid.  Ranks are
    1..n over the whole list, numbered by a range-partitioned global row number.
    """
    is_pos = (F.col("pred_class") == "Positive")
    neg_key = F.col("p_positive") if negative_order == "p_positive" else -F.col("p_positive")
    key = F.when(is_pos, F.col("p_positive")).otherwise(neg_key)
    df = pred.select("pmid", "year", "title", "pred_class", "p_positive",
                     F.when(is_pos, 0).otherwise(1).alias("_blk"), key.alias("_key"),
                     F.col("pmid").try_cast("long").alias("_pnum"))
    numbered = global_row_number(
        df, [F.col("_blk").asc(), F.col("_key").desc(), F.col("_pnum").asc(),
             F.col("pmid").asc()], name="_rank")
    return numbered.select(
        article_link(F.col("pmid"), F.col("title")).alias(COL_ARTICLE),
        F.col("year").alias(COL_YEAR),
        F.col("pred_class").alias(COL_LABEL),
        F.col("_rank").alias(COL_RANK),
        F.col("pmid").alias(COL_PMID))


def resort_list(ranked: DataFrame, by: list[str | tuple[str, bool]],
                label: str | None = None) -> DataFrame:
    """The list re-sorted by display columns, one class or both (positives first).

    ``by`` names columns, each with an optional "descending" flag; the rank is always the
    last tie-breaker. Adds ``position`` (1..n in the new order).
    """
    sub = ranked if label is None else ranked.where(F.col(COL_LABEL) == label)
    keys = [F.when(F.col(COL_LABEL) == "Positive", 0).otherwise(1).asc()]
    for key in by:
        name, down = key if isinstance(key, tuple) else (key, False)
        keys.append(F.col(name).desc_nulls_last() if down else F.col(name).asc_nulls_last())
    return global_row_number(sub, [*keys, F.col(COL_RANK).asc()], name="position")
